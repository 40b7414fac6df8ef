"""Operators 8 and 3 against plain Python."""

import hashlib
import random
import re
from collections import Counter

import pytest

from quern.llm import lines
from quern.llm.lines import drop_frequent_lines, op3_substring_dedup, op8_line_dedup, remove_repeated_units, with_lines_dropped, with_units_removed

WS = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line):
    return line.strip(WS).translate(LOWER)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_lines(rows, min_docs=10):
    held = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")} if k)
    for i, t in rows:
        ls = (t or "").split("\n")
        kept = [x for x in ls if not key(x) or held[key(x)] < min_docs]
        yield i, len(ls), len(ls) - len(kept), "\n".join(kept)


def brute_units(rows, min_words):
    """(id, text left, spans) of each row."""
    order = sorted({(i is None, i or 0, hashlib.md5(f"{'-' if i is None else i}\x01t{t}".encode()).hexdigest(), t) for i, t in rows if t is not None}, key=lambda x: x[:2])
    assert len({x[:2] for x in order}) == len(order), "rows of one id are ordered by a hash that Spark has: keep them out"
    seen, out = set(), {}
    for last, i, _, text in order:
        parts = re.split(r"(?<=\n)|(?<=[.!?])(?=[ \t])", text)
        units, at = [], 0
        for p in parts:
            words = tuple(x for x in re.split(r"[\x20\x09-\x0D]+", p.translate(LOWER)) if x)
            if words:
                units.append((at, at + len(p), words in seen, len(words)))
                seen.add(words)
            at += len(p)
        spans, k = [], 0
        while k < len(units):
            j = k
            while j < len(units) and units[j][2]:
                j += 1
            if sum(u[3] for u in units[k:j]) >= min_words and j > k:
                spans.append((units[k][0], units[j - 1][1]))
            k = max(j, k + 1)
        left = "".join(c for n, c in enumerate(text) if not any(a <= n < b for a, b in spans)) if len(text) < 50_000 else None
        out[None if last else i, text] = left, spans
    return [(i, *(out[i, t] if t is not None else (None, []))) for i, t in rows]


def plain(corpus):
    """The rows without those that share an id and differ."""
    first = {}
    for r in corpus:
        first.setdefault(r[0], r)
    return [r for r in corpus if first[r[0]][1] == r[1]]


def test_line_dedup(docs, corpus):
    want = Counter((i, n, gone, text) for i, n, gone, text in brute_lines([(r[0], r[1]) for r in corpus]))
    got = Counter((r.row.doc_id, r.n_lines, r.n_dropped, r.text) for r in with_lines_dropped(docs).collect())
    assert got == want and any(x[2] for x in want)
    out = drop_frequent_lines(docs, chars_col="n_chars").collect()
    assert Counter((r.doc_id, r.text, r.k) for r in out) == Counter((r[0], t, r[5]) for r, (_, _, _, t) in zip(corpus, brute_lines([(r[0], r[1]) for r in corpus])))
    assert all(r.n_chars in (None, 0, 5, len(r.text)) or r.text for r in out)


@pytest.mark.parametrize("min_words", [1, 6, 20])
def test_units(spark, corpus, min_words):
    rows = plain(corpus)
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcé") for _ in range(r.randint(1, 4)))
    passage = " ".join(word() + r.choice(["", "", "", ".", "!\n"]) for _ in range(70))
    more = [(500 + n, " ".join(word() for _ in range(30)) + " " + passage + "\n\n" + word(), *rows[0][2:]) for n in range(4)]
    more += [(600, passage.upper().replace("É", "é"), *rows[0][2:]), (601, ". . ! \t.\n", *rows[0][2:])]
    df = spark.createDataFrame(rows + more, docs_schema()).repartition(3)
    want = brute_units([(x[0], x[1]) for x in rows + more], min_words)
    out = with_units_removed(df, min_words).collect()
    got = Counter((x.row.doc_id, x.text, tuple((s.start, s.end) for s in x.removed)) for x in out)
    assert got == Counter((i, t if t is not None else None, tuple(s)) for i, t, s in want) and any(s for _, _, s in want)
    left = remove_repeated_units(df, min_words)
    assert left.columns == df.columns and Counter((x.doc_id, x.text) for x in left.collect()) == Counter((i, t) for i, t, _ in want)


def docs_schema():
    return "doc_id long, text string, lang string, source string, n_chars long, k string, n int, position string, score string"


def test_queries(spark, corpus, tmp_path):
    rows = [(r[0], r[1]) for r in plain(corpus)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter(tuple(r) for r in op8_line_dedup(spark, str(tmp_path)).collect())
    assert got == Counter((i, n, gone, sha(t)) for i, n, gone, t in brute_lines(rows))
    got = Counter(tuple(r) for r in op3_substring_dedup(spark, str(tmp_path)).collect())
    texts = dict(rows)
    want = Counter((i, len(texts[i] or ""), sum(b - a for a, b in s), len(s), ",".join(f"{a}-{b}" for a, b in s), sha(t or "")) for i, t, s in brute_units(rows, lines.MIN_WORDS))
    assert got == want


NAMES = ["doc_id", "text", "row", "k", "a.b", "drops", "units", "got", "digest", "__drops", "n_lines", "removed"]


def test_clashing_names(spark):
    text = "one two three.\nfour five six seven"
    df = spark.createDataFrame([(i, text, *map(str, range(10))) for i in range(12)], "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in NAMES[2:]))
    for out in (drop_frequent_lines(df), remove_repeated_units(df, 1)):
        assert out.columns == NAMES
        assert {tuple(r)[2:] for r in out.collect()} == {tuple(map(str, range(10)))}
    assert {r.text for r in drop_frequent_lines(df).collect()} == {""}
    assert sorted((r.doc_id, r.text) for r in remove_repeated_units(df, 1).collect()) == [(0, text), *((i, "") for i in range(1, 12))]


def test_many_lines_in_long_texts(spark):
    """Texts of some MB, all of whose lines go: the time is linear in their number."""
    text = "\n".join(f"Line number {n} of a very long text that repeats." for n in range(60_000))
    df = spark.createDataFrame([(i, text) for i in range(10)], "doc_id long, text string").repartition(4)
    assert {(r.n_lines, r.n_dropped, r.text) for r in with_lines_dropped(df).collect()} == {(60_000, 60_000, "")}
    out = {r.row.doc_id: (len(r.text), len(r.removed)) for r in with_units_removed(df).collect()}
    assert out == {0: (len(text), 0)} | {i: (0, 1) for i in range(1, 10)}


def test_empty(none):
    assert drop_frequent_lines(none).count() == 0 and with_units_removed(none).count() == 0 and remove_repeated_units(none).columns == none.columns
