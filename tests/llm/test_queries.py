"""The queries opN_ of operators that have no SQL, on small tables: columns, rows, held-out parts, odd rows."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from quern.llm import decontam, langid, simhash

ODD = [(None, None, None), (None, "", "xx"), (901, "½ ² Ⅷ", "yy"), (902, "12 !", None)]


def words(r, stems, n):
    return " ".join("".join(r.choice(stems) for _ in range(r.randint(1, 3))) for _ in range(n))


def save(spark, path, name, rows, schema):
    spark.createDataFrame(rows, schema).repartition(2).write.parquet(f"{path}/{name}.parquet")


def held(i, n, k):
    return zlib.crc32(b"" if i is None else str(i).encode()) % n == k


def test_op7(spark, tmp_path):
    r = random.Random(1)
    stems = {"xx": ["ka", "lo", "mi"], "yy": ["schu", "ver", "ung"], "zz": ["ção", "inho", "rra"]}
    rows = [(i, words(r, stems[lang], r.randint(5, 40)), lang) for i in range(240) for lang in [sorted(stems)[i % 3]]]
    rows += [*ODD, rows[5], (903, words(r, stems["yy"], 150_000), None), (904, "schu" * 50_000, "yy")]
    save(spark, tmp_path, "documents", rows, "doc_id long, text string, lang string")
    df = langid.op7_language_id(spark, str(tmp_path))
    assert df.columns == ["doc_id", "held_out", "lang_pred", "score"]
    out = df.collect()
    assert Counter(x.doc_id for x in out) == Counter(x[0] for x in rows)
    assert all(x.held_out == held(x.doc_id, 4, 2) and 0 <= x.score <= 1 for x in out)
    got = {x.doc_id: x for x in out if x.doc_id is not None}
    assert got[901].lang_pred == got[902].lang_pred == "und" and got[901].score == 0
    assert got[903].lang_pred == got[904].lang_pred == "yy"
    test = [x for x in rows[:240] if held(x[0], 4, 2)]
    assert np.mean([got[i].lang_pred == lang for i, _, lang in test]) > 0.97


def test_op7_learns_from_rows_without_ids(spark, tmp_path):
    r = random.Random(2)
    rows = [(None, words(r, ["ka", "lo"] if i % 2 else ["schu", "ver"], 6), "ab"[i % 2]) for i in range(3000)]
    save(spark, tmp_path, "documents", rows, "doc_id long, text string, lang string")
    assert {x.lang_pred for x in langid.op7_language_id(spark, str(tmp_path)).collect()} == {"a", "b"}


def test_letters():
    assert langid.words_of(["½a Ⅷ b² ñ_ç 漢字 ९x"])[0].tolist() == ["a", "b", "ñ", "ç", "漢字", "x"]


def test_long_words_have_all_their_features():
    a, b = "x" * 60 + "qzj" + "y" * 60, "x" * 60 + "abc" + "y" * 60
    rows, slots = langid.slots(np.array([a, b], object))
    assert len(set(slots[rows == 0]) ^ set(slots[rows == 1])) >= 8
    assert np.bincount(rows).min() > 3 * 120


def test_op9(spark, tmp_path):
    r = random.Random(3)
    base = [words(r, ["ka", "lo", "mi", "tu"], r.randint(40, 90)) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(base)] + [(100 + i, t + " tail") for i, t in enumerate(base[:10])] + [(200, base[0]), (200, base[0]), (None, base[1]), (None, None), (300, ""), (301, "")]
    long = words(r, ["ka", "lo", "mi", "tu"], 200_000)
    rows += [(400, long), (401, long + " more")]
    save(spark, tmp_path, "documents", rows, "doc_id long, text string")
    df = simhash.op9_simhash_dedup(spark, str(tmp_path))
    assert df.columns == ["doc_id", "group_id", "kept"]
    want = {i: i for i in range(30)} | {100 + i: i for i in range(10)} | {200: 0, 300: 300, 301: 301, 400: 400, 401: 400}
    out = df.collect()
    assert Counter(x.doc_id for x in out) == Counter(i for i, _ in rows)
    assert {x.doc_id: x.group_id for x in out if x.doc_id is not None} == want
    assert all(x.kept == (want[x.doc_id] == x.doc_id) for x in out if x.doc_id is not None)
    assert sorted((x.group_id is None, x.kept) for x in out if x.doc_id is None) == [(False, False), (True, True)]


def test_op2(spark, tmp_path):
    r = random.Random(4)
    items = [(j, words(r, ["ka", "lo", "mi", "tu", "se"], 25)) for j in range(5)] + [(9, None)]
    rows = [(i, words(r, ["ka", "lo", "mi", "tu", "se"], 30) + (" " + items[i % 5][1] if i % 3 == 0 else "")) for i in range(30)] + [(None, items[2][1]), (50, None)]
    save(spark, tmp_path, "documents", rows, "doc_id long, text string")
    save(spark, tmp_path, "benchmark", items, "item_id long, text string")
    df = decontam.op2_decontamination(spark, str(tmp_path))
    assert df.columns == ["doc_id", "item_id", "agreeing", "from_token", "to_token"]
    assert {(x.doc_id, x.item_id) for x in df.collect()} >= {(i, i % 5) for i in range(0, 30, 3)} | {(None, 2)}


@pytest.mark.parametrize("stage", ["near", "language", "lines", "leaks"])
def test_stages_keep_columns_of_any_name(spark, stage):
    names = ["doc_id", "text", "a.b", "row", "k", "digest", "found", "drops", "node", "__k"]
    r = random.Random(5)
    rows = [(i, words(r, ["ka", "lo", "mi"], 30), *"cdefghij"[: len(names) - 2]) for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in names[2:]))
    from quern.llm.lines import drop_frequent_lines

    run = {
        "near": lambda: simhash.drop_near_copies(df),
        "language": lambda: langid.in_one_language(df, langid.fit([x[1] for x in rows], ["a", "a", "b", "b"]), 0.0),
        "lines": lambda: drop_frequent_lines(df),
        "leaks": lambda: decontam.drop_contaminated(df, spark.createDataFrame([(1, "nothing")], "item_id long, text string")),
    }[stage]
    out = run()
    assert out.columns == names and sorted(tuple(x) for x in out.collect()) == rows
