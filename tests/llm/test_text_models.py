"""Operators 1, 5 and 7: exact base scores, normalised states, held-out accuracy, odd rows."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import langid, suffix_tree, toxicity
from quern.llm.common import modulus


def tokens(t):
    return (t or "").encode().lower().split() + [None]


def test_suffix_tree_base(docs, corpus):
    c = Counter(x for r in corpus if zlib.crc32(b"" if r[0] is None else str(r[0]).encode()) % 10 for x in tokens(r[1]))
    total, kinds = sum(c.values()), len(c)
    want = Counter()
    for r in corpus:
        base = sum(math.log10((c[x] + 0.1) / (total + 0.1 * (kinds + 1))) for x in tokens(r[1]))
        want[(r[0], len(tokens(r[1])), sum(c[x] > 0 for x in tokens(r[1])), total, round(base, 6))] += 1
    out = suffix_tree.score_documents(docs.drop("score"), modulus("doc_id", 10) != 0).collect()
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out) == want
    assert all(np.isfinite(r.score) and r.score <= 0 for r in out)


def brute_suffix_tree(rows, train, depth):
    """log10 P(text) by dictionaries of contexts."""
    counts = Counter(x for i, t in rows if train(i) for x in tokens(t))
    total, kinds = sum(counts.values()), len(counts)
    base = lambda w: (counts[w] + 0.1) / (total + 0.1 * (kinds + 1))
    known = {w for w, c in counts.items() if c >= max(2, suffix_tree.WORD_SHARE * total)}

    def contexts(ts, n):
        out = []
        for d in range(1, depth + 1):
            if n - d < 0 or ts[n - d] not in known:
                break
            out.append(tuple(ts[n - d : n][::-1]))  # the nearer first
        return out

    after = {}
    for i, t in rows:
        if train(i):
            ts = tokens(t)
            for n, w in enumerate(ts):
                for h in contexts(ts, n):
                    after.setdefault(h, Counter())[w if w in known else "?rare"] += 1
    states = {}

    def p(h, w):
        """P(w) by the longest state that h ends with; of rare words the share that is left to them."""
        q = base(w) if w in known else 1.0
        for d in range(1, len(h) + 1):
            if h[:d] in states:
                a, left = states[h[:d]]
                q = a.get(w, 0.0) + left * q
        return q

    for d in range(1, depth + 1):
        for h, c in [x for x in after.items() if len(x[0]) == d]:
            n = sum(c.values())
            a = {w: (k - suffix_tree.DISCOUNT) / n for w, k in c.items() if k >= suffix_tree.MIN_COUNT and w in known}
            left = 1 - sum(a.values())
            if not a:
                continue
            q = {w: p(h[:-1], w) for w in a}
            gain = sum(c[w] * math.log((a[w] + left * q[w]) / q[w]) for w in a) + (n - sum(c[w] for w in a)) * math.log(max(left, 1e-12))
            if gain > suffix_tree.DIVERGENCE * (1 + len(a)):
                states[h] = a, left
    out = []
    for _, t in rows:
        ts = tokens(t)
        logs = 0.0
        for n, w in enumerate(ts):
            h = contexts(ts, n)
            logs += math.log10(p(h[-1] if h else (), w) * (1.0 if w in known else base(w)))
        out.append(logs)
    return out, states


@pytest.mark.parametrize("hot", [1_000_000, 5])
def test_suffix_tree_score(spark, corpus, monkeypatch, hot):
    """Scores against brute force, with and without words whose contexts are dealt out to several buckets."""
    r = random.Random(4)
    names = [f"w{k}" for k in range(12)]
    step = {(a, b): r.choices(names, k=3) for a in names for b in names}
    rows = []
    for i in range(150):
        ts = r.choices(names, k=2)
        for _ in range(r.randint(0, 40)):
            ts.append(r.choice(step.get((ts[-2], ts[-1]), names)) if r.random() < 0.9 else f"rare{r.randint(0, 60)}" if r.random() < 0.5 else r.choice(names))
        rows.append((i, " ".join(ts)))
    rows += [(i, t) for i, t, *_ in corpus if i is not None and i < 60 and i != 3]
    train = lambda i: i % 5 != 0
    monkeypatch.setattr(suffix_tree, "HOT", hot)
    df = spark.createDataFrame([(n, t) for n, (i, t) in enumerate(rows)], "doc_id long, text string").repartition(3)
    want, states = brute_suffix_tree(list(enumerate(t for _, t in rows)), train, suffix_tree.DEPTH)
    assert {len(h) for h in states} == {1, 2, 3}
    got = {x.doc_id: x.score for x in suffix_tree.score_documents(df, F.col("doc_id") % 5 != 0).collect()}
    assert [got[n] for n in range(len(rows))] == pytest.approx(want, rel=1e-9)


def test_op1_query(spark, tmp_path):
    spark.createDataFrame([(i, "a b c a b c") for i in range(30)] + [(None, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = suffix_tree.op1_suffix_tree(spark, str(tmp_path))
    assert df.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    out = df.collect()
    assert len(out) == 31 and all(x.held_out == (zlib.crc32(b"" if x.doc_id is None else str(x.doc_id).encode()) % 10 == 0) for x in out)
    assert {x.n_tokens for x in out} == {7, 1} and all(x.score >= x.base_score for x in out if x.doc_id is not None)


def test_states_add_up(spark):
    """A text that repeats is likelier than its words, and the tree's gain is of order, not of words."""
    text = "the cat sat on the mat and the cat ran " * 40
    df = spark.createDataFrame([(i, text) for i in range(20)] + [(99, "mat the on cat the sat " * 40)], "doc_id long, text string")
    out = {r.doc_id: r for r in suffix_tree.score_documents(df, F.col("doc_id") < 15).collect()}
    assert out[19].held_out and out[19].score > out[19].base_score * 0.7
    assert out[99].score < out[19].score


def test_suffix_tree_without_training(docs, none):
    assert suffix_tree.score_documents(none, F.lit(True)).count() == 0
    out = suffix_tree.score_documents(docs, F.lit(False)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 for r in out)


def make(r, kinds, n, odd):
    return " ".join(r.choice(odd) if odd and r.random() < 0.05 else r.choice(kinds) for _ in range(n))


def brute_kneser_ney(texts, toxic, word):
    """log P(word | class) for both classes, by dictionaries: discounted counts (occurrences at the highest order and at
    the start of a word, else distinct characters before), STRENGTH pseudo counts of what both classes share."""
    n = toxicity.ORDER
    held = [Counter(), Counter()]  # texts of each class that hold a word
    for t, y in zip(texts, toxic):
        held[y].update({w for w in (t or "").lower().split()})
    count = [Counter(), Counter()]  # (context, character)
    for y in (0, 1):
        before = {}
        for w, c in held[y].items():
            s = "\x01" + w + "\x02"
            for j in range(len(s)):
                for k in range(1, n + 1):
                    if j - k + 1 < 0 or j == 0:  # the start is not predicted
                        continue
                    gram = s[j - k + 1 : j + 1]
                    if k == n or j - k < 0:
                        count[y][gram] += c
                    else:
                        before.setdefault(gram, set()).add(s[j - k])
        for gram, kinds in before.items():
            count[y][gram] += len(kinds)
    both = count[0] + count[1]
    total, kinds = {}, {}
    for name, c in (("both", both), (0, count[0]), (1, count[1])):
        total[name], kinds[name] = Counter(), Counter()
        for gram, x in c.items():
            total[name][gram[:-1]] += x
            kinds[name][gram[:-1]] += 1
    out, d, strength = [], toxicity.DISCOUNT, toxicity.STRENGTH
    s = "\x01" + word + "\x02"
    for y in (0, 1):
        logs = 0.0
        for j in range(1, len(s)):
            p = 1e-4
            for k in range(1, min(n, j + 1) + 1):
                gram = s[j - k + 1 : j + 1]
                h = gram[:-1]
                if not total["both"][h]:
                    continue
                shared = max(both[gram] - d, 0) / total["both"][h]
                top = (max(count[y][gram] - d, 0) + strength * shared) / (total[y][h] + strength)
                away = (d * kinds[y][h] + strength * d * kinds["both"][h] / total["both"][h]) / (total[y][h] + strength)
                p = top + away * p
            logs += math.log(p)
        out.append(logs)
    return out


def test_kneser_ney_against_brute_force():
    r = random.Random(3)
    texts = [" ".join("".join(r.choice("abcé") for _ in range(r.randint(1, 9))) for _ in range(r.randint(0, 12))) for _ in range(30)] + ["x" * 40 + " ab", None]
    y = [int(r.random() < 0.3) for _ in texts]
    words, ids, sizes = toxicity.words_of(texts)
    m = toxicity._fit(words, ids, sizes, np.array(y))
    ask = np.array([*words[:40], "zzz", "abab", "x" * 39], object)
    got = m.likelihoods(ask)
    assert got == pytest.approx(np.array([brute_kneser_ney(texts, y, w) for w in ask]), rel=1e-4)


def test_kneser_ney_sums_to_one():
    """Words of up to two letters over all letters that were seen, with the end, are all there is after the start."""
    m = toxicity._fit(*toxicity.words_of(["abc abd bcd", "abc ccc"]), np.array([0, 1]))
    p = np.exp(m.likelihoods(np.array(["", *"abcd"], object)))  # P(end), P(a end), ...
    assert (p.sum(0) < 1).all()
    step = {w: math.exp(m.likelihoods(np.array([w], object))[0, 0]) for w in ("ab", "abc", "abd")}
    assert step["abc"] > step["ab"]


def test_toxicity(spark, docs, none):
    r = random.Random(5)
    plain, bad = [f"{a}{b}" for a in "bcdfgl" for b in ("an", "oro", "ith", "ume")], ["vilest", "viler", "vileness", "grokk"]
    texts, y = [], []
    for i in range(400):
        y.append(int(i % 4 == 0))
        texts.append(make(r, plain, r.randint(20, 200), bad if y[-1] else None))
    m = toxicity.fit(texts[:250], y[:250])
    p = m.score(texts[250:])
    assert np.mean((p >= 0.5) == np.array(y[250:])) > 0.95
    out = toxicity.score_texts(docs.withColumnRenamed("k", "a.b"), m, out_col="score")
    assert sorted(out.columns) == sorted(docs.withColumnRenamed("k", "a.b").columns)
    assert out.count() == docs.count() and all(0 <= x.score <= 1 for x in out.select("score").collect())
    assert toxicity.score_texts(none, m).count() == 0
    assert 0 <= toxicity.fit([], []).score([None, ""])[0] <= 1
    long = " ".join(texts[250:300]) * 60
    assert m.score([long])[0] >= 0 and len(long) > 1_000_000


def test_op5_query(spark, tmp_path):
    r = random.Random(8)
    plain, bad = [f"{a}{b}" for a in "bcdfgl" for b in ("an", "oro", "ith", "ume")], ["vilest", "viler", "vileness", "grokk"]
    rows, labels = [], []
    for i in range(300):
        labels.append((i, 1, int(i % 4 == 0)))
        rows.append((i, make(r, plain, r.randint(20, 100), bad if i % 4 == 0 else None)))
    rows += [(None, None), (900, ""), rows[3]]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels + [(7, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    df = toxicity.op5_toxicity(spark, str(tmp_path))
    assert df.columns == ["doc_id", "held_out", "score", "predicted"]
    out = df.collect()
    assert Counter(x.doc_id for x in out) == Counter(i for i, _ in rows)
    assert all(x.held_out == (zlib.crc32(b"" if x.doc_id is None else str(x.doc_id).encode()) % 3 == 1) and x.predicted == int(x.score >= 0.7) for x in out)
    held = [x for x in out if x.held_out and x.doc_id is not None and x.doc_id < 300]
    assert np.mean([x.predicted == int(x.doc_id % 4 == 0) for x in held]) > 0.9


def test_language(docs, none):
    r = random.Random(6)
    stems = {"xx": ["ka", "lo", "mi"], "yy": ["schu", "ver", "ung"], "zz": ["ção", "inho", "rra"]}
    word = lambda lang: "".join(r.choice(stems[lang]) for _ in range(r.randint(1, 3)))
    texts, labels = [], []
    for i in range(150):
        labels.append(sorted(stems)[i % 3])
        texts.append(" ".join(word(labels[-1]) for _ in range(r.randint(5, 60))))
    f = langid.fit(texts[:100], labels[:100])
    got, score = f.predict(texts[100:])
    assert (got == np.array(labels[100:], object)).mean() > 0.97 and ((score >= 0) & (score <= 1)).all()
    mixed = " ".join([word("xx") for _ in range(10)] + [word("yy") for _ in range(10)])
    p, _, _ = f.marginals([mixed])
    assert p[:9, 0].mean() > 0.9 and p[11:, 1].mean() > 0.9  # both halves of a code-switched text
    assert f.predict([None, "", "12 !!"])[0].tolist() == ["und"] * 3
    assert langid.label_texts(docs, f).count() == docs.count() and langid.label_texts(none, f).count() == 0


def test_forward_backward_is_exact():
    rng = np.random.default_rng(1)
    e, go, sizes = rng.random((5, 3)) + 0.1, rng.random((3, 3)) + 0.1, np.array([3, 2])
    p, pairs = langid._spread(e, go, sizes, np.full(3, 1 / 3))
    want, trans, at = np.zeros_like(e), np.zeros((3, 3)), 0
    for n in sizes:
        total, m, t = 0.0, np.zeros((n, 3)), np.zeros((3, 3))
        for path in np.ndindex(*[3] * n):
            w = np.prod([e[at + i, path[i]] for i in range(n)]) * np.prod([go[path[i - 1], path[i]] for i in range(1, n)])
            total += w
            for i in range(n):
                m[i, path[i]] += w
            for i in range(1, n):
                t[path[i - 1], path[i]] += w
        want[at : at + n], trans, at = m / total, trans + t / total, at + n
    assert p == pytest.approx(want) and pairs == pytest.approx(trans)
