"""Operators 2, 4, 9 and 10 against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import blocks, decontam, embeddings, repeats, simhash
from quern.llm.common import components


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randint(0, 60), r.randint(0, 60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 130)] + [(200, i) for i in range(201, 240)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_suffix_ranks():
    """Ranks are those of the sorted windows, of texts with long repeats."""
    rng = np.random.default_rng(2)
    text = np.concatenate([rng.integers(0, 3, 400), np.zeros(250), np.tile(rng.integers(0, 256, 130), 3), rng.integers(0, 2, 150)]).astype(np.uint8)
    starts = np.arange(0, len(text) - repeats.WINDOW + 1)
    windows = [text[s : s + repeats.WINDOW].tobytes() for s in starts]
    place = {w: n for n, w in enumerate(sorted(set(windows)))}
    assert repeats.suffix_ranks(text, starts).tolist() == [place[w] for w in windows]


def test_op4_query(spark, tmp_path):
    spark.createDataFrame([(1, "ab" * 60), (2, "x" + "ab" * 60), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = repeats.op4_repeated_strings(spark, str(tmp_path))
    assert df.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted(tuple(r)[:4] for r in df.collect()) == [(1, 120, 118, 1), (2, 121, 120, 1), (3, 0, 0, 0)]


def test_repeats(docs, none, spark, corpus, monkeypatch):
    d = docs.select("doc_id", "text", F.xxhash64("doc_id", "text", F.col("text").isNull()).alias("k")).distinct().collect()
    for hot in (4_000, 1):
        monkeypatch.setattr(repeats, "HOT", hot)
        seen, want = set(), {}
        for r in sorted(d, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.k)):
            b, mark = (r.text or "").encode(), np.zeros(len((r.text or "").encode()) + 1, int)
            for p in range(len(b) - 99):
                if b[p : p + 100] in seen:
                    mark[p] += 1
                    mark[p + 100] -= 1
                seen.add(b[p : p + 100])
            gone = np.cumsum(mark)[:-1] > 0
            kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
            want[(r.doc_id, r.text)] = (len(b), int(gone.sum()), int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest())
        got = repeats.remove_repeats(docs).collect()
        assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == Counter((r[0], *want[(r[0], r[1])]) for r in corpus)
    assert repeats.remove_repeats(none).count() == 0


@pytest.fixture(scope="module")
def near():
    """Groups of near copies around the threshold, exact copies, and a large group."""
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    out = []
    for g in range(25):
        base = [word() for _ in range(r.randint(30, 150))]
        for _ in range(r.randint(1, 5)):
            t = list(base)
            for _ in range(r.randint(0, 4)):
                t[r.randrange(len(t))] = word()
            out.append(" ".join(t))
    base = [word() for _ in range(80)]
    for i in range(60):
        t = list(base)
        t[r.randrange(80)] = word()
        out.append(" ".join(t))
    return out + [out[0], out[0].upper(), None, None, "", "one two", "One  two!", "one", "  "]


def test_simhash(spark, near, none, docs, monkeypatch):
    sets = [set(s.tolist()) for s in simhash.shingle_sets(near)]
    parent = list(range(len(near)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(near)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    df = spark.createDataFrame(list(enumerate(near)), "doc_id long, text string")
    want = {i: find(i) for i in range(len(near))}
    got = {r.id: r.group_id for r in simhash.groups(df).collect()}
    assert got == want
    kept = simhash.drop_near_copies(df)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({find(i) for i in range(len(near))})
    monkeypatch.setattr(simhash, "MOST", 20)  # lists are recursed into and dealt into blocks
    got = {r.id: r.group_id for r in simhash.groups(df).collect()}
    assert all(want[i] == want[got[i]] for i in got) and sum(got[i] != want[i] for i in got) <= 3
    assert simhash.groups(none).count() == 0 and simhash.drop_near_copies(none).count() == 0
    out = simhash.drop_near_copies(docs)
    assert out.columns == docs.columns and out.groupBy("doc_id", "text").count().where("count > 1 and text is not null and text rlike '[a-z]'").count() == 0


def test_simhash_large_lists_lose_no_pair(spark, near, monkeypatch):
    """Lists above MOST find what one task finds, also of pairs just at the threshold."""
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    texts = []
    for _ in range(200):
        base = [word() for _ in range(120)]
        copy = list(base)
        for i in (20, 60):
            copy[i] = word()
        texts += [" ".join(base), " ".join(copy)]
    pairs, copies = (spark.createDataFrame(list(enumerate(t)), "doc_id long, text string") for t in (texts, near))
    found = lambda df: {x.id: x.group_id for x in simhash.groups(df).collect()}
    want = found(pairs), found(copies)
    assert len(set(want[0].values())) < 220
    monkeypatch.setattr(simhash, "MOST", 20)
    assert (found(pairs), found(copies)) == want


def test_recall_at_the_threshold():
    """The share of pairs just similar enough that some repeat brings together."""
    rng, p = np.random.default_rng(0), simhash._bits_apart(0.8)
    levels, repeats_ = simhash.plan(500_000)
    a = rng.integers(0, 2, (2000, 128), dtype=np.uint8)
    b = a ^ (rng.random(a.shape) < p)
    f, g = (np.packbits(x.astype(np.uint8), axis=1).view(np.int64) for x in (a, b))
    met = np.zeros(2000, bool)
    for r in range(repeats_):
        met |= simhash._strips(f, r, 0, levels) == simhash._strips(g, r, 0, levels)
    assert met.mean() > 0.95


@pytest.mark.parametrize("n", [10_000, 100_000, 1_000_000, 10_000_000, 100_000_000])
def test_recall_holds_at_every_size(n):
    rng, p = np.random.default_rng(1), simhash._bits_apart(0.8)
    levels, repeats_ = simhash.plan(n)
    a = rng.integers(0, 2, (10_000, 128), dtype=np.uint8)
    e = rng.random(a.shape) < p
    f, g = (np.packbits(x.astype(np.uint8), axis=1).view(np.int64) for x in (a, a ^ e))
    met = np.zeros(len(a), bool)
    for r in range(repeats_):
        met |= simhash._strips(f, r, 0, levels) == simhash._strips(g, r, 0, levels)
    met &= e.sum(1) <= simhash.candidates_within(0.8)
    assert met.mean() > simhash.RECALL - 0.006


def brute_embeddings(rows, threshold=0.9):
    """vec -> (links, component, kept) of each row, by numpy; rows with unsound vectors link with nothing."""
    sound = [k for k, (_, v) in enumerate(rows) if v and all(y is not None and np.isfinite(y) for y in v) and any(v)]
    up = list(range(len(rows)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    n = [0] * len(rows)
    unit = {k: np.array(rows[k][1], float) / np.linalg.norm(np.array(rows[k][1], float)) for k in sound}
    for x, i in enumerate(sound):
        for j in sound[:x]:
            if len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold:
                n[i], n[j] = n[i] + 1, n[j] + 1
                up[root(i)] = root(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return Counter((i, n[k], least.get(root(k)), i == least.get(root(k))) for k, (i, _) in enumerate(rows))


@pytest.mark.parametrize("most,sparse,small", [(2_000, 4, 24), (8, 0, 1), (2_000, 0, 1), (8, 10_000, 3)])
def test_embeddings(spark, monkeypatch, most, sparse, small):
    """All links, components and kept flags against brute force: sparse and dense groups, blocks, odd rows, null ids."""
    rng = np.random.default_rng(3)
    base = rng.standard_normal((60, 32))
    x = np.concatenate([base, base[:20] + 0.2 * rng.standard_normal((20, 32)), np.repeat(base[:1], 30, 0), base[5] + 0.2 * rng.standard_normal((40, 32))])
    rows = [(i, [float(np.float32(v)) for v in row]) for i, row in enumerate(x)]
    rows += [(900, None), (901, []), (902, [0.0] * 32), (903, [float("nan")] * 32), (904, [float("inf")] + [1.0] * 31), (905, [None] + [1.0] * 31), (906, [1.0, 2.0])]
    rows += [(None, rows[3][1]), (7, rows[7][1]), (None, [3.0, -1.0]), (None, [3.0, -1.0]), (None, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    monkeypatch.setattr(embeddings, "MOST", most)
    monkeypatch.setattr(embeddings, "SPARSE", sparse)
    monkeypatch.setattr(embeddings, "SMALL", small)
    assert Counter(tuple(r) for r in embeddings.linked(df).collect()) == brute_embeddings(rows)


def test_embeddings_with_null_ids(spark):
    """A row without an id in a group must not take its component away from the others."""
    rng = np.random.default_rng(4)
    rows = []
    for i in range(40):
        v = rng.standard_normal(16)
        rows += [(i, v.tolist()), (None, (v + 0.01 * rng.standard_normal(16)).tolist())]
    out = embeddings.linked(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert Counter(tuple(r) for r in out) == brute_embeddings(rows)
    assert sum(r.kept for r in out) == 40 and embeddings.linked(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_op10_query(spark, tmp_path):
    spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [0.0, 1.0])], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    out = embeddings.op10_embedding_dedup(spark, str(tmp_path))
    assert out.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(tuple(r) for r in out.collect()) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]


@pytest.mark.parametrize("dim", [64, 128])
def test_embeddings_with_a_common_mean(spark, dim):
    """Pairs at cosine 0.90 to 0.92 of vectors that share a direction, as embeddings of text mostly do."""
    rng = np.random.default_rng(5)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    x = unit(np.sqrt(0.4) * unit(rng.standard_normal((1500, dim))) + np.sqrt(0.6) * np.eye(dim)[0])
    e = rng.standard_normal(x.shape)
    e = unit(e - (e * x).sum(1, keepdims=True) * x)
    c = rng.uniform(0.9001, 0.92, (len(x), 1))
    x = np.concatenate([x, c * x + np.sqrt(1 - c * c) * e])
    got = embeddings.linked(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"))
    links = x @ x.T >= 0.9
    assert sum(r.n_links for r in got.collect()) >= 0.97 * (links.sum() - len(x))


def test_blocks_meet_every_pair(spark):
    df = spark.range(50).select(F.lit(1).alias("key"), F.col("id").alias("c"))
    pairs = defaultdict(int)
    for r in blocks.split_hot(df, ["key"], "c", 7).groupBy("lo", "hi").agg(F.collect_list(F.struct("c", "block")).alias("m")).collect():
        for a in r.m:
            for b in r.m:
                if a.c < b.c and (r.lo == r.hi or a.block != b.block):
                    pairs[a.c, b.c] += 1
    assert set(pairs.values()) == {1} and len(pairs) == 50 * 49 // 2


def brute_contaminated(rows, items):
    import re

    tok = lambda t: [w for w in re.split(r"[\x00-/:-@\[-`{-\x7f]+", (t or "").lower()) if w]
    out = set()
    for i, t in rows:
        a = tok(t)
        for j, u in items:
            b = tok(u)
            n = min(decontam.WINDOW, len(b))  # the rule alone: no mask is asked
            for p in range(len(a) - n + 1):
                for q in range(len(b) - n + 1):
                    same = [a[p + o] == b[q + o] for o in range(n)]
                    if n == decontam.WINDOW and sum(same) >= decontam.NEEDED or decontam.SPAN <= n < decontam.WINDOW and sum(same) >= n - 1 and (n > decontam.SPAN or same[-1]):
                        out.add((i, j))
    return out


def test_decontamination(spark, docs, none):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdef") for _ in range(4))
    items = [(j, " ".join(word() for _ in range(r.choice([5, 9, 11, 13, 20, 40])))) for j in range(16)] + [(50, None), (51, "")]
    rows = []
    for i in range(60):
        t = [word() for _ in range(r.randint(0, 40))]
        if i % 2 and items[i % 16][1]:
            leak = items[i % 16][1].split()
            for _ in range(r.randint(0, 3)):
                leak[r.randrange(len(leak))] = word()
            t[len(t) // 2 : len(t) // 2] = leak
        rows.append((i, ", ".join(t).upper() if i % 3 == 0 else " ".join(t)))
    rows += [(60, None), (61, "")]
    a, b = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = brute_contaminated(rows, items)
    for most in (64_000_000, 1):
        assert {(x.doc_id, x.item_id) for x in decontam.contaminated(a, b, max_broadcast_bytes=most).collect()} == want
    left = decontam.drop_contaminated(a.withColumn("__k", F.lit(1)).withColumn("a.b", F.lit(2)), b)
    assert left.columns == ["doc_id", "text", "__k", "a.b"]
    assert {x.doc_id for x in left.collect()} == {i for i, _ in rows} - {i for i, _ in want}
    assert decontam.drop_contaminated(docs, b).columns == docs.columns
    assert decontam.contaminated(none, b).count() == 0 and decontam.contaminated(a, b.limit(0)).count() == 0
