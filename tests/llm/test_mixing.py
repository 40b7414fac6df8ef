"""Operator 6 against water filling by rounds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm.mixing import curriculum, op6_mixing, plan_mix, source_targets


def by_rounds(sizes, weights, cap):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, open_, left = {}, set(names), float(sum(sizes.values()))
    while open_:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        full = [s for s in open_ if share[s] > cap * sizes[s]]
        if not full:
            return out | share
        for s in full:
            out[s] = cap * float(sizes[s])
            left -= out[s]
            open_.discard(s)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_targets(spark, seed):
    rng = np.random.default_rng(seed)
    sizes = {f"s{i}" if i else None: int(rng.integers(0, 10 ** rng.integers(1, 6))) for i in range(int(rng.integers(1, 12)))}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in source_targets(df, (5, 2, 1), 3).collect()}
    want = by_rounds(sizes, (5, 2, 1), 3)
    assert got.keys() == want.keys()
    for s in want:
        assert got[s] == pytest.approx(want[s], abs=1e-6)


ROWS = [(1, "a b c", "x", 1), (2, None, "x", 2), (3, "", None, 3), (4, "d " * 500, "y", 4), (4, "d " * 500, "y", 4), (None, "e f", None, 5), (6, "g", "x", 6), (None, "h", "y", 7), (None, None, None, None)]


def test_mix(spark):
    df = spark.createDataFrame(ROWS * 3, "doc_id long, text string, source string, position int")
    rows = plan_mix(df).collect()
    assert len(rows) == 27
    taken = {}
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size
        t = taken.setdefault(r.row.source, [0, r.target, 0])
        t[0] += r.taken
        t[2] = max(t[2], r.size)
    for got, target, largest in taken.values():
        assert abs(got - target) <= largest / 2 + 1
    out = curriculum(df).collect()
    assert [r.position for r in out] == sorted(r.position for r in out)
    assert all(0 <= r.position <= 1 for r in out) and len(out) == sum(r.passes for r in rows)
    key = lambda r: (r.doc_id or -1, r.text, r.pass_no, r.position)
    assert sorted(map(key, out)) == sorted(map(key, curriculum(df).collect()))


def test_positions_follow_the_schedules(spark):
    """Of a source with an even schedule the copies stand evenly; an early one's come sooner, a late one's later."""
    df = spark.createDataFrame([(i, "w " * 10, "abc"[i % 3]) for i in range(900)], "doc_id long, text string, source string")
    at = {s: np.sort([r.position for r in curriculum(df, weights=(1, 1, 1)).collect() if r.source == s]) for s in "abc"}
    share = lambda n: (np.arange(n) + 0.5) / n
    assert at["a"] == pytest.approx(1 - np.sqrt(1 - share(len(at["a"]))), abs=1e-6)
    assert at["b"] == pytest.approx(share(len(at["b"])), abs=1e-6)
    assert at["c"] == pytest.approx(np.sqrt(share(len(at["c"]))), abs=1e-6)


def test_clashing_names(spark):
    names = ["doc_id", "text", "source", "a.b", "row", "size", "id", "__x", "target", "rank", "src", "pass_no"]
    df = spark.createDataFrame([(i, "a b", "s", *map(str, range(9))) for i in range(5)], "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in names[3:]))
    out = curriculum(df)
    assert out.columns == [*names[:-1], "pass_no", "position"]
    assert {tuple(r)[3:-2] for r in out.collect()} == {tuple(map(str, range(8)))}


def test_op6_query(spark, tmp_path):
    spark.createDataFrame(ROWS, "doc_id long, text string, source string, position int").write.parquet(f"{tmp_path}/documents.parquet")
    df = op6_mixing(spark, str(tmp_path))
    assert df.columns == ["doc_id", "size", "source_size", "target", "taken", "passes", "first_position"]
    out = df.collect()
    assert len(out) == len(ROWS) and all((r.first_position is None) == (r.taken == 0) for r in out)
    assert sum(r.size for r in out) == pytest.approx(sum({r.source_size: r.target for r in out}.values()))


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert plan_mix(df).count() == 0 and curriculum(df).count() == 0
    assert curriculum(spark.createDataFrame([(1, None, None)], df.schema)).count() == 0
    assert plan_mix(spark.createDataFrame([(1, None, None)], df.schema)).select(F.sum("taken")).first()[0] == 0
