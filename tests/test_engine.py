"""Searches, aggregations, percolation and writes against plain Python."""

import json
import os
import random

import pytest

from quern.engine import Engine, fnv
from quern.functions import text as tx
from quern.functions.match import compile_matcher
from quern.operators import aggs as ag
from quern.operators import percolate as pc
from quern.operators.compile import predicate
from quern.plans import datemath as dm
from quern.plans import query as q
from quern.plans.mapping import Mapping, Refused
from quern.sources import documents as sd
from quern.streaming import changelog as cl

SEED = int(os.environ.get("QUERN_SEED", "7"))
MAPPING = {
    "dynamic": "false",
    "fields": {
        "title": "text", "brand": "keyword", "tags": "keyword_list", "price": "number", "created": "date", "active": "bool",
        "spot": {"type": "point", "x": "number", "y": "number"},
        "_v": {"type": "nested", "fields": {"size": "keyword", "price": "number", "stock": "bool", "tags": "keyword_list"}},
    },
}
WORDS = ["Straße", "STRASSE", "ﬁsh", "oak chair", "Oak", "desk  lamp", "İstanbul", "red", "Red Fish", "x_1"]


def value(r: random.Random, kind: str):
    if r.random() < 0.12:
        return None
    if r.random() < 0.1:
        return r.choice([7, "cheap", True, [1, "a"], {"a": 1}, [], "not a date"])
    if kind in ("text", "keyword"):
        return r.choice(WORDS)
    if kind == "keyword_list":
        return r.choice([r.sample(WORDS, r.randint(0, 3)), "red, Oak", ""])
    if kind == "number":
        return r.choice([0, -0.0, 1, 2.5, 10, 1e3])
    if kind == "date":
        return r.choice(["2024-01-31", "2024-02-29T12:00:00Z", 1.7e12])
    if kind == "bool":
        return r.random() < 0.5
    if kind == "point":
        return r.choice([[r.randint(0, 5), r.randint(0, 5)], [[1, 2], [3, 4], ["a", 1]], [1], [[2, 2], [2, 2]]])
    return r.choice([{}, [], "x", [{"size": r.choice(["L", "m", 3, None]), "price": r.choice([1, 5, "x"]), "stock": r.random() < 0.5, "tags": ["red"]} if r.random() < 0.8 else "x" for _ in range(r.randint(1, 4))]])


def document(r: random.Random) -> dict:
    kinds = {k: v if isinstance(v, str) else v["type"] for k, v in MAPPING["fields"].items()}
    out = {k: value(r, v) for k, v in kinds.items()}
    return {k: v for k, v in out.items() if v is not None or r.random() < 0.5}


def leaf(r: random.Random) -> dict:
    op = lambda f, o, *v: {"field": f, "op": o, **({"value": v[0]} if v else {})}
    w, n = r.choice(WORDS), r.choice([0, 1, 2.5, 5, 1e3])
    return r.choice(
        [
            op("title", "contains", w[:3]), op("title", "contains_any", [w, "zz"]), op("title", "contains_all", [w[:2], w[-2:]]), op("title", "eq", w), op("title", "ne", w),
            op("title", "in", [w, "red"]), op("title", "starts_with", w[:2]), op("title", "words_any", [w]), op("title", "words_all", [w, "oak"]), op("title", "similar", {"text": w, "min": 0.4}),
            op("brand", "eq", w), op("brand", "exists"), op("brand", "exists", False), op("brand", "ne", w), op("price", "lt", n), op("price", "gte", n), op("price", "between", [n, n + 5]), op("price", "eq", n),
            op("price", "in", [0, n]), op("price", "ne", n), op("created", "gte", "2024-02-01||/M"), op("created", "lte", "2024-02-29||/d"), op("active", "eq", True), op("active", "ne", False),
            op("tags", "has", w), op("tags", "has_any", [w, "red"]), op("tags", "has_all", ["red", "oak"]), op("tags", "empty"), op("tags", "nonempty"), op("spot", "box", {"x": {"gt": 1}, "y": {"lte": 3}}),
            op("spot", "box", {}), op("spot", "exists"), op("_v", "exists"), op("_id", "eq", "D3"),
            {"nested": {"path": "_v", "query": {"all": [op("_v.size", "eq", "l"), {"not": op("_v.stock", "eq", True)}]}}}, {"nested": {"path": "_v", "query": op("_v.price", "lt", 4)}}, {"nested": {"path": "_v"}},
        ]
    )


def tree(r: random.Random, depth: int = 0) -> dict:
    x = r.random()
    if depth > 1 or x < 0.4:
        return leaf(r)
    if x < 0.6:
        return {"not": tree(r, depth + 1)}
    return {"all" if x < 0.8 else "any": [tree(r, depth + 1) for _ in range(r.randint(1, 3))]}


@pytest.fixture(scope="module")
def world(spark):
    r = random.Random(SEED)
    bodies = [document(r) for _ in range(80)]
    m = Mapping.of(MAPPING)
    raw = spark.createDataFrame([(f"d{i}", json.dumps(b), i, None) for i, b in enumerate(bodies)], "id string, body string, seq long, version long")
    frame = sd.analysed(raw, m).cache()
    docs = {f"d{i}": {**sd.analyse(tx.loads(json.dumps(b)), m), "_id__t": f"d{i}"} for i, b in enumerate(bodies)}
    return m, frame, docs, r


def test_columns_match_the_matcher(world):
    m, frame, docs, r = world
    trees = []
    for _ in range(120):
        t = q.parse(tree(r))
        q.validate(t, m)
        trees.append(q.resolve(t, m, 0))
    safe = [predicate(t, m, True).alias(f"c{i}") for i, t in enumerate(trees)]
    for lo in range(0, len(safe), 40):
        for row in frame.select("id", *safe[lo : lo + 40]).collect():
            for i in range(lo, min(lo + 40, len(trees))):
                assert row[f"c{i}"] == compile_matcher(trees[i])(docs[row.id]), (SEED, trees[i], docs[row.id])
    for t in trees[:12]:
        assert {x.id for x in frame.where(predicate(t, m)).select("id").collect()} == {i for i, d in docs.items() if compile_matcher(t)(d)}, (SEED, t)


def test_percolation_equals_brute_force(world, monkeypatch):
    m, frame, docs, r = world
    queries = [(f"q{i:03}", q.parse(tree(r))) for i in range(150)]
    got = {x.id: list(x.queries) for x in pc.percolate(frame, queries, m, 0).collect()}
    want = {i: [k for k, t in queries if compile_matcher(q.resolve(t, m, 0))(d)] for i, d in docs.items()}
    assert got == want, SEED
    monkeypatch.setattr(pc, "SLICE", 40)
    monkeypatch.setattr(pc, "BINS", 3)
    assert {x.id: list(x.queries) for x in pc.percolate(frame, queries, m, 0).collect()} == want, SEED


def test_anchors_of_intervals_and_similar_texts():
    m = Mapping.of(MAPPING)
    of = lambda t: pc.anchors(q.resolve(q.parse(t), m, 0), m)
    assert of({"field": "price", "op": "between", "value": [1, 5]}) == {("r", "price", (1.0, 5.0))}
    assert of({"all": [{"field": "price", "op": "lt", "value": 5}, {"field": "brand", "op": "eq", "value": "Oak"}]}) == {("v", "brand", "oak")}
    assert of({"field": "spot", "op": "box", "value": {"y": {"gte": 2}}}) == {("ry", "spot", (2.0, float("inf")))}
    assert {k for k, _, _ in of({"field": "title", "op": "similar", "value": {"text": "red oak", "min": 0.5}})} == {"s"}
    assert of({"not": {"field": "price", "op": "lt", "value": 5}}) is None
    t = pc.Intervals([(0.0, 1.0, 7), (1.0, float("inf"), 8), (-float("inf"), 0.0, 9)])
    for x, want in ((-3, {9}), (0, {7, 9}), (0.5, {7}), (1, {7, 8}), (9, {8})):
        assert want <= set(t.at([x])[0])


def test_percolated_inner_hits(spark):
    i = Engine(spark).create_index("v", {"dynamic": "strict", "fields": MAPPING["fields"]})
    i.put_query("n", {"nested": {"path": "_v", "query": {"field": "_v.price", "op": "lt", "value": 4}, "inner_hits": {"size": 1}}})
    got = i.percolate(docs=[{"_v": [{"price": 9}, "x", {"price": 1}, {"price": 2}]}, {"_v": []}])["results"]
    assert got[0]["matches"] == [{"id": "n", "version": 1, "inner_hits": {"_v": {"total": 2, "offsets": [2]}}}] and got[1]["queries"] == []


def test_paging_and_inner_hits(spark, world):
    m, frame, docs, _ = world
    index = Engine(spark).over("w", frame, m)
    sort = [{"price": "desc"}, {"_v.price": {"order": "asc", "where": {"field": "_v.stock", "op": "eq", "value": True}}}, "title"]
    whole = index.search({"sort": sort, "size": 80, "track_total": True})
    assert whole["total"] == {"value": 80, "relation": "eq"}
    ids, cursor = [], None
    while True:
        page = index.search({"sort": sort, "size": 17, **({"search_after": cursor} if cursor else {})})
        ids += [h["id"] for h in page["hits"]]
        cursor = page["next"]
        if not cursor:
            break
    assert ids == [h["id"] for h in whole["hits"]]
    assert [h["id"] for h in index.search({"sort": sort, "from": 5, "size": 4})["hits"]] == ids[5:9]
    assert index.search({"size": 0, "track_total": 10})["total"] == {"value": 10, "relation": "gte"}
    hits = index.search({"query": {"nested": {"path": "_v", "query": {"field": "_v.stock", "op": "eq", "value": True}, "inner_hits": {"size": 1, "fields": ["size"]}}}, "size": 80})["hits"]
    for h in hits:
        objects = docs[h["id"]]["_v__o"]
        want = [i for i, o in enumerate(objects) if o and o["stock__b"]]
        got = h["inner_hits"]["_v"]
        assert got["total"] == len(want) and got["offsets"] == want[:1] and set(got["objects"][0]) <= {"size"}


def test_aggregations(spark, world):
    m, frame, docs, _ = world
    index = Engine(spark).over("w", frame, m)
    out = index.search(
        {
            "size": 0,
            "aggs": {
                "brands": {"terms": {"field": "brand", "size": 2, "order": [{"p.avg": "desc"}]}, "aggs": {"p": {"stats": {"field": "price"}}, "t": {"top_metrics": {"metrics": {"field": "title"}, "sort": {"price": "desc"}, "size": 2}}}},
                "tags": {"terms": {"field": "tags", "include": "r.*", "exclude": ["red fish"]}},
                "h": {"histogram": {"field": "price", "interval": 5}},
                "d": {"date_histogram": {"field": "created", "calendar_interval": "month"}},
                "r": {"range": {"field": "price", "ranges": [{"to": 1}, {"from": 1, "to": 10}, {"from": 500}]}},
                "pr": {"percentile_ranks": {"field": "price", "values": [2.5]}}, "pc": {"percentiles": {"field": "price", "percents": [50]}}, "n": {"cardinality": {"field": "title"}},
                "f": {"filters": {"filters": {"a": {"field": "active", "op": "eq", "value": True}}, "other_bucket_key": "o"}, "aggs": {"mx": {"max": {"field": "price"}}}},
                "g": {"global": {}, "aggs": {"mn": {"min": {"field": "price"}}}},
                "sizes": {"terms": {"field": "_v.size"}, "aggs": {"pp": {"stats": {"field": "_v.price"}}, "dp": {"min": {"field": "price"}}}},
                "c": {"composite": {"sources": [{"b": {"terms": {"field": "brand"}}}, {"p": {"histogram": {"field": "price", "interval": 10}}}], "size": 3}},
            },
        }
    )["aggs"]
    prices = sorted(d["price__n"] for d in docs.values() if d["price__n"] is not None)
    assert sum(b["doc_count"] for b in out["h"]["buckets"]) == len(prices)
    assert len(out["h"]["buckets"]) == (prices[-1] // 5) - (prices[0] // 5) + 1
    assert [b["doc_count"] for b in out["r"]["buckets"]] == [sum(p < 1 for p in prices), sum(1 <= p < 10 for p in prices), sum(p >= 500 for p in prices)]
    assert out["pr"]["values"]["2.5"] == pytest.approx((sum(p < 2.5 for p in prices) + sum(p == 2.5 for p in prices) / 2) / len(prices) * 100)
    assert out["n"]["value"] == len({d["title__t"] for d in docs.values() if d["title__t"] is not None})
    assert out["f"]["buckets"]["a"]["doc_count"] + out["f"]["buckets"]["o"]["doc_count"] == 80
    for b in out["sizes"]["buckets"]:
        assert b["doc_count"] == sum(any(o and o["size__t"] == b["key"] for o in d["_v__o"] or ()) for d in docs.values())
        assert b["pp"]["count"] == sum(o["price__n"] is not None for d in docs.values() for o in d["_v__o"] or () if o and o["size__t"] == b["key"])
    have = [d for d in docs.values() if d["brand__t"] is not None]
    top = out["brands"]
    assert top["sum_other_doc_count"] == len(have) - sum(b["doc_count"] for b in top["buckets"])
    assert {b["key"] for b in out["tags"]["buckets"]} <= {"red"}
    assert len(out["c"]["buckets"]) == 3 and out["c"]["after_key"] == out["c"]["buckets"][-1]["key"]
    for b in top["buckets"]:
        assert len(b["t"]["top"]) <= 2


@pytest.mark.parametrize(
    "body",
    [
        {"query": {"field": "nope", "op": "eq", "value": 1}}, {"query": {"field": "price", "op": "contains", "value": "x"}}, {"query": {"any": []}}, {"query": {"field": "price", "op": "between", "value": [2, 1]}},
        {"sort": ["tags"]}, {"sort": ["_id", "price"]}, {"from": 9999, "size": 10}, {"aggs": {"a": {"terms": {"field": "spot"}}}}, {"aggs": {"a": {"stats": {"field": "price"}, "aggs": {"b": {"min": {"field": "price"}}}}}},
        {"query": {"not": {"nested": {"path": "_v", "inner_hits": {}}}}}, {"size": 1, "bogus": 1}, {"aggs": {"a": {"terms": {"field": "brand", "include": "a~b"}}}},
    ],
)
def test_refusals(spark, world, body):
    m, frame, _, _ = world
    with pytest.raises(Refused) as e:
        Engine(spark).over("w", frame, m).search(body)
    assert e.value.problems[0]["loc"]


def test_text_rules():
    assert tx.normalize("  Straße\x1c X ") == "strasse x" and tx.words("ﬁsh-bowl") == " fish bowl " and tx.words("--") == " "
    assert [tx.as_text(tx.loads(s)) for s in ("10", "1E1", "10.0", "1e400", "-0", "true")] == ["10", "10.0", "10.0", "inf", "0", "true"]
    assert tx.loads('{"a": 1, "a": 2}')["a"] == 2 and tx.entries("b, A, , b") == ["a", "b"]
    assert dm.iso(dm.parse("2024-01-31||+1M").resolve(0, False)).startswith("2024-02-29T00")
    assert dm.parse("2024-02-14").resolve(0, True) - dm.parse("2024-02-14").resolve(0, False) == 86_399_999


def test_writes(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    i = e.create_index("a", {"dynamic": "true", "fields": {}}, {"shards": 3})
    assert i.put("x", {"name": "Oak", "n": 1})["status"] == 201
    assert i.put("x", {"name": "Oak", "n": 1})["result"] == "noop"
    assert i.put("x", {"n": 2}, op_type="create")["status"] == 409
    assert i.put("y", {"n": 2}, version=5)["status"] == 201 and i.put("y", {"n": 3}, version=4)["result"] == "noop"
    assert i.mapping.as_json()["fields"] == {"name": "text", "n": "number"}
    token = i.bulk('{"index": {"_id": "z"}}\n{"n": 4}\n{"delete": {"_id": "x"}}\n{"delete": {"_id": "nope"}}\n')["token"]
    assert sorted(h["id"] for h in i.search({}, wait_for=token)["hits"]) == ["y", "z"]
    i.put_query("big", {"field": "n", "op": "gt", "value": 3})
    assert [r["queries"] for r in i.percolate(docs=[{"n": 9}], ids=["y", "gone"])["results"]] == [["big"], [], []]
    assert i.count({"query": {"field": "n", "op": "gte", "value": 2}})["count"] == 2
    ids = spark.createDataFrame([("x",), ("straße",)], "id string").select("id", cl.shard_of(cl.F.col("id"), 7).alias("s")).collect()
    assert all(r.s == fnv(r.id, 7) for r in ids)


def test_reopening_and_compaction(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    i = e.create_index("a", {"dynamic": "true", "fields": {}}, {"shards": 2, "gc_deletes": 60})
    i.bulk("\n".join(f'{{"index": {{"_id": "{k}"}}}}\n{{"n": {k}, "s": "Straße"}}' for k in range(8)) + "\n")
    i.put_query("big", {"field": "n", "op": "gt", "value": 5}, {"who": "me"})
    i.delete("3"), i.delete("4"), i.put("1", {"n": 100, "s": "x"})
    token = i.token()
    j = Engine(spark, str(tmp_path)).open_index("a")
    assert j.mapping.as_json() == i.mapping.as_json() and j.settings == i.settings and j.reached(token) and j.uid == i.uid
    assert j.get("1") == i.get("1") and j.get("1")["body"]["n"] == 100 and j.get("3") is None
    assert sorted(h["id"] for h in j.search({"size": 20})["hits"]) == ["0", "1", "2", "5", "6", "7"]
    assert j.put("2", {"n": 2, "s": "Straße"})["result"] in ("noop", "updated") and j.put("1", {"n": 100, "s": "x"})["result"] == "noop"
    assert j.get_query("big") == i.get_query("big") and j.percolate(ids=["1", "6", "0"])["results"][0]["queries"] == ["big"]
    assert j.compact(now_ms=0) == 0  # deletes are young
    ends = dict(j._seqs)
    gone = j.compact(now_ms=1 << 50)
    assert gone <= 2 and sorted(h["id"] for h in j.search({"size": 20})["hits"]) == ["0", "1", "2", "5", "6", "7"]
    k = Engine(spark, str(tmp_path)).open_index("a")
    assert k._seqs == ends == j._seqs and k.put("9", {"n": 9})["seq"] == ends[fnv("9", 2)] + 1
    with pytest.raises(Refused):
        Engine(spark, str(tmp_path)).create_index("a")
    with pytest.raises(Refused):
        Engine(spark, str(tmp_path)).open_index("b")


def test_stream_is_idempotent(spark, tmp_path):
    rows = [(0, i, "delete" if i % 7 == 0 else "upsert", f"k{i % 5}", str(i), None, i) for i in range(1, 30)]
    log = str(tmp_path / "log")
    spark.createDataFrame(rows[:15], cl.CHANGES).write.parquet(log)
    for more in (rows[15:], None):
        cl.apply_stream(spark.readStream.schema(cl.CHANGES).parquet(log), str(tmp_path / "state"), str(tmp_path / "cp")).awaitTermination()
        if more:
            spark.createDataFrame(more, cl.CHANGES).write.mode("append").parquet(log)
    last = max(int(p.name) for p in (tmp_path / "state").iterdir())
    got = {r.id: r.seq for r in spark.read.parquet(str(tmp_path / "state" / str(last))).collect()}
    assert got == {f"k{k}": max(i for i in range(1, 30) if i % 5 == k) for k in range(5)}


def read_by_one_task(spark, run) -> int:
    """The most bytes of a shuffle that the task of a stage of one task read while run ran."""
    store, seen = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jsc.sc().dagScheduler().nextStageId()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    found = [0]
    for i in range(seen, spark.sparkContext._jsc.sc().dagScheduler().nextStageId()):
        try:
            stage = store.lastStageAttempt(i)
        except Exception:  # it was skipped
            continue
        found += [stage.shuffleReadBytes()] if stage.numTasks() == 1 else []
    return max(found)


def quantiles(values: list, percents: list) -> list | None:
    values = sorted(values)
    at = [(len(values) - 1) * p / 100 for p in percents]
    return [pytest.approx(values[int(x)] + (values[min(int(x) + 1, len(values) - 1)] - values[int(x)]) * (x - int(x))) for x in at] if values else None


def test_no_task_reads_all_values_for_exact_percentiles(spark):
    n, m = 600_011, Mapping({"price": "number"}, "strict")
    frame = sd.from_columns(spark.range(n), m, {"price": cl.F.expr(f"id * 7919 % {n}")}, cl.F.col("id"))
    body = {"size": 0, "track_total": False, "aggs": {"p": {"percentiles": {"field": "price", "percents": [0, 50, 99, 100]}}}}
    got = []
    read = read_by_one_task(spark, lambda: got.append(Engine(spark).over("p", frame, m).search(body)["aggs"]["p"]["values"]))
    assert list(got[0].values()) == quantiles(range(n), [0, 50, 99, 100])
    assert read < n  # a byte for a value


def test_no_task_reads_all_values_beside_sketches(spark):
    n, m = 600_011, Mapping({"price": "number"}, "strict")
    frame = sd.from_columns(spark.range(n), m, {"price": cl.F.expr(f"id * 7919 % {n}")}, cl.F.col("id"))
    kinds = {"c": {"cardinality": {"field": "price", "mode": "sketch"}}, "e": {"cardinality": {"field": "price"}}, "p": {"percentiles": {"field": "price", "percents": [50], "mode": "sketch"}}, "x": {"percentiles": {"field": "price", "percents": [50], "keyed": False}}}
    got = []
    read = read_by_one_task(spark, lambda: got.append(Engine(spark).over("p", frame, m).search({"size": 0, "track_total": False, "aggs": kinds})["aggs"]))
    assert got[0]["e"]["value"] == n and got[0]["x"]["values"] == [{"key": 50, "value": n // 2}]
    assert got[0]["c"]["value"] == pytest.approx(n, rel=0.03) and got[0]["p"]["values"]["50.0"] == pytest.approx(n / 2, rel=0.01)
    assert read < n  # a byte for a value


def test_one_task_merges_many_sketches_in_little_time(spark):
    """200 sketches, of both modes: their merging takes time that grows with their number, not with its square."""
    n, m = 4_000_037, Mapping({"price": "number"}, "strict")
    frame = sd.from_columns(spark.range(0, n, 1, 200), m, {"price": cl.F.expr(f"id * 7919 % {n}")}, cl.F.col("id"))
    kinds = {"p": {"percentiles": {"field": "price", "percents": [1, 50], "mode": "sketch"}}, "x": {"percentiles": {"field": "price", "percents": [1, 50]}}}
    store, seen, took = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jsc.sc().dagScheduler().nextStageId(), [0.0]
    got = Engine(spark).over("p", frame, m).search({"size": 0, "track_total": False, "aggs": kinds})["aggs"]
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    assert list(got["x"]["values"].values()) == quantiles(range(n), [1, 50])
    assert list(got["p"]["values"].values()) == pytest.approx([n * 0.01, n * 0.5], abs=n * 0.003)
    for i in range(seen, spark.sparkContext._jsc.sc().dagScheduler().nextStageId()):
        try:
            stage = store.lastStageAttempt(i)
        except Exception:  # it was skipped
            continue
        took += [stage.executorCpuTime() / 1e9] if stage.numTasks() == 1 else []
    assert max(took) < 2


def test_exact_percentiles_of_wide_and_narrow_buckets(spark, monkeypatch):
    """By a sketch that is off: values that repeat, negative ones, buckets without values, buckets that are aggregated whole."""
    monkeypatch.setattr(ag, "WIDE", 40)
    monkeypatch.setattr(ag, "ACCURACY", 3)
    r = random.Random(SEED)
    rows = [(i, k, v, [{"k": k, "n": v}, {"k": "x", "n": -v if v else None}]) for i, (k, v) in enumerate((k, f(r)) for k, size, f in (
        ("a", 300, lambda r: r.choice([5.0] * 9 + [r.uniform(-1e6, 1e6)])), ("b", 90, lambda r: float(r.randint(0, 6))), ("c", 41, lambda r: r.gauss(0, 1e-3)), ("d", 40, lambda r: r.random()), ("e", 1, lambda r: 2.5), ("f", 3, lambda r: None),
    ) for _ in range(size))]
    m = Mapping({"k": "keyword", "n": "number", "_v": {"type": "nested", "fields": {"k": "keyword", "n": "number"}}}, "strict")
    t = spark.createDataFrame(rows, "id long, k string, n double, v array<struct<k string, n double>>").repartition(3, "id")
    index = Engine(spark).over("p", sd.from_columns(t, m, {"k": cl.F.col("k"), "n": cl.F.col("n"), "_v": cl.F.col("v")}, cl.F.col("id")), m)
    ps = [0, 0.03, 25, 50, 99.9, 100]
    spec = {"percentiles": {"field": "n", "percents": ps}}
    nested = {"percentiles": {"field": "_v.n", "percents": ps}}
    out = index.search({"size": 0, "aggs": {
        "all": spec, "c": {"cardinality": {"field": "n"}}, "s": {"stats": {"field": "n"}}, "in": {"percentiles": {**nested["percentiles"], "where": {"field": "_v.k", "op": "eq", "value": "x"}}},
        "none": {"filter": {"field": "k", "op": "eq", "value": "f"}, "aggs": {"p": spec}}, "k": {"terms": {"field": "k", "order": [{"p[50]": "desc"}]}, "aggs": {"p": spec, "q": {"percentiles": {"field": "n", "percents": [50]}}, "c": {"cardinality": {"field": "n"}}}},
        "v": {"terms": {"field": "_v.k"}, "aggs": {"own": nested, "doc": spec}}, "r": {"range": {"field": "n", "ranges": [{"from": 1e9}, {"to": 1e9}]}, "aggs": {"p": spec}},
        "o": {"composite": {"sources": [{"k": {"terms": {"field": "k"}}}, {"h": {"histogram": {"field": "n", "interval": 1e7}}}]}, "aggs": {"p": spec}},
    }})["aggs"]
    values = lambda a: None if None in a["values"].values() else list(a["values"].values())
    of = {k: [v for _, x, v, _ in rows if x == k and v is not None] for k in "abcdef"}
    every = [v for x in of.values() for v in x]
    assert values(out["all"]) == values(out["r"]["buckets"][1]["p"]) == quantiles(every, ps) and out["c"]["value"] == len(set(every)) and out["s"]["count"] == len(every)
    assert values(out["in"]) == quantiles([-v for v in every if v], ps)
    assert values(out["none"]["p"]) is None and values(out["r"]["buckets"][0]["p"]) is None
    for b in out["k"]["buckets"]:
        assert values(b["p"]) == quantiles(of[b["key"]], ps) and values(b["q"]) == quantiles(of[b["key"]], [50]) and b["c"]["value"] == len(set(of[b["key"]]))
    medians = [b["q"]["values"]["50.0"] for b in out["k"]["buckets"]]
    assert len(medians) == 6 and medians[-1] is None and medians[:5] == sorted(medians[:5], reverse=True)
    for b in out["v"]["buckets"]:
        assert values(b["own"]) == quantiles(of[b["key"]] if b["key"] != "x" else [-v for v in every if v], ps)
        assert values(b["doc"]) == quantiles(of[b["key"]] if b["key"] != "x" else every, ps)
    halves: dict = {}
    for _, k, v, _ in rows:
        if v is not None:
            halves.setdefault((k, v // 1e7 * 1e7), []).append(v)
    assert {(b["key"]["k"], b["key"]["h"]): values(b["p"]) for b in out["o"]["buckets"]} == {k: quantiles(v, ps) for k, v in sorted(halves.items())[:10]}
