"""The library's own answers (Index.search, count, fields, get, bulk, percolate) as tables, with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.engine import Engine, Index
from quern.plans import driver as dr
from quern.plans.mapping import Mapping, Refused
from quern.sources import documents as sd

QUERIES: dict = {}
SQL: dict[str, str] = {}
_leaf = dr._leaf


def index(spark: SparkSession, d: str, source: str) -> Index:
    """A read-only index over one of the driver's tables."""
    build, mapping = dr._SOURCES[source]
    return Engine(spark).over(source, build(spark, d), mapping)


def json_parts(spark: SparkSession, d: str) -> Index:
    """Parts as JSON documents, analysed as written ones are: their hits have bodies and seqs."""
    t = dr._t(spark, d, "part")
    body = F.to_json(F.struct(F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("type"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price")))
    raw = t.select(F.col("p_partkey").cast("string").alias("id"), body.alias("body"), F.col("p_partkey").cast("long").alias("seq"), F.lit(None).cast("long").alias("version"))
    return Engine(spark).over("part", sd.analysed(raw, dr.PARTS), dr.PARTS)


def folded_orders(spark: SparkSession, d: str) -> Index:
    """Orders whose status and line items' flags are spelled with letters that folding changes."""
    line = dr._t(spark, d, "lineitem").select("l_orderkey", F.struct(F.concat(F.lit(" Straße "), "l_returnflag").alias("flag"), F.col("l_quantity").alias("quantity")).alias("o"))
    items = line.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list("o").alias("items"))
    t = dr._t(spark, d, "orders").join(items, "o_orderkey", "left")
    m = Mapping({"status": "keyword", "_v": {"type": "nested", "fields": {"flag": "keyword", "quantity": "number"}}}, "strict")
    frame = sd.from_columns(t, m, {"status": F.concat("o_orderstatus", F.lit(" ﬁsch ")), "_v": F.col("items")}, F.col("o_orderkey"))
    return Engine(spark).over("folded", frame, m)


def _row(name: str, schema: str, rows, sql: str):
    """A query whose rows a function of (spark, d) computes through an Index."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        return spark.createDataFrame(rows(spark, d), schema)

    QUERIES[name], SQL[name] = run, sql


def _aggs(source: str, spec: dict, read, **body):
    return lambda spark, d: read(index(spark, d, source).search({"size": 0, "aggs": {"a": spec}, **body})["aggs"]["a"])


_count = "count(*)::BIGINT"
_BRAND, _SIZE = _leaf("brand", "in", ["Brand#11", "Brand#12"]), _leaf("size", "lte", 20)
_IN = "p_brand IN ('Brand#11', 'Brand#12')"

_row(
    "agg_filters", "key string, doc_count long, hi double",
    _aggs("part", {"filters": {"filters": {"big": _leaf("size", "gt", 40), "b1": _leaf("brand", "starts_with", "brand#1")}, "other_bucket_key": "other"}, "aggs": {"m": {"max": {"field": "price"}}}}, lambda a: [(k, b["doc_count"], None if b["m"]["value"] is None else float(b["m"]["value"])) for k, b in a["buckets"].items()]),
    " UNION ALL ".join(f"SELECT '{k}' AS key, {_count} AS doc_count, max(p_retailprice)::DOUBLE AS hi FROM part WHERE {c}" for k, c in (("big", "p_size > 40"), ("b1", "starts_with(p_brand, 'Brand#1')"), ("other", "NOT (p_size > 40 OR starts_with(p_brand, 'Brand#1'))"))),
)


def _facets(spark, d):
    out = index(spark, d, "part").search(
        {
            "size": 0, "track_total": True, "post_filter": {"all": [_BRAND, _SIZE]},
            "aggs": {"brand": {"filter": _SIZE}, "size": {"filter": _BRAND, "aggs": {"m": {"min": {"field": "price"}}}}, "every": {"global": {}, "aggs": {"m": {"max": {"field": "price"}}}}},
            "query": _leaf("size", "gt", 2),
        }
    )
    a = out["aggs"]
    return [(out["total"]["value"], a["brand"]["doc_count"], a["size"]["doc_count"], float(a["size"]["m"]["value"]), a["every"]["doc_count"], float(a["every"]["m"]["value"]))]


_row(
    "agg_post_filter_global", "hits long, brand_facet long, size_facet long, lo double, everything long, hi double", _facets,
    f"SELECT count(*) FILTER (WHERE p_size > 2 AND {_IN} AND p_size <= 20)::BIGINT AS hits, count(*) FILTER (WHERE p_size > 2 AND p_size <= 20)::BIGINT AS brand_facet, count(*) FILTER (WHERE p_size > 2 AND {_IN})::BIGINT AS size_facet, (min(p_retailprice) FILTER (WHERE p_size > 2 AND {_IN}))::DOUBLE AS lo, {_count} AS everything, max(p_retailprice)::DOUBLE AS hi FROM part",
)


def _totals(spark, d):
    i = index(spark, d, "events")
    got = [(str(t), i.search({"size": 0, "track_total": t, "query": _leaf("value", "gt", 50)})["total"]) for t in (True, 100, 10_000_000)]
    return [(n, t["value"], t["relation"]) for n, t in got]


_row(
    "track_total_n", "track string, n long, relation string", _totals,
    "WITH c AS (SELECT count(*)::BIGINT AS n FROM events WHERE value > 50) SELECT 'True' AS track, n, 'eq' AS relation FROM c UNION ALL SELECT '100', least(n, 100), CASE WHEN n > 100 THEN 'gte' ELSE 'eq' END FROM c UNION ALL SELECT '10000000', n, 'eq' FROM c",
)
_row("count_api", "n long, relation string", lambda s, d: [(lambda c: (c["count"], c["relation"]))(index(s, d, "events").count({"query": _leaf("type", "eq", "click")}))], f"SELECT {_count} AS n, 'eq' AS relation FROM events WHERE event_type = 'click'")
_row(
    "fields_catalogue", "name string, type string, value string, n long",
    lambda s, d: [(f["name"], f["type"], e["value"], e["count"]) for f in index(s, d, "orders").fields(10)["fields"] for e in f.get("entries", [{"value": None, "count": None}])],
    "SELECT 'flags' AS name, 'keyword_list' AS type, lower(l_returnflag) AS value, count(DISTINCT o_orderkey)::BIGINT AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 3 UNION ALL SELECT name, type, NULL, NULL FROM (VALUES ('_v', 'nested'), ('custkey', 'number'), ('date', 'date'), ('priority', 'keyword'), ('status', 'keyword'), ('total', 'number')) AS v(name, type)",
)
_row("point_read", "id string, name string, size long, seq long", lambda s, d: [(lambda g: (g["id"], g["body"]["name"], g["body"]["size"], g["seq"]))(json_parts(s, d).get("7"))], "SELECT p_partkey::VARCHAR AS id, p_name AS name, p_size::BIGINT AS size, p_partkey::BIGINT AS seq FROM part WHERE p_partkey = 7")


def _hits(body: dict, read):
    return lambda s, d: [read(h) for h in json_parts(s, d).search(body)["hits"]]


_row(
    "hit_shape", "id string, seq long, name string, price double, price_key double",
    _hits({"query": _leaf("size", "gte", 45), "sort": [{"price": "desc"}], "size": 30, "seq_no": True}, lambda h: (h["id"], h["_seq"], h["body"]["name"], float(h["body"]["price"]), float(h["sort"][0]))),
    "SELECT p_partkey::VARCHAR AS id, p_partkey::BIGINT AS seq, p_name AS name, p_retailprice::DOUBLE AS price, p_retailprice::DOUBLE AS price_key FROM part WHERE p_size >= 45 ORDER BY p_retailprice DESC, p_partkey::VARCHAR LIMIT 30",
)
_row(
    "hit_fields", "id string, members string, brand string",
    _hits({"sort": ["_id"], "size": 25, "fields": ["brand", "size", "nothing"]}, lambda h: (h["id"], ",".join(sorted(h["body"])), h["body"]["brand"])),
    "SELECT p_partkey::VARCHAR AS id, 'brand,size' AS members, p_brand AS brand FROM part ORDER BY 1 LIMIT 25",
)


def _order(sort, read, size=40):
    return lambda s, d: [(n, h["id"], *read(h["sort"])) for n, h in enumerate(index(s, d, "part").search({"sort": sort, "size": size})["hits"])]


_ORDERED = "SELECT row_number() OVER (ORDER BY {o}) - 1 AS place, p_partkey::VARCHAR AS id{c} FROM part QUALIFY place < 40"
_row("sort_text", "place long, id string, name string", _order([{"name": "desc"}], lambda k: (k[0],)), _ORDERED.format(o="lower(p_name) DESC, p_partkey::VARCHAR", c=", lower(p_name) AS name"))
_row("sort_id", "place long, id string", _order([{"_id": "desc"}], lambda k: ()), _ORDERED.format(o="p_partkey::VARCHAR DESC", c=""))
_row("sort_unmapped", "place long, id string, first_key double", _order(["nothing", "size"], lambda k: (k[0],)), _ORDERED.format(o="p_size, p_partkey::VARCHAR", c=", NULL::DOUBLE AS first_key"))


def _sort_bool(spark, d):
    m = Mapping({"big": "bool"}, "strict")
    t = dr._t(spark, d, "part")
    i = Engine(spark).over("b", sd.from_columns(t, m, {"big": F.when(F.col("p_size") != 10, F.col("p_size") > 25)}, F.col("p_partkey")), m)
    return [(n, h["id"], h["sort"][0]) for n, h in enumerate(i.search({"sort": [{"big": "desc"}], "size": 40})["hits"])]


_row("sort_bool", "place long, id string, big boolean", _sort_bool, _ORDERED.format(o="(CASE WHEN p_size <> 10 THEN p_size > 25 END) DESC NULLS LAST, p_partkey::VARCHAR", c=", CASE WHEN p_size <> 10 THEN p_size > 25 END AS big"))


def _pages(spark, d):
    i, cursor, out = index(spark, d, "docs"), None, []
    for page in range(4):
        got = i.search({"sort": [{"quality": "desc"}, "n_chars"], "size": 30, **({"search_after": cursor} if cursor else {})})
        out += [(page, int(h["id"])) for h in got["hits"]]
        cursor = got["next"]
    return out


_row("page_next", "page long, id long", _pages, f"SELECT (n // 30)::BIGINT AS page, doc_id::BIGINT AS id FROM (SELECT doc_id, row_number() OVER (ORDER BY quality DESC NULLS LAST, n_chars, doc_id::VARCHAR) - 1 AS n FROM {dr._L}) WHERE n < 120")
_row(
    "agg_sum_other", "key string, doc_count long, other long",
    _aggs("part", {"terms": {"field": "brand", "size": 3}}, lambda a: [(b["key"], b["doc_count"], a["sum_other_doc_count"]) for b in a["buckets"]]),
    "WITH t AS (SELECT lower(p_brand) AS key, count(*)::BIGINT AS doc_count FROM part GROUP BY 1), top AS (SELECT * FROM t ORDER BY 2 DESC, 1 LIMIT 3) SELECT key, doc_count, (SELECT count(p_brand) FROM part)::BIGINT - (SELECT sum(doc_count) FROM top)::BIGINT AS other FROM top",
)
_row(
    "agg_order_bracket", "key string, lo double",
    _aggs("part", {"terms": {"field": "brand", "size": 5, "order": [{"p[min]": "asc"}]}, "aggs": {"p": {"stats": {"field": "price"}}}}, lambda a: [(b["key"], float(b["p"]["min"])) for b in a["buckets"]]),
    "SELECT lower(p_brand) AS key, min(p_retailprice)::DOUBLE AS lo FROM part GROUP BY 1 ORDER BY 2, 1 LIMIT 5",
)
_row(
    "agg_range_keys", "key string, doc_count long",
    _aggs("part", {"range": {"field": "size", "ranges": [{"to": 10}, {"from": 10, "to": 30, "key": "middle"}, {"from": 1000}]}}, lambda a: [(b["key"], b["doc_count"]) for b in a["buckets"]]),
    f"SELECT '*-10.0' AS key, {_count} AS doc_count FROM part WHERE p_size < 10 UNION ALL SELECT 'middle', {_count} FROM part WHERE p_size >= 10 AND p_size < 30 UNION ALL SELECT '1000.0-*', {_count} FROM part WHERE p_size >= 1000",
)
_row(
    "agg_histogram_gaps", "key double, doc_count long",
    _aggs("part", {"histogram": {"field": "size", "interval": 3}}, lambda a: [(float(b["key"]), b["doc_count"]) for b in a["buckets"]], query={"any": [_leaf("size", "lt", 6), _leaf("size", "gt", 40)]}),
    "WITH p AS (SELECT floor(p_size / 3.0) * 3.0 AS k FROM part WHERE p_size < 6 OR p_size > 40) SELECT g::DOUBLE AS key, count(k)::BIGINT AS doc_count FROM (SELECT unnest(range((SELECT min(k) FROM p)::BIGINT, (SELECT max(k) FROM p)::BIGINT + 1, 3)) AS g) LEFT JOIN p ON k = g GROUP BY 1",
)
_row(
    "agg_date_histogram_gaps", "key string, doc_count long",
    _aggs("orders", {"date_histogram": {"field": "date", "calendar_interval": "year"}}, lambda a: [(b["key_as_string"][:4], b["doc_count"]) for b in a["buckets"]], query={"any": [_leaf("date", "lt", "1993-01-01"), _leaf("date", "gte", "1996-01-01")]}),
    "WITH p AS (SELECT year(o_orderdate) AS y FROM orders WHERE o_orderdate < TIMESTAMP '1993-01-01' OR o_orderdate >= TIMESTAMP '1996-01-01') SELECT g::VARCHAR AS key, count(y)::BIGINT AS doc_count FROM (SELECT unnest(range((SELECT min(y) FROM p), (SELECT max(y) FROM p) + 1)) AS g) LEFT JOIN p ON y = g GROUP BY 1",
)


def _composite(spark, d):
    i, out, after = index(spark, d, "lineitem"), [], None
    while True:
        a = i.search({"size": 0, "aggs": {"a": {"composite": {"sources": [{"f": {"terms": {"field": "returnflag"}}}, {"q": {"histogram": {"field": "quantity", "interval": 10}}}], "size": 4, **({"after": after} if after else {})}}}})["aggs"]["a"]
        out += [(b["key"]["f"], float(b["key"]["q"]), b["doc_count"]) for b in a["buckets"]]
        after = a.get("after_key")
        if not after:
            return out


_row("agg_composite_after", "f string, q double, doc_count long", _composite, "SELECT lower(l_returnflag) AS f, (floor(l_quantity / 10) * 10.0)::DOUBLE AS q, count(*)::BIGINT AS doc_count FROM lineitem GROUP BY 1, 2")
_row(
    "agg_sketches", "near_distinct boolean, near_median boolean, keyed boolean",
    lambda s, d: [(lambda a: (abs(a["c"]["value"] - a["e"]["value"]) <= 0.03 * a["e"]["value"], abs(a["p"]["values"]["50.0"] - a["x"]["values"][0]["value"]) <= 0.01 * a["x"]["values"][0]["value"], list(a["p"]["values"]) == ["50.0"]))(
        index(s, d, "lineitem").search({"size": 0, "aggs": {"c": {"cardinality": {"field": "price", "mode": "sketch", "precision": 14}}, "e": {"cardinality": {"field": "price"}}, "p": {"percentiles": {"field": "price", "percents": [50], "mode": "sketch"}}, "x": {"percentiles": {"field": "price", "percents": [50], "keyed": False}}}})["aggs"]
    )],
    "SELECT true AS near_distinct, true AS near_median, true AS keyed",
)


_row(
    "agg_terms_under_terms", "outer string, inner long, doc_count long, other long",
    _aggs("orders", {"terms": {"field": "_v.returnflag", "where": _leaf("_v.quantity", "gt", 10)}, "aggs": {"t": {"terms": {"field": "_v.linenumber", "size": 3}}}}, lambda a: [(b["key"], int(x["key"]), x["doc_count"], b["t"]["sum_other_doc_count"]) for b in a["buckets"] for x in b["t"]["buckets"]]),
    "WITH c AS (SELECT lower(l_returnflag) AS outer_key, l_linenumber::BIGINT AS inner_key, count(DISTINCT o_orderkey)::BIGINT AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity > 10 GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY outer_key ORDER BY n DESC, inner_key) AS rn, sum(n) OVER (PARTITION BY outer_key) AS total FROM c) SELECT outer_key AS \"outer\", inner_key AS \"inner\", n AS doc_count, (total - sum(n) OVER (PARTITION BY outer_key))::BIGINT AS other FROM r WHERE rn <= 3",
)
_row(
    "agg_cardinality_lists", "entries long, sketched long",
    lambda s, d: [(lambda a: (a["e"]["value"], a["s"]["value"]))(index(s, d, "orders").search({"size": 0, "aggs": {"e": {"cardinality": {"field": "flags"}}, "s": {"cardinality": {"field": "flags", "mode": "sketch"}}}})["aggs"])],
    "SELECT count(DISTINCT l_returnflag)::BIGINT AS entries, count(DISTINCT l_returnflag)::BIGINT AS sketched FROM lineitem JOIN orders ON o_orderkey = l_orderkey",
)


def _inner(spark, d):
    """Two nested conditions that share a key are one inner hit; objects show the fields asked for."""
    part = lambda leaf, size: {"nested": {"path": "_v", "query": leaf, "inner_hits": {"size": size, "fields": ["linenumber"]}}}
    hits = index(spark, d, "orders").search({"query": {"any": [part(_leaf("_v.quantity", "gt", 48), 1), part(_leaf("_v.returnflag", "eq", "R"), 3)]}, "sort": ["_id"], "size": 60})["hits"]
    return [(int(h["id"]), h["inner_hits"]["_v"]["total"], ",".join(str(int(o["linenumber"])) for o in h["inner_hits"]["_v"]["objects"])) for h in hits]


_row(
    "inner_hits_merged", "id long, total long, lines string", _inner,
    "SELECT id, total, array_to_string(list_slice(lines, 1, 3), ',') AS lines FROM (SELECT l_orderkey::BIGINT AS id, count(*)::BIGINT AS total, list(l_linenumber::BIGINT ORDER BY l_linenumber) AS lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity > 48 OR l_returnflag = 'R' GROUP BY 1) ORDER BY id::VARCHAR LIMIT 60",
)
_row("fold_top", "n long", lambda s, d: [(folded_orders(s, d).count({"query": {"all": [_leaf("status", "eq", "o FISCH"), _leaf("status", "contains", "FIS"), _leaf("status", "in", ["O FIsch"])]}})["count"],)], f"SELECT {_count} AS n FROM orders WHERE o_orderstatus = 'O'")
_row(
    "fold_nested", "n long",
    lambda s, d: [(folded_orders(s, d).count({"query": {"nested": {"path": "_v", "query": {"all": [_leaf("_v.flag", "eq", "STRASSE r"), _leaf("_v.flag", "starts_with", "straß"), _leaf("_v.quantity", "gt", 30)]}}}})["count"],)],
    "SELECT count(DISTINCT o_orderkey)::BIGINT AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' AND l_quantity > 30",
)

_BAD = {
    "unknown_member": ("part", {"bogus": 1}), "unmapped_query": ("part", {"query": _leaf("nope", "eq", 1)}), "wrong_operator": ("part", {"query": _leaf("price", "contains", "x")}),
    "empty_any": ("part", {"query": {"any": []}}), "backward_between": ("part", {"query": _leaf("price", "between", [2, 1])}), "sort_list": ("orders", {"sort": ["flags"]}), "sort_after_id": ("part", {"sort": ["_id", "price"]}),
    "sort_twice": ("part", {"sort": ["price", "price"]}), "window": ("part", {"from": 9999, "size": 10}), "cursor_length": ("part", {"sort": ["price"], "search_after": [1]}), "cursor_with_from": ("part", {"sort": ["price"], "search_after": [1, "a"], "from": 3}),
    "inner_hits_under_not": ("orders", {"query": {"not": {"nested": {"path": "_v", "query": _leaf("_v.quantity", "gt", 1), "inner_hits": {}}}}}), "metric_with_subs": ("part", {"aggs": {"a": {"stats": {"field": "price"}, "aggs": {"b": {"min": {"field": "price"}}}}}}),
    "inner_hits_objects": ("orders", {"size": 1000, "query": {"nested": {"path": "_v", "query": _leaf("_v.quantity", "gt", 1), "inner_hits": {"size": 50}}}}), "deep_tree": ("part", {"query": {"not": {"not": {"not": {"field": "size", "op": "eq"}}}}}), "terms_of_point": ("users", {"aggs": {"a": {"terms": {"field": "seen"}}}}),
    "sketch_mode": ("part", {"aggs": {"a": {"cardinality": {"field": "price", "mode": "nothing"}}}}),
}


def _refusals(spark, d):
    out = []
    for name, (source, body) in _BAD.items():
        try:
            index(spark, d, source).search(body)
            out.append((name, False))
        except Refused as e:
            out.append((name, e.status == 400 and bool(e.problems[0]["loc"])))
    return out


_row("refusals", "request string, refused boolean", _refusals, "SELECT unnest([" + ", ".join(f"'{k}'" for k in _BAD) + "]) AS request, true AS refused")


def _bulk(spark, d):
    """Actions over the first parts: every item has a status; seqs of a shard have no gaps; a search sees the result."""
    rows = dr._t(spark, d, "part").orderBy("p_partkey").limit(12).collect()
    i = Engine(spark).create_index("w", {"dynamic": "strict", "fields": {"name": "text", "size": "number"}}, {"shards": 2})
    body = lambda r: '{"name": "%s", "size": %d}' % (r.p_name, r.p_size)
    lines = []
    for r in rows:
        lines += ['{"index": {"_id": "%d"}}' % r.p_partkey, body(r)]
    lines += ['{"create": {"_id": "1"}}', body(rows[0]), '{"index": {"_id": "2", "if_seq": 99}}', body(rows[1]), '{"index": {"_id": "3"}}', body(next(r for r in rows if r.p_partkey == 3)), '{"delete": {"_id": "4"}}', '{"delete": {"_id": "none"}}']
    lines += ['{"index": {"_id": "x", "version": 5}}', body(rows[0]), '{"index": {"_id": "x", "version": 4}}', body(rows[1]), '{"index": {"_id": "y"}}', "not json"]
    done = i.bulk("\n".join(lines) + "\n")
    whole = all(sorted(x["seq"] for x in done["items"] if x["shard"] == s and x.get("result") in ("created", "updated", "deleted")) == list(range(1, done["committed"].get(s, 0) + 1)) for s in (0, 1))
    live = sorted(h["id"] for h in i.search({"size": 100}, wait_for=done["token"])["hits"])
    return [(x["id"], n, x["status"], x.get("result")) for n, x in enumerate(done["items"])] + [("gapless", 100, int(whole), None), ("live", 101, len(live), None)]


_row(
    "bulk_items", "id string, item long, status long, result string", _bulk,
    "SELECT p_partkey::VARCHAR AS id, row_number() OVER (ORDER BY p_partkey) - 1 AS item, 201::BIGINT AS status, 'created' AS result FROM (SELECT p_partkey FROM part ORDER BY 1 LIMIT 12) UNION ALL SELECT * FROM (VALUES ('1', 12, 409, NULL), ('2', 13, 409, NULL), ('3', 14, 200, 'noop'), ('4', 15, 200, 'deleted'), ('none', 16, 404, 'not_found'), ('x', 17, 201, 'created'), ('x', 18, 200, 'noop'), ('y', 19, 400, NULL), ('gapless', 100, 1, NULL), ('live', 101, 12, NULL)) AS v(id, item, status, result)",
)


def _percolated(spark, d):
    """Documents sent and stored ones, with inner hits and versions, against saved queries of every kind."""
    i = index(spark, d, "orders")
    i.put_query("big", {"nested": {"path": "_v", "query": _leaf("_v.quantity", "gt", 45), "inner_hits": {"size": 2}}})
    i.put_query("rich", _leaf("total", "gte", 250000))
    i.put_query("rich", _leaf("total", "gte", 300000))
    i.put_query("late", _leaf("date", "gte", "1998-01-01||/y"))
    ids = [str(r.o_orderkey) for r in dr._t(spark, d, "orders").select("o_orderkey").orderBy("o_orderkey").limit(60).collect()]
    out = i.percolate(ids=[*ids, "none"])["results"]
    return [(r["id"], m["id"], m["version"], m["inner_hits"]["_v"]["total"] if "inner_hits" in m else None) for r in out for m in r["matches"]] + [("none", str(out[-1]["found"]), None, None)]


_row(
    "percolate_ids", "id string, query string, version long, inner_total long", _percolated,
    "WITH o AS (SELECT * FROM orders ORDER BY o_orderkey LIMIT 60) SELECT o_orderkey::VARCHAR AS id, 'rich' AS query, 2::BIGINT AS version, NULL::BIGINT AS inner_total FROM o WHERE o_totalprice >= 300000 UNION ALL SELECT o_orderkey::VARCHAR, 'late', 1, NULL FROM o WHERE o_orderdate >= TIMESTAMP '1998-01-01' UNION ALL SELECT o_orderkey::VARCHAR, 'big', 1, count(*)::BIGINT FROM o JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity > 45 GROUP BY 1 UNION ALL SELECT 'none', 'False', NULL, NULL",
)


def _saved(spark, d):
    i = index(spark, d, "part")
    for n in range(25):
        i.put_query(f"q{n:02}", _leaf("size", "eq", n), {"n": n})
    i.delete_query("q03")
    first = i.list_queries(size=10)
    rest = i.list_queries(after=first["next"], size=10)
    return [(p, s["id"], s["query"]["value"], s["version"]) for p, got in enumerate((first, rest)) for s in got["queries"]]


_row("saved_queries", "page long, id string, value long, version long", _saved, "SELECT (row_number() OVER (ORDER BY n) - 1) // 10 AS page, 'q' || lpad(n::VARCHAR, 2, '0') AS id, n AS value, 1::BIGINT AS version FROM (SELECT unnest(range(0, 25)) AS n) WHERE n <> 3 QUALIFY page < 2")


def _reopened(spark, d):
    """Writes of one engine, read by another after compaction: what is left of parts after changes and deletes."""
    import tempfile

    rows = dr._t(spark, d, "part").orderBy("p_partkey").limit(20).collect()
    path = tempfile.mkdtemp(prefix="quern-index-")  # a path of the engine's own; on a cluster it is one that all share
    i = Engine(spark, path).create_index("w", {"dynamic": "strict", "fields": {"size": "number"}}, {"shards": 2, "gc_deletes": 1})
    lines = [x for r in rows for x in ('{"index": {"_id": "%d"}}' % r.p_partkey, '{"size": %d}' % r.p_size)]
    lines += [x for r in rows[:5] for x in ('{"index": {"_id": "%d"}}' % r.p_partkey, '{"size": %d}' % (r.p_size + 100))] + ['{"delete": {"_id": "%d"}}' % r.p_partkey for r in rows[10:14]]
    i.bulk("\n".join(lines) + "\n")
    i.compact(now_ms=1 << 50)
    j = Engine(spark, path).open_index("w")
    return [(int(h["id"]), h["body"]["size"]) for h in j.search({"size": 100})["hits"]]


_row("index_reopened", "id long, size long", _reopened, "SELECT p_partkey::BIGINT AS id, (CASE WHEN n <= 5 THEN p_size + 100 ELSE p_size END)::BIGINT AS size FROM (SELECT p_partkey, p_size, row_number() OVER (ORDER BY p_partkey) AS n FROM part) WHERE n <= 20 AND n NOT BETWEEN 11 AND 14")
