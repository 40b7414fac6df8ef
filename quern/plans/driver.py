"""Every operator as a query over the TPC-H-like tables, with the SQL that says the same."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import aggs as ag
from quern.operators import percolate as pc
from quern.operators import search as se
from quern.plans import query as q
from quern.plans.mapping import Mapping
from quern.sources import documents as sd
from quern.streaming import changelog as cl

NOW = 1_764_000_000_000
LINEITEM = Mapping({"returnflag": "keyword", "linestatus": "keyword", "quantity": "number", "price": "number", "discount": "number", "shipdate": "date"}, "strict")
_V = {"type": "nested", "fields": {"linenumber": "number", "quantity": "number", "price": "number", "returnflag": "keyword", "shipdate": "date"}}
ORDERS = Mapping({"custkey": "number", "status": "keyword", "priority": "keyword", "total": "number", "date": "date", "flags": "keyword_list", "_v": _V}, "strict")
PARTS = Mapping({"name": "text", "brand": "keyword", "type": "keyword", "size": "number", "price": "number"}, "strict")
EVENTS = Mapping({"type": "keyword", "user": "number", "value": "number", "ts": "date"}, "strict")
DOCS = Mapping({"lang": "keyword", "source": "keyword", "n_chars": "number", "quality": "number", "toxic": "number"}, "strict")
USERS = Mapping({"seen": {"type": "point", "x": "date", "y": "number"}}, "strict")


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def lineitem(spark, d):
    t = _t(spark, d, "lineitem")
    c = {"returnflag": "l_returnflag", "linestatus": "l_linestatus", "quantity": "l_quantity", "price": "l_extendedprice", "discount": "l_discount", "shipdate": "l_shipdate"}
    return sd.from_columns(t, LINEITEM, {k: F.col(v) for k, v in c.items()}, F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))


def orders(spark, d):
    """Orders with their line items as objects; the join shuffles both sides by order, the items collected first."""
    line = _t(spark, d, "lineitem")
    ms = F.floor(F.unix_micros(F.col("l_shipdate").cast("timestamp")) / 1000).cast("double")
    obj = F.struct(F.col("l_linenumber").alias("linenumber"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.col("l_returnflag").alias("returnflag"), ms.alias("shipdate"))
    items = line.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list(obj)).alias("items"), F.collect_set("l_returnflag").alias("flags"))
    t = _t(spark, d, "orders").join(items, "o_orderkey", "left")
    c = {"custkey": "o_custkey", "status": "o_orderstatus", "priority": "o_orderpriority", "total": "o_totalprice", "date": "o_orderdate", "flags": "flags", "_v": "items"}
    return sd.from_columns(t, ORDERS, {k: F.col(v) for k, v in c.items()}, F.col("o_orderkey"))


def parts(spark, d):
    c = {"name": "p_name", "brand": "p_brand", "type": "p_type", "size": "p_size", "price": "p_retailprice"}
    return sd.from_columns(_t(spark, d, "part"), PARTS, {k: F.col(v) for k, v in c.items()}, F.col("p_partkey"))


def events(spark, d):
    c = {"type": "event_type", "user": "user_id", "value": "value", "ts": "ts"}
    return sd.from_columns(_t(spark, d, "events"), EVENTS, {k: F.col(v) for k, v in c.items()}, F.col("event_id"))


def docs(spark, d):
    t = _t(spark, d, "documents").select("doc_id", "lang", "source", "n_chars").join(_t(spark, d, "labels").dropDuplicates(["doc_id"]), "doc_id", "left")
    return sd.from_columns(t, DOCS, {k: F.col(k) for k in ("lang", "source", "n_chars", "quality", "toxic")}, F.col("doc_id"))


def users(spark, d):
    ms = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("double")
    t = _t(spark, d, "events").groupBy("user_id").agg(F.collect_set(F.struct(ms.alias("x"), F.col("value").alias("y"))).alias("seen"))
    return sd.from_columns(t, USERS, {"seen": F.col("seen")}, F.col("user_id"))


_SOURCES = {"lineitem": (lineitem, LINEITEM), "orders": (orders, ORDERS), "part": (parts, PARTS), "events": (events, EVENTS), "docs": (docs, DOCS), "users": (users, USERS)}
_KEY = {"orders": "o_orderkey", "part": "p_partkey", "events": "event_id", "docs": "doc_id", "users": "user_id"}
QUERIES: dict = {}
SQL: dict[str, str] = {}


def _leaf(field, op, *value):
    return {"field": field, "op": op, **({"value": value[0]} if value else {})}


def _ids(name: str, source: str, tree: dict, sql: str):
    """The ids that a query matches."""
    build, mapping = _SOURCES[source]
    node = q.parse(tree)
    q.validate(node, mapping)

    def run(spark: SparkSession, d: str) -> DataFrame:
        return se.matching(build(spark, d), q.resolve(node, mapping, NOW), mapping).select(F.col("id").cast("long").alias("id"))

    QUERIES[name], SQL[name] = run, sql


def _where(table: str, key: str, cond: str) -> str:
    return f"SELECT {key}::BIGINT AS id FROM {table} WHERE {cond}"


_L = "(SELECT d.doc_id, lang, source, n_chars, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"
_O = "(SELECT * FROM orders LEFT JOIN (SELECT l_orderkey, list(DISTINCT l_returnflag) AS flags FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey)"
_MS = "epoch_ms({})"
_ids("op_eq", "events", _leaf("type", "eq", "Click"), _where("events", "event_id", "lower(event_type) = 'click'"))
_ids("op_ne", "docs", _leaf("toxic", "ne", 1), _where(_L, "doc_id", "toxic IS DISTINCT FROM 1"))
_ids("op_in", "events", _leaf("type", "in", ["click", "purchase", "nothing"]), _where("events", "event_id", "lower(event_type) IN ('click', 'purchase', 'nothing')"))
for _op, _s in (("lt", "<"), ("lte", "<="), ("gt", ">"), ("gte", ">=")):
    _ids(f"op_{_op}", "part", _leaf("size", _op, 20), _where("part", "p_partkey", f"p_size {_s} 20"))
_ids("op_between", "part", _leaf("price", "between", [920, 970.5]), _where("part", "p_partkey", "p_retailprice BETWEEN 920 AND 970.5"))
_ids("op_date_math", "orders", {"all": [_leaf("date", "gte", "1996-01-31||+1M/M"), _leaf("date", "lt", "1998-01-01||-1y/d")]}, _where("orders", "o_orderkey", "o_orderdate >= TIMESTAMP '1996-02-01' AND o_orderdate < TIMESTAMP '1997-01-01'"))
_ids("op_date_round_up", "orders", _leaf("date", "lte", "1996-03-10||/M"), _where("orders", "o_orderkey", "o_orderdate < TIMESTAMP '1996-04-01'"))
_ids("op_exists", "docs", _leaf("quality", "exists"), _where(_L, "doc_id", "quality IS NOT NULL"))
_ids("op_exists_false", "docs", _leaf("quality", "exists", False), _where(_L, "doc_id", "quality IS NULL"))
_ids("op_contains", "part", _leaf("name", "contains", "RE"), _where("part", "p_partkey", "contains(lower(p_name), 're')"))
_ids("op_contains_any", "part", _leaf("name", "contains_any", ["blue", "gr"]), _where("part", "p_partkey", "contains(lower(p_name), 'blue') OR contains(lower(p_name), 'gr')"))
_ids("op_contains_all", "part", _leaf("name", "contains_all", ["e", "G"]), _where("part", "p_partkey", "contains(lower(p_name), 'e') AND contains(lower(p_name), 'g')"))
_ids("op_starts_with", "part", _leaf("brand", "starts_with", "Brand#1"), _where("part", "p_partkey", "starts_with(lower(p_brand), 'brand#1')"))
_WORDS = "concat(' ', regexp_replace(lower(p_name), '[^a-z0-9_]+', ' ', 'g'), ' ')"
_ids("op_words_all", "part", _leaf("name", "words_all", ["Red", "widget"]), _where("part", "p_partkey", f"contains({_WORDS}, ' red ') AND contains({_WORDS}, ' widget ')"))
_ids("op_words_any", "part", _leaf("name", "words_any", ["blue", "hot gear"]), _where("part", "p_partkey", f"contains({_WORDS}, ' blue ') OR contains({_WORDS}, ' hot gear ')"))
_ids("op_has", "orders", _leaf("flags", "has", "R"), _where(_O, "o_orderkey", "list_contains(flags, 'R')"))
_ids("op_has_any", "orders", _leaf("flags", "has_any", ["r", "a"]), _where(_O, "o_orderkey", "list_has_any(flags, ['R', 'A'])"))
_ids("op_has_all", "orders", _leaf("flags", "has_all", ["n", "a"]), _where(_O, "o_orderkey", "list_has_all(flags, ['N', 'A'])"))
_ids("op_empty", "orders", _leaf("flags", "empty"), _where(_O, "o_orderkey", "coalesce(len(flags), 0) = 0"))
_ids("op_nonempty", "orders", _leaf("flags", "nonempty"), _where(_O, "o_orderkey", "len(flags) > 0"))
_ids("op_box", "users", _leaf("seen", "box", {"x": {"gte": 0}, "y": {"gt": 50, "lte": 80}}), "SELECT DISTINCT user_id::BIGINT AS id FROM events WHERE epoch_ms(ts) >= 0 AND value > 50 AND value <= 80")
_ids("bool_tree", "docs", {"all": [{"any": [_leaf("lang", "eq", "de"), _leaf("quality", "eq", 1)]}, {"not": {"all": [_leaf("source", "in", ["src1", "src2"]), _leaf("toxic", "eq", 0)]}}]}, _where(_L, "doc_id", "(lang = 'de' OR coalesce(quality = 1, false)) AND NOT (source IN ('src1', 'src2') AND coalesce(toxic = 0, false))"))
_ids("not_missing", "docs", {"not": _leaf("quality", "gt", 0)}, _where(_L, "doc_id", "NOT coalesce(quality > 0, false)"))
_ids("match_all", "part", {"all": []}, "SELECT p_partkey::BIGINT AS id FROM part")
_N = "EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND {})"
_ids("nested_query", "orders", {"nested": {"path": "_v", "query": {"all": [_leaf("_v.quantity", "gt", 45), _leaf("_v.returnflag", "eq", "R")]}}}, _where("orders", "o_orderkey", _N.format("l_quantity > 45 AND l_returnflag = 'R'")))
_ids("nested_not", "orders", {"not": {"nested": {"path": "_v", "query": {"not": _leaf("_v.quantity", "gt", 10)}}}}, _where("orders", "o_orderkey", "NOT " + _N.format("NOT l_quantity > 10")))


def _similar(spark, d):
    node = q.parse(_leaf("name", "similar", {"text": "red widgets", "min": 0.5}))
    return se.matching(parts(spark, d), node, PARTS).select(F.col("id").cast("long").alias("id"))


QUERIES["op_similar"] = _similar
_GRAMS = "list_distinct(flatten(list_transform(string_split({}, ' '), lambda w: list_transform(range(1, length(w) + 2), lambda i: ('  ' || w || ' ')[i:i + 2]))))"
SQL["op_similar"] = f"SELECT p_partkey::BIGINT AS id FROM (SELECT p_partkey, {_GRAMS.format('lower(p_name)')} AS a, {_GRAMS.format(chr(39) + 'red widgets' + chr(39))} AS b FROM part) WHERE len(list_intersect(a, b))::FLOAT / (len(a) + len(b) - len(list_intersect(a, b)))::FLOAT >= 0.5"


def _page(name: str, source: str, body: dict, cols: dict, sql: str):
    """A page of hits: its sort keys under the names given."""
    build, mapping = _SOURCES[source]

    def run(spark: SparkSession, d: str) -> DataFrame:
        r = se.parse_request(body, mapping, NOW)
        got = se.page(build(spark, d), r, mapping, body=False)
        return got.select(*[F.col(k).cast(t).alias(n) for k, (n, t) in cols.items()])

    QUERIES[name], SQL[name] = run, sql


_page("sort_multi", "lineitem", {"sort": [{"price": "desc"}, "quantity", "shipdate"], "size": 100}, {"s0": ("price", "double"), "s1": ("quantity", "double")}, "SELECT l_extendedprice AS price, l_quantity AS quantity FROM lineitem ORDER BY 1 DESC, 2, l_shipdate LIMIT 100")
_page("sort_missing", "docs", {"sort": [{"quality": "desc"}, "n_chars"], "size": 500}, {"s0": ("quality", "double"), "s1": ("n_chars", "double")}, f"SELECT quality::DOUBLE AS quality, n_chars::DOUBLE AS n_chars FROM {_L} ORDER BY 1 DESC NULLS LAST, 2 LIMIT 500")
_page("sort_nested_min", "orders", {"sort": [{"_v.price": {"order": "asc", "where": _leaf("_v.returnflag", "eq", "n")}}], "size": 50}, {"s0": ("price", "double")}, "SELECT (SELECT min(l_extendedprice) FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'N') AS price FROM orders ORDER BY 1 NULLS LAST LIMIT 50")
_page("page_from", "part", {"sort": ["price", "size"], "from": 40, "size": 20}, {"s0": ("price", "double"), "s1": ("size", "double")}, "SELECT p_retailprice AS price, p_size::DOUBLE AS size FROM part ORDER BY 1, 2 LIMIT 20 OFFSET 40")
_page("page_search_after", "docs", {"sort": [{"toxic": "desc"}, {"n_chars": "desc"}, "_id"], "search_after": [0, 2000, ""], "size": 50}, {"s0": ("toxic", "double"), "s1": ("n_chars", "double")}, f"SELECT toxic::DOUBLE AS toxic, n_chars::DOUBLE AS n_chars FROM {_L} WHERE toxic < 0 OR toxic IS NULL OR (toxic = 0 AND n_chars <= 2000) ORDER BY 1 DESC NULLS LAST, 2 DESC LIMIT 50")


def _inner(spark, d):
    r = se.parse_request({"query": {"nested": {"path": "_v", "query": _leaf("_v.quantity", "gte", 40), "inner_hits": {"size": 2}}}, "sort": [{"total": "desc"}], "size": 100}, ORDERS, NOW)
    got = se.page(orders(spark, d), r, ORDERS, body=False)
    return got.select(F.col("s0").alias("total"), F.col("i0.total").alias("inner_total"), F.size("i0.objects").cast("long").alias("shown"))


QUERIES["inner_hits"] = _inner
SQL["inner_hits"] = "SELECT o_totalprice AS total, n AS inner_total, least(n, 2)::BIGINT AS shown FROM orders JOIN (SELECT l_orderkey, count(*)::BIGINT AS n FROM lineitem WHERE l_quantity >= 40 GROUP BY 1) ON l_orderkey = o_orderkey ORDER BY 1 DESC LIMIT 100"


def _count(spark, d):
    return se.matching(events(spark, d), q.parse(_leaf("value", "gt", 50)), EVENTS).agg(F.count(F.lit(1)).alias("n"))


QUERIES["count_exact"] = _count
SQL["count_exact"] = "SELECT count(*)::BIGINT AS n FROM events WHERE value > 50"


def _spec(mapping: Mapping, spec: dict):
    return ag.parse({"a": spec}, mapping, NOW)[0]


def _agg(name: str, source: str, spec: dict, frame, select: list[str], sql: str, query: dict | None = None):
    build, mapping = _SOURCES[source]

    def run(spark: SparkSession, d: str) -> DataFrame:
        df = build(spark, d)
        if query:
            df = se.matching(df, q.resolve(q.parse(query), mapping, NOW), mapping)
        return frame(df, _spec(mapping, spec), mapping).selectExpr(*select)

    QUERIES[name], SQL[name] = run, sql


_STATS = {"p": {"stats": {"field": "price"}}}
_S = ["key", "doc_count", "`p/count` AS n", "`p/min` AS lo", "`p/max` AS hi", "round(`p/avg`, 4) AS av", "round(`p/sum`, 2) AS total"]
_SQLS = "count(*)::BIGINT AS doc_count, count(l_extendedprice)::BIGINT AS n, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, round(avg(l_extendedprice), 4) AS av, round(sum(l_extendedprice), 2) AS total"
_agg("agg_terms_stats", "lineitem", {"terms": {"field": "returnflag"}, "aggs": _STATS}, ag.terms_top, _S, f"SELECT lower(l_returnflag) AS key, {_SQLS} FROM lineitem WHERE l_quantity BETWEEN 5 AND 40 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10", {"all": [_leaf("quantity", "between", [5, 40])]})
_agg("agg_terms", "part", {"terms": {"field": "brand", "size": 7}}, ag.terms_top, ["key", "doc_count"], "SELECT lower(p_brand) AS key, count(*)::BIGINT AS doc_count FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 7")
_agg("agg_terms_order_sub", "lineitem", {"terms": {"field": "shipdate", "size": 20, "order": [{"p.max": "desc"}]}, "aggs": _STATS}, ag.terms_top, ["key", "doc_count", "`p/max` AS hi"], "SELECT epoch_ms(l_shipdate)::DOUBLE AS key, count(*)::BIGINT AS doc_count, max(l_extendedprice) AS hi FROM lineitem GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 20")
_agg("agg_terms_include", "part", {"terms": {"field": "brand", "include": r"brand\#[1-3].*", "exclude": ["Brand#11"], "size": 100}}, ag.terms_top, ["key", "doc_count"], "SELECT lower(p_brand) AS key, count(*)::BIGINT AS doc_count FROM part WHERE regexp_full_match(lower(p_brand), 'brand#[1-3].*') AND lower(p_brand) <> 'brand#11' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100")
_agg("agg_terms_list", "orders", {"terms": {"field": "flags", "min_doc_count": 2}}, ag.terms_top, ["key", "doc_count"], "SELECT lower(l_returnflag) AS key, count(DISTINCT o_orderkey)::BIGINT AS doc_count FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1 HAVING count(DISTINCT o_orderkey) >= 2")
_agg("agg_range", "events", {"range": {"field": "value", "ranges": [{"to": 20}, {"from": 10, "to": 60}, {"from": 60}]}}, ag.range_frame, ["key", "doc_count"], "SELECT key, count(*)::BIGINT AS doc_count FROM (SELECT unnest(list_filter([CASE WHEN value < 20 THEN 0 END, CASE WHEN value >= 10 AND value < 60 THEN 1 END, CASE WHEN value >= 60 THEN 2 END], lambda x: x IS NOT NULL)) AS key FROM events) GROUP BY 1")
_agg("agg_histogram", "events", {"histogram": {"field": "value", "interval": 7.5, "offset": 2}}, ag.histogram_frame, ["key", "doc_count"], "SELECT floor((value - 2) / 7.5) * 7.5 + 2 AS key, count(*)::BIGINT AS doc_count FROM events GROUP BY 1")
_agg("agg_date_histogram_fixed", "events", {"date_histogram": {"field": "ts", "fixed_interval": "7d"}}, ag.histogram_frame, ["key", "doc_count"], "SELECT floor(epoch_ms(ts) / 604800000.0) * 604800000.0 AS key, count(*)::BIGINT AS doc_count FROM events GROUP BY 1")
for _u in ("day", "week", "month", "quarter", "year"):
    _agg(f"agg_date_histogram_{_u}", "lineitem", {"date_histogram": {"field": "shipdate", "calendar_interval": _u}, "aggs": {"p": {"max": {"field": "price"}}}}, ag.histogram_frame, ["key", "doc_count", "`p/value` AS hi"], f"SELECT epoch_ms(date_trunc('{_u}', l_shipdate)::TIMESTAMP)::DOUBLE AS key, count(*)::BIGINT AS doc_count, max(l_extendedprice) AS hi FROM lineitem GROUP BY 1")
_agg("agg_composite", "lineitem", {"composite": {"sources": [{"f": {"terms": {"field": "returnflag", "order": "desc"}}}, {"q": {"histogram": {"field": "quantity", "interval": 10}}}], "size": 8, "after": {"f": "n", "q": 20}}, "aggs": {"p": {"min": {"field": "price"}}}}, ag.composite_frame, ["k0 AS f", "k1 AS q", "doc_count", "`p/value` AS lo"], "SELECT lower(l_returnflag) AS f, floor(l_quantity / 10) * 10.0 AS q, count(*)::BIGINT AS doc_count, min(l_extendedprice) AS lo FROM lineitem GROUP BY 1, 2 HAVING f < 'n' OR (f = 'n' AND q > 20) ORDER BY 1 DESC, 2 LIMIT 8")


def _metrics(name: str, source: str, specs: dict, select: list[str], sql: str):
    """Metrics of all documents."""
    build, mapping = _SOURCES[source]

    def run(spark: SparkSession, d: str) -> DataFrame:
        found = ag.parse(specs, mapping, NOW)
        return ag.aggregate(build(spark, d), [], found, mapping).selectExpr(*select)

    QUERIES[name], SQL[name] = run, sql


_metrics("agg_stats", "lineitem", {"s": {"stats": {"field": "price"}}}, ["`s/count` AS n", "`s/min` AS lo", "`s/max` AS hi", "round(`s/avg`, 4) AS av", "round(`s/sum`, 1) AS total"], "SELECT count(l_extendedprice)::BIGINT AS n, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, round(avg(l_extendedprice), 4) AS av, round(sum(l_extendedprice), 1) AS total FROM lineitem")
_metrics("agg_min_max", "events", {"lo": {"min": {"field": "ts"}}, "hi": {"max": {"field": "value"}}}, ["`lo/value` AS lo", "`hi/value` AS hi"], "SELECT min(epoch_ms(ts))::DOUBLE AS lo, max(value) AS hi FROM events")
_metrics("agg_cardinality", "lineitem", {"c": {"cardinality": {"field": "shipdate"}}, "t": {"cardinality": {"field": "price", "threshold": 100}}}, ["`c/value` AS dates", "`t/value` AS capped"], "SELECT count(DISTINCT l_shipdate)::BIGINT AS dates, least(count(DISTINCT l_extendedprice), 100)::BIGINT AS capped FROM lineitem")
_metrics("agg_percentiles", "lineitem", {"p": {"percentiles": {"field": "price", "percents": [1, 50, 99]}}}, ["round(`p/values`[0], 4) AS p1", "round(`p/values`[1], 4) AS p50", "round(`p/values`[2], 4) AS p99"], "SELECT round(quantile_cont(l_extendedprice, 0.01), 4) AS p1, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.99), 4) AS p99 FROM lineitem")
_metrics("agg_percentile_ranks", "lineitem", {"p": {"percentile_ranks": {"field": "quantity", "values": [10, 25]}}}, ["round(`p/r0`, 6) AS r10", "round(`p/r1`, 6) AS r25"], "SELECT round((count(*) FILTER (WHERE l_quantity < 10) + 0.5 * count(*) FILTER (WHERE l_quantity = 10)) / count(*) * 100, 6) AS r10, round((count(*) FILTER (WHERE l_quantity < 25) + 0.5 * count(*) FILTER (WHERE l_quantity = 25)) / count(*) * 100, 6) AS r25 FROM lineitem")
_agg("agg_top_metrics", "lineitem", {"terms": {"field": "returnflag"}, "aggs": {"t": {"top_metrics": {"metrics": {"field": "quantity"}, "sort": {"price": "desc"}, "size": 3}}}}, lambda df, a, m: ag.terms_top(df, a, m).select("key", F.explode("t/top").alias("t")), ["key", "t.sort AS price"], "SELECT key, price FROM (SELECT lower(l_returnflag) AS key, l_extendedprice AS price, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC) AS rn FROM lineitem) WHERE rn <= 3")
_agg("agg_nested_terms", "orders", {"terms": {"field": "_v.returnflag", "where": _leaf("_v.quantity", "gt", 30)}, "aggs": {"p": {"stats": {"field": "_v.price"}}, "t": {"min": {"field": "total"}}}}, ag.terms_top, ["key", "doc_count", "`p/count` AS objects", "`t/value` AS lo"], "SELECT lower(l_returnflag) AS key, count(DISTINCT o_orderkey)::BIGINT AS doc_count, count(*)::BIGINT AS objects, min(o_totalprice) AS lo FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity > 30 GROUP BY 1")


@lru_cache
def saved_queries() -> tuple:
    """A table of saved searches over events: values, lists, ranges, a not, and one spelled twice."""
    out = [(f"user{u}", {"all": [_leaf("user", "eq", u), _leaf("value", "gt", 20)]}) for u in range(0, 200, 5)]
    out += [("clicks", _leaf("type", "eq", "click")), ("clicks2", {"all": [_leaf("type", "eq", "CLICK")]}), ("high", _leaf("value", "gte", 95)), ("no", {"not": _leaf("type", "in", ["click", "view"])})]
    return tuple(out)


def _percolate(spark, d):
    got = pc.percolate(events(spark, d), [(k, q.parse(t)) for k, t in saved_queries()], EVENTS, NOW)
    return got.select(F.col("id").cast("long").alias("event_id"), F.explode("queries").alias("query"))


QUERIES["percolate"] = _percolate
SQL["percolate"] = " UNION ALL ".join(
    [f"SELECT event_id::BIGINT AS event_id, 'user{u}' AS query FROM events WHERE user_id = {u} AND value > 20" for u in range(0, 200, 5)]
    + ["SELECT event_id::BIGINT, 'clicks' FROM events WHERE event_type = 'click'", "SELECT event_id::BIGINT, 'clicks2' FROM events WHERE event_type = 'click'", "SELECT event_id::BIGINT, 'high' FROM events WHERE value >= 95", "SELECT event_id::BIGINT, 'no' FROM events WHERE event_type NOT IN ('click', 'view')"]
)


@lru_cache
def thousand_queries() -> tuple:
    """Saved searches by user, by a narrow interval of values, and by type with a bound on the value."""
    kinds = ("click", "view", "purchase")
    out = []
    for n in range(1000):
        if n % 3 == 0:
            t = _leaf("user", "eq", n)
        elif n % 3 == 1:
            t = _leaf("value", "between", [n % 100, n % 100 + 0.25])
        else:
            t = {"all": [_leaf("type", "eq", kinds[n // 3 % 3]), _leaf("value", "gte", 99 + n % 10 / 10)]}
        out.append((f"q{n}", q.parse(t)))
    return tuple(out)


def _percolate_1000(spark, d):
    got = pc.percolate(events(spark, d), thousand_queries(), EVENTS, NOW)
    return got.select(F.col("id").cast("long").alias("event_id"), F.explode("queries").alias("query"))


QUERIES["percolate_1000"] = _percolate_1000
SQL["percolate_1000"] = "SELECT event_id::BIGINT AS event_id, 'q' || n::VARCHAR AS query FROM events, (SELECT unnest(range(0, 1000)) AS n) WHERE CASE n % 3 WHEN 0 THEN user_id = n WHEN 1 THEN value >= n % 100 AND value <= n % 100 + 0.25 ELSE event_type = CASE n // 3 % 3 WHEN 0 THEN 'click' WHEN 1 THEN 'view' ELSE 'purchase' END AND value >= 99 + (n % 10) / 10.0::DOUBLE END"


def _changes(spark, d):
    """Events as changes: a user is a key, its event ids are seqs."""
    return _t(spark, d, "events").select(
        F.lit(0).alias("shard"), F.col("event_id").alias("seq"), F.when(F.col("value") < 5, "delete").otherwise("upsert").alias("op"), F.col("user_id").cast("string").alias("id"),
        F.col("event_type").alias("body"), F.floor(F.col("value")).cast("long").alias("version"), F.lit(0).cast("long").alias("ts_ms"),
    )


def _latest(spark, d):
    return cl.live(cl.net(_changes(spark, d))).select(F.col("id").cast("long").alias("user_id"), "seq", "body")


def _lww(spark, d):
    return cl.versioned(_changes(spark, d)).groupBy(F.col("id").cast("long").alias("user_id")).agg(F.count_if("applied").alias("applied"), F.count_if(~F.col("applied")).alias("noops"))


def _noop(spark, d):
    c = _changes(spark, d)
    half = F.col("seq") % 2 == 0
    batch = c.where(half).withColumn("op", F.lit("upsert"))
    return cl.unchanged(batch.groupBy("id").agg(F.max("seq").alias("seq"), F.max_by("body", "seq").alias("body")).withColumn("op", F.lit("upsert")), cl.net(c.where(~half).withColumn("op", F.lit("upsert")))).select(F.col("id").cast("long").alias("user_id"), "noop")


QUERIES |= {"changelog_latest": _latest, "version_lww": _lww, "noop_dedupe": _noop}
SQL["changelog_latest"] = "SELECT user_id::BIGINT AS user_id, seq, body FROM (SELECT user_id, max(event_id) AS seq, arg_max(event_type, event_id) AS body, arg_max(value, event_id) AS v FROM events GROUP BY 1) WHERE v >= 5"
SQL["version_lww"] = "SELECT user_id::BIGINT AS user_id, count(*) FILTER (WHERE top IS NULL OR v > top)::BIGINT AS applied, count(*) FILTER (WHERE NOT (top IS NULL OR v > top))::BIGINT AS noops FROM (SELECT user_id, floor(value) AS v, max(floor(value)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM events) GROUP BY 1"
SQL["noop_dedupe"] = "SELECT a.user_id::BIGINT AS user_id, coalesce(a.body = b.body, false) AS noop FROM (SELECT user_id, arg_max(event_type, event_id) AS body FROM events WHERE event_id % 2 = 0 GROUP BY 1) a LEFT JOIN (SELECT user_id, arg_max(event_type, event_id) AS body FROM events WHERE event_id % 2 <> 0 GROUP BY 1) b ON a.user_id = b.user_id"
