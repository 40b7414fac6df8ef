"""Searches over analysed documents: filters, sorts, pages, totals, hits and inner hits."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions import text as tx
from quern.operators.compile import column, object_filter, predicate
from quern.plans import query as q
from quern.plans.mapping import BOOL, DATE, KEYWORD, LIST, NESTED, NUMBER, POINT, TEXT, Mapping, Refused, object_type

MAX_WINDOW, MAX_SORT, MAX_FIELDS, TRACK = 10_000, 16, 100, 10_000
MEMBERS = ("query", "sort", "size", "from", "search_after", "track_total", "fields", "aggs", "aggregations", "post_filter", "timeout", "seq_no", "request_cache", "max_staleness")


@dataclass
class Sort:
    field: str
    desc: bool = False
    mode: str | None = None
    where: object = None


@dataclass
class Request:
    query: object = q.EVERYTHING
    post_filter: object = None
    sort: list[Sort] = field(default_factory=list)
    size: int = 10
    start: int = 0
    after: list | None = None
    track: object = TRACK
    fields: list[str] | None = None
    aggs: dict = field(default_factory=dict)
    seq_no: bool = False


def _count(v, loc: str, most: int = MAX_WINDOW) -> int:
    if isinstance(v, bool) or not isinstance(v, int) or not 0 <= v <= most:
        raise Refused((loc, f"a whole number from 0 to {most}"))
    return v


def parse_request(body: dict, mapping: Mapping, now_ms: int) -> Request:
    """A request, validated against the mapping, its date math resolved at one now."""
    if unknown := sorted(set(body) - set(MEMBERS)):
        raise Refused(*[(k, "unknown member") for k in unknown])
    r = Request()

    def tree(key):
        node = q.parse(body[key], key)
        q.validate(node, mapping, key)
        return q.resolve(node, mapping, now_ms)

    if "query" in body:
        r.query = tree("query")
    if body.get("post_filter") is not None:
        r.post_filter = tree("post_filter")
    r.size, r.start = _count(body.get("size", 10), "size"), _count(body.get("from", 0), "from")
    if r.size + r.start > MAX_WINDOW:
        raise Refused(("from", f"from and size reach {MAX_WINDOW} at most: page with search_after"))
    r.sort = _sorts(body.get("sort", []), mapping, now_ms)
    if body.get("search_after") is not None:
        r.after = list(body["search_after"])
        if r.start:
            raise Refused(("from", "from is 0 with search_after"))
        if len(r.after) != len(r.sort):
            raise Refused(("search_after", f"has {len(r.after)} values for {len(r.sort)} sort keys"))
    track = body.get("track_total", TRACK)
    r.track = track if isinstance(track, bool) else _count(track, "track_total", 1 << 31)
    if "fields" in body:
        if not isinstance(body["fields"], list) or len(body["fields"]) > MAX_FIELDS:
            raise Refused(("fields", f"at most {MAX_FIELDS} names"))
        r.fields = body["fields"]
    r.aggs = body.get("aggs", body.get("aggregations", {}))
    r.seq_no = bool(body.get("seq_no", False))
    inner = inner_specs(r.query if r.post_filter is None else q.All((r.query, r.post_filter)), mapping)
    if r.size * sum(s["size"] for s in inner.values()) > MAX_WINDOW:
        raise Refused(("size", f"size times the sizes of inner_hits is {MAX_WINDOW} at most"))
    return r


def _sorts(spec, mapping: Mapping, now_ms: int) -> list[Sort]:
    out = []
    for i, s in enumerate(spec if isinstance(spec, list) else [spec]):
        name, rest = (s, {}) if isinstance(s, str) else next(iter(s.items()))
        rest = {"order": rest} if isinstance(rest, str) else rest
        loc = f"sort.{i}"
        if set(rest) - {"order", "mode", "where"} or rest.get("order", "asc") not in ("asc", "desc"):
            raise Refused((loc, "a sort takes order (asc, desc), mode and where"))
        path, f = mapping.find(name)
        key = Sort(name, rest.get("order") == "desc", rest.get("mode"))
        if f and f.type in (LIST, POINT, NESTED) or path and f.type == BOOL:
            raise Refused((loc, f"{name!r} can't be sorted by"))
        if path:
            key.mode = key.mode or ("max" if key.desc else "min")
            if key.mode not in ("min", "max"):
                raise Refused((loc, "a mode is min or max"))
            if "where" in rest:
                node = q.parse(rest["where"], f"{loc}.where")
                q.validate(q.Nested(path, node), mapping, f"{loc}.where")
                key.where = q.resolve(node, mapping, now_ms)
        elif key.mode or "where" in rest:
            raise Refused((loc, "mode and where are for fields of a nested one"))
        if any(o.field == name for o in out):
            raise Refused((loc, f"{name!r} sorts once"))
        if out and out[-1].field == "_id":
            raise Refused((loc, "nothing sorts after _id"))
        out.append(key)
    if not out or out[-1].field != "_id":
        out.append(Sort("_id"))
    if len(out) > MAX_SORT + 1:
        raise Refused(("sort", f"at most {MAX_SORT} keys"))
    return out


def sort_value(s: Sort, mapping: Mapping) -> Column:
    """A document's key: null where it has none."""
    if s.field == "_id":
        return column("id")
    path, f = mapping.find(s.field)
    if not f:
        return F.lit(None).cast("double")
    part = {KEYWORD: "t", TEXT: "t", NUMBER: "n", DATE: "n", BOOL: "b"}[f.type]
    if not path:
        return column(f"{s.field}__{part}")
    sub = s.field[len(path) + 1 :]
    got = F.transform(object_filter(s.where, mapping, path), lambda o: o[f"{sub}__{part}"])
    return (F.array_min if s.mode == "min" else F.array_max)(F.filter(got, lambda v: v.isNotNull()))


def order(keys: list[tuple[Column, bool]]) -> list[Column]:
    return [c.desc_nulls_last() if desc else c.asc_nulls_last() for c, desc in keys]


def after(keys: list[tuple[Column, bool]], cursor: list) -> Column:
    """Rows that sort after the cursor, nulls last either way: at the first key that differs, later."""
    out, same = F.lit(False), F.lit(True)
    for (c, desc), v in zip(keys, cursor):
        later = F.lit(False) if v is None else (((c < F.lit(v)) if desc else (c > F.lit(v))) | c.isNull())
        out = out | (same & F.coalesce(later, F.lit(False)))
        same = same & c.eqNullSafe(F.lit(v))
    return out


def matching(docs: DataFrame, node, mapping: Mapping) -> DataFrame:
    return docs if node == q.EVERYTHING else docs.where(predicate(node, mapping))


def inner_specs(node, mapping: Mapping) -> dict:
    """Inner hits by key: path, the queries they stand for, size, fields. Nodes of a path that share a key are one."""
    found: dict = {}

    def walk(n):
        if isinstance(n, (q.All, q.Any)):
            for c in n.children:
                walk(c)
        elif isinstance(n, q.Nested) and n.inner:
            key = n.inner.name or n.path
            s = found.setdefault(key, {"path": n.path, "queries": [], "size": 0, "fields": [], "whole": False})
            if s["path"] != n.path:
                raise Refused(("query", f"two inner_hits of different paths are named {key!r}"))
            s["queries"].append(n.query)
            s["size"] = max(s["size"], n.inner.size)
            s["fields"] += [f for f in n.inner.fields if f not in s["fields"]]
            s["whole"] |= not n.inner.fields

    walk(node)
    return found


def inner_column(s: dict, mapping: Mapping) -> Column:
    """struct(total, offsets, objects): which members of the path hold, and the first of them."""
    node = q.Any(tuple(s["queries"]))
    every = q.EVERYTHING in s["queries"]
    with_place = F.transform(F.coalesce(column(f"{s['path']}__o"), F.array().cast(_objects(mapping, s["path"]))), lambda o, i: F.struct(i.alias("i"), o.alias("o")))
    hits = F.filter(with_place, lambda m: m["o"].isNotNull() & (F.lit(True) if every else predicate(node, mapping, True, s["path"], m["o"])))
    first = F.slice(hits, 1, s["size"]) if s["size"] else F.slice(hits, 1, 0)
    return F.struct(
        F.size(hits).cast("long").alias("total"),
        F.transform(first, lambda m: m["i"].cast("long")).alias("offsets"),
        F.transform(first, lambda m: m["o"]["__json"]).alias("objects"),
    )


def _objects(mapping: Mapping, path: str) -> T.ArrayType:
    return T.ArrayType(object_type(mapping.fields[path]))


def page(docs: DataFrame, r: Request, mapping: Mapping, body: bool = True) -> DataFrame:
    """The page of hits: id, sort keys s0.., seq, body and inner hits i0... Bodies are read for the page's rows: the
    top-k sees keys first and brings the rest along; with from, rows before the page are dropped after the top-k."""
    node = r.query if r.post_filter is None else q.All((*_parts(r.query), r.post_filter))
    hits = matching(docs, node, mapping)
    keys = [(sort_value(s, mapping), s.desc) for s in r.sort]
    if r.after is not None:
        hits = hits.where(after(keys, [_cursor(v, s, mapping) for v, s in zip(r.after, r.sort)]))
    inner = inner_specs(node, mapping)
    hits = hits.orderBy(*order(keys)).limit(r.start + r.size)
    if r.start:
        hits = hits.orderBy(*order(keys)).offset(r.start)
    cols = [column("id"), *[k.alias(f"s{i}") for i, (k, _) in enumerate(keys)], column("seq")]
    if body:
        cols.append(column("body"))
    return hits.select(*cols, *[inner_column(s, mapping).alias(f"i{i}") for i, s in enumerate(inner.values())])


def _parts(n):
    return n.children if isinstance(n, q.All) else (n,)


def _cursor(v, s: Sort, mapping: Mapping):
    if v is None and s.field == "_id":
        raise Refused(("search_after", "an id is never null"))
    f = None if s.field == "_id" else mapping.find(s.field)[1]
    if v is not None and f and f.type in (NUMBER, DATE):
        return float(v)
    return tx.normalize(v) if isinstance(v, str) and f else v


def total(docs: DataFrame, r: Request, mapping: Mapping) -> dict:
    """{value, relation}: exact, or exact up to a number."""
    node = r.query if r.post_filter is None else q.All((*_parts(r.query), r.post_filter))
    hits = matching(docs, node, mapping)
    if r.track is True:
        return {"value": hits.count(), "relation": "eq"}
    most = r.start + r.size if r.track is False else int(r.track)
    n = hits.limit(most + 1).count()
    return {"value": min(n, most), "relation": "gte" if n > most else "eq"}


def number(x):
    """A float as JSON writes it: whole numbers without a fraction."""
    return int(x) if isinstance(x, float) and x.is_integer() and abs(x) < 2**53 else x


def hits_of(rows: list, r: Request, inner: dict) -> list[dict]:
    out = []
    for row in rows:
        hit = {"id": row.id, "sort": [number(row[f"s{i}"]) for i in range(len(r.sort))]}
        if r.seq_no:
            hit["_seq"] = row.seq
        body = json.loads(row.body)
        hit["body"] = {k: v for k, v in body.items() if r.fields is None or k in r.fields}
        if inner:
            hit["inner_hits"] = {}
            for i, (key, s) in enumerate(inner.items()):
                got = row[f"i{i}"]
                objects = [json.loads(o) for o in got.objects]
                if s["fields"] and not s["whole"]:
                    objects = [{k: v for k, v in o.items() if k in s["fields"]} for o in objects]
                hit["inner_hits"][key] = {"total": got.total, "offsets": list(got.offsets), "objects": objects}
        out.append(hit)
    return out
