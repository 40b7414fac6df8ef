"""Aggregations: fifteen types, as data frames of buckets and as response objects.

All metrics of a scope, and of all buckets of an aggregation, are computed in one pass, but for exact percentiles, which
take passes of their own. Answers are those of one shard: exact, with an error bound of 0."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as tx
from quern.operators.compile import column, object_filter, predicate
from quern.operators.search import matching, number, order
from quern.operators.search import after as after_cursor
from quern.plans import datemath as dm
from quern.plans import query as q
from quern.plans.mapping import BOOL, DATE, KEYWORD, LIST, NUMBER, TEXT, Field, Mapping, Refused

METRICS = ("stats", "min", "max", "cardinality", "percentiles", "percentile_ranks", "top_metrics")
BUCKETS = ("terms", "range", "histogram", "date_histogram", "composite")
WRAPPERS = ("filter", "filters", "global")
MAX_AGGS, MAX_BUCKETS, MAX_SIZE = 100, 65_536, 65_536
PERCENTS = (1, 5, 25, 50, 75, 95, 99)
WIDE, NEAR, ACCURACY = 100_000, 0.002, 4_000  # exact percentiles: a large bucket's values, the cuts about a percent (seven standard errors of the sketch), the sketch
_RESERVED = {"filter": {"doc_count"}, "filters": {"doc_count"}, "global": {"doc_count"}}
_RESERVED_BUCKET = {"key", "key_as_string", "from", "to", "doc_count", "doc_count_error_upper_bound"}
_UNITS = {"ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000, "w": 604_800_000}
CALENDAR = {"minute": 60_000, "1m": 60_000, "hour": 3_600_000, "1h": 3_600_000, "day": 86_400_000, "1d": 86_400_000, "week": "week", "1w": "week", "month": "month", "1M": "month", "quarter": "quarter", "1q": "quarter", "year": "year", "1y": "year"}


@dataclass
class Agg:
    name: str
    type: str
    body: dict
    loc: str
    subs: list[Agg] = field(default_factory=list)


def parse(spec: dict, mapping: Mapping, now_ms: int, loc: str = "aggs", inside: str | None = None) -> list[Agg]:
    """Aggregations with their queries resolved, refused at their loc where a rule is broken."""
    out = []
    for name, s in spec.items():
        at = f"{loc}.{name}"
        kinds = [k for k in s if k not in ("aggs", "aggregations")]
        if len(kinds) != 1 or kinds[0] not in (*METRICS, *BUCKETS, *WRAPPERS):
            raise Refused((at, "an aggregation has one type, one of " + ", ".join((*METRICS, *BUCKETS, *WRAPPERS))))
        kind, subs = kinds[0], s.get("aggs", s.get("aggregations", {}))
        if inside in BUCKETS and kind not in METRICS and not (inside == "terms" and kind == "terms"):
            raise Refused((at, f"{kind} can't be under {inside}"))
        if inside in WRAPPERS and kind in (*WRAPPERS, "composite") or inside and kind == "global":
            raise Refused((at, f"{kind} can't be under {inside}"))
        if subs and kind in METRICS:
            raise Refused((at, f"{kind} holds no aggregations"))
        if name in (_RESERVED.get(inside, set()) if inside in WRAPPERS else _RESERVED_BUCKET if inside else set()):
            raise Refused((at, f"{name} is a member of the bucket"))
        a = Agg(name, kind, dict(s[kind]), f"{at}.{kind}")
        _check(a, mapping, now_ms, inside)
        a.subs = parse(subs, mapping, now_ms, f"{at}.aggs", kind)
        if kind == "terms":
            _check_nested_subs(a, mapping)
            a.body["order"] = _order(a, a.body.get("order"))
        out.append(a)
    if inside is None and _weight(out) > MAX_AGGS:
        raise Refused((loc, f"at most {MAX_AGGS} aggregations"))
    return out


def _weight(aggs: list[Agg]) -> int:
    n = 0
    for a in aggs:
        times = len(a.body["filters"]) + ("other_bucket_key" in a.body) if a.type == "filters" else 1
        n += 1 + times * _weight(a.subs)
    return n


def _field_of(a: Agg, mapping: Mapping, name: str, kinds: tuple) -> Field:
    path, f = (None, q.ID) if name == "_id" else mapping.find(name)
    if not f or f.type not in kinds:
        raise Refused((f"{a.loc}.field", f"{name!r} can't be aggregated by {a.type}"))
    if path and a.type not in ("terms", "stats", "min", "max", "cardinality", "percentiles", "percentile_ranks"):
        raise Refused((f"{a.loc}.field", f"{a.type} takes no nested sub-field"))
    if "where" in a.body and not path:
        raise Refused((f"{a.loc}.where", "where is for sub-fields of a nested field"))
    return f


_ANY, _NUM = (KEYWORD, TEXT, LIST, NUMBER, DATE, BOOL), (NUMBER, DATE)


def _whole(a: Agg, key: str, default: int, low: int, high: int) -> int:
    v = a.body.setdefault(key, default)
    if isinstance(v, bool) or not isinstance(v, int) or not low <= v <= high:
        raise Refused((f"{a.loc}.{key}", f"a whole number from {low} to {high}"))
    return v


def _check(a: Agg, mapping: Mapping, now_ms: int, inside: str | None) -> None:
    b = a.body
    allowed = {
        "terms": {"field", "size", "shard_size", "min_doc_count", "include", "exclude", "collect_mode", "order", "where"},
        "range": {"field", "ranges"},
        "histogram": {"field", "interval", "offset", "min_doc_count"},
        "date_histogram": {"field", "fixed_interval", "calendar_interval", "offset", "min_doc_count"},
        "composite": {"sources", "size", "after"},
        "stats": {"field", "where"},
        "min": {"field", "where"},
        "max": {"field", "where"},
        "cardinality": {"field", "where", "precision", "threshold", "mode"},
        "percentiles": {"field", "where", "percents", "keyed", "tdigest", "mode"},
        "percentile_ranks": {"field", "where", "values", "keyed", "tdigest"},
        "top_metrics": {"metrics", "sort", "size"},
        "filters": {"filters", "other_bucket_key"},
        "global": set(),
    }
    if a.type in allowed and (more := sorted(set(b) - allowed[a.type])):
        raise Refused(*[(f"{a.loc}.{k}", "unknown member") for k in more])
    if a.type == "filter":
        node = q.parse(b, a.loc)
        q.validate(node, mapping, a.loc, inner_ok=False)
        a.body = {"query": q.resolve(node, mapping, now_ms)}
    elif a.type == "filters":
        if not isinstance(b.get("filters"), dict) or not 1 <= len(b["filters"]) <= 100:
            raise Refused((f"{a.loc}.filters", "1 to 100 named filters"))
        done = {}
        for k, v in b["filters"].items():
            node = q.parse(v, f"{a.loc}.filters.{k}")
            q.validate(node, mapping, f"{a.loc}.filters.{k}", inner_ok=False)
            done[k] = q.resolve(node, mapping, now_ms)
        a.body = {**b, "filters": done}
    elif a.type == "terms":
        f = _field_of(a, mapping, b.get("field"), _ANY)
        _whole(a, "size", 10, 1, MAX_SIZE), _whole(a, "min_doc_count", 1, 1, 1 << 31)
        if b.get("collect_mode", "depth_first") not in ("depth_first", "breadth_first"):
            raise Refused((f"{a.loc}.collect_mode", "depth_first or breadth_first"))
        for key in ("include", "exclude"):
            if key in b:
                b[key] = _chosen(b[key], f, f"{a.loc}.{key}")
    elif a.type == "range":
        _field_of(a, mapping, b.get("field"), _NUM)
        if not isinstance(b.get("ranges"), list) or not 1 <= len(b["ranges"]) <= 100:
            raise Refused((f"{a.loc}.ranges", "1 to 100 ranges"))
    elif a.type == "histogram":
        _field_of(a, mapping, b.get("field"), _NUM)
        if not q.is_number(b.get("interval")) or b["interval"] <= 0:
            raise Refused((f"{a.loc}.interval", "an interval is above 0"))
        _whole(a, "min_doc_count", 0, 0, 1 << 31)
    elif a.type == "date_histogram":
        _field_of(a, mapping, b.get("field"), (DATE,))
        _date_interval(b, a.loc)
        _whole(a, "min_doc_count", 0, 0, 1 << 31)
    elif a.type == "composite":
        _whole(a, "size", 10, 1, 10_000)
        if not isinstance(b.get("sources"), list) or not 1 <= len(b["sources"]) <= 10:
            raise Refused((f"{a.loc}.sources", "1 to 10 sources"))
        for i, s in enumerate(b["sources"]):
            (_, body), = s.items()
            (kind, spec), = body.items()
            if kind not in ("terms", "histogram", "date_histogram"):
                raise Refused((f"{a.loc}.sources.{i}", "a source is terms, histogram or date_histogram"))
            _field_of(Agg("", kind, spec, f"{a.loc}.sources.{i}"), mapping, spec.get("field"), _ANY if kind == "terms" else _NUM)
            if kind == "date_histogram":
                _date_interval(spec, f"{a.loc}.sources.{i}")
    elif a.type == "top_metrics":
        _whole(a, "size", 1, 1, 10)
        m = b.get("metrics")
        b["metrics"] = [x["field"] for x in (m if isinstance(m, list) else [m] if m else [])]
        s = b.get("sort")
        s = s[0] if isinstance(s, list) and len(s) == 1 else s
        if not 1 <= len(b["metrics"]) <= 10 or not isinstance(s, (str, dict)):
            raise Refused((a.loc, "top_metrics needs 1 to 10 metrics and one sort"))
        name, way = (s, "asc") if isinstance(s, str) else next(iter(s.items()))
        way = way["order"] if isinstance(way, dict) else way
        _field_of(a, mapping, name, _NUM)
        for x in b["metrics"]:
            _field_of(a, mapping, x, (KEYWORD, TEXT, NUMBER, DATE, BOOL))
        b["sort"] = (name, way == "desc")
    elif a.type in METRICS:
        _field_of(a, mapping, b.get("field"), _ANY if a.type == "cardinality" else _NUM)
        for key, n in (("percents", PERCENTS), ("values", None)):
            if a.type == ("percentiles" if key == "percents" else "percentile_ranks"):
                got = b.setdefault(key, list(n) if n else None)
                if not isinstance(got, list) or not 1 <= len(got) <= 100 or len(set(got)) < len(got) or not all(map(q.is_number, got)) or key == "percents" and not all(0 <= p <= 100 for p in got):
                    raise Refused((f"{a.loc}.{key}", f"1 to 100 {key}, none twice"))
        if not 10 <= b.get("tdigest", {}).get("compression", 100) <= 1000:
            raise Refused((f"{a.loc}.tdigest.compression", "10 to 1000"))
        if not 4 <= b.get("precision", 14) <= 18 or not 1 <= b.get("threshold", 1) <= 65_536 or {"precision", "threshold"} <= set(b):
            raise Refused((a.loc, "precision 4 to 18, or threshold 1 to 65536"))
        if b.get("mode", "exact") not in ("exact", "sketch"):
            raise Refused((f"{a.loc}.mode", "exact or sketch"))
    if "where" in b and a.type not in WRAPPERS:
        path, _ = mapping.find(b["field"])
        node = q.parse(b["where"], f"{a.loc}.where")
        q.validate(q.Nested(path, node), mapping, f"{a.loc}.where", inner_ok=False)
        b["where"] = q.resolve(node, mapping, now_ms)
    if inside == "terms" and a.type == "terms" and not mapping.find(b["field"])[0]:
        raise Refused((a.loc, "terms under terms is for sub-fields of the same nested field"))


def _check_nested_subs(a: Agg, mapping: Mapping) -> None:
    path = mapping.find(a.body["field"])[0]
    for s in a.subs:
        sub = mapping.find(s.body["field"])[0] if "field" in s.body else None
        if sub and sub != path or s.type == "terms" and not path or path and s.type == "top_metrics" or s.type == "terms" and s.subs:
            raise Refused((s.loc, f"{s.type} can't be under {a.body['field']!r}"))


def _date_interval(b: dict, loc: str):
    """("fixed", ms) or ("calendar", unit), and the offset in ms."""
    off = b.get("offset", 0)
    if isinstance(off, str):
        m = re.fullmatch(r"([+-]?)(\d+)(ms|s|m|h|d|w)", off)
        if not m:
            raise Refused((f"{loc}.offset", "an offset is as +6h"))
        off = int(m[2]) * _UNITS[m[3]] * (-1 if m[1] == "-" else 1)
    if ("fixed_interval" in b) == ("calendar_interval" in b):
        raise Refused((loc, "fixed_interval or calendar_interval"))
    if "fixed_interval" in b:
        m = re.fullmatch(r"(\d+)(ms|s|m|h|d|w)", str(b["fixed_interval"]))
        if not m or not int(m[1]):
            raise Refused((f"{loc}.fixed_interval", "a fixed interval is as 7d"))
        return ("fixed", int(m[1]) * _UNITS[m[2]]), off
    unit = CALENDAR.get(b["calendar_interval"])
    if not unit:
        raise Refused((f"{loc}.calendar_interval", "minute, hour, day, week, month, quarter or year"))
    return (("fixed", unit) if isinstance(unit, int) else ("calendar", unit)), off


_SPECIAL = re.compile(r"[~&<>@#^$]")


def _chosen(v, f: Field, loc: str):
    """include or exclude: a list of keys, or an anchored pattern over the folded key."""
    if isinstance(v, list):
        if len(v) > 1000:
            raise Refused((loc, "at most 1000 values"))
        if f.type == NUMBER:
            return [float(x) for x in v if q.is_number(x)]
        if f.type == DATE:
            return [x for x in (tx.as_date(x) for x in v) if x is not None]
        if f.type == BOOL:
            return [x if isinstance(x, bool) else {"true": True, "false": False}[x] for x in v]
        return [tx.as_text(x) for x in v]
    if not isinstance(v, str) or len(v) > 1000 or f.type in (NUMBER, DATE, BOOL):
        raise Refused((loc, "a list of values, or a pattern of at most 1000 characters on a text field"))
    return {"pattern": _pattern(v, loc)}


def _pattern(p: str, loc: str) -> str:
    """The pattern in Java's syntax, its literals folded as keys are."""
    out, i, gap = [], 0, False
    while i < len(p):
        c = p[i]
        if c == "\\":
            if i + 1 >= len(p) or p[i + 1].isalnum():
                raise Refused((loc, f"at {i}: \\ stands before punctuation"))
            out.append(re.escape(p[i + 1]))
            i += 2
        elif c == '"':
            end = p.find('"', i + 1)
            if end < 0:
                raise Refused((loc, f"at {i}: the quote doesn't end"))
            out.append("".join(re.escape(x) for x in p[i + 1 : end].casefold()))
            i = end + 1
        elif c == "[":
            end = p.find("]", i + 2)
            if end < 0:
                raise Refused((loc, f"at {i}: the class doesn't end"))
            inner = p[i + 1 : end]
            neg = inner.startswith("^")
            members = inner[neg:]
            if any(len(x.casefold()) > 1 for x in members) or neg and members.casefold() != members:
                raise Refused((loc, f"at {i}: the class can't be folded"))
            folded = members if members.casefold() == members else members + members.casefold()
            out.append("[" + "^" * neg + folded.replace("[", r"\[").replace("&", r"\&") + "]")
            i = end + 1
        elif _SPECIAL.match(c):
            raise Refused((loc, f"at {i}: {c} is not taken"))
        elif c.isspace():
            while i < len(p) and p[i].isspace():
                i += 1
            gap = bool(out) and i < len(p)
            out.append(" " if gap else "")
        else:
            folded = c.casefold()
            out.append(folded if c in ".*+?{}()|," else f"(?:{folded})" if len(folded) > 1 else re.escape(c.casefold()))
            i += 1
    pattern = "".join(out)
    try:
        re.compile(pattern)
    except re.error as e:
        raise Refused((loc, str(e))) from None
    return f"^(?s:{pattern})$"


def _order(a: Agg, spec) -> list[tuple[str, str | None, bool]]:
    """Keys of a terms order as (name, member, descending)."""
    keys = spec if isinstance(spec, list) else [spec] if spec else [{"_count": "desc"}]
    if len(keys) > 8:
        raise Refused((f"{a.loc}.order", "at most 8 keys"))
    out, subs = [], {s.name: s for s in a.subs}
    for k in keys:
        (name, way), = k.items()
        if name in ("_count", "_key"):
            out.append((name, None, way == "desc"))
            continue
        sub, member = next(((s, name[len(s) :].strip(".[]")) for s in sorted(subs, key=len, reverse=True) if name == s or name.startswith((s + ".", s + "["))), (None, ""))
        if sub is None or subs[sub].type == "terms":
            raise Refused((f"{a.loc}.order", f"{name!r} is no metric of this terms"))
        if subs[sub].type == "stats" and member not in ("count", "min", "max", "avg", "sum"):
            raise Refused((f"{a.loc}.order", f"{name!r}: stats has count, min, max, avg and sum"))
        if subs[sub].type in ("percentiles", "percentile_ranks") and float(member or "nan") not in [float(x) for x in subs[sub].body.get("percents", subs[sub].body.get("values"))]:
            raise Refused((f"{a.loc}.order", f"{name!r} is not asked for"))
        out.append((sub, member or "value", way == "desc"))
    if not any(k[0] == "_key" for k in out):
        out.append(("_key", None, False))
    return out


# --- values and metrics -------------------------------------------------------------------------------------------


def value(name: str, mapping: Mapping, obj: Column | None = None, path: str | None = None) -> Column:
    """A document's (or object's) comparable value; of a list its array."""
    f = q.ID if name == "_id" else mapping.find(name)[1]
    part = {KEYWORD: "t", TEXT: "t", NUMBER: "n", DATE: "n", BOOL: "b", LIST: "e"}[f.type]
    if obj is not None:
        return obj[f"{name[len(path) + 1 :]}__{part}"]
    return column("_id__t") if name == "_id" else column(f"{name}__{part}")


def sketched(v: Column, at: list[float], k: int) -> Column:
    """Values about the ranks at, of a sketch that is merged in time that grows with the number of sketches (percentile_approx: with its square); null without values."""
    return F.when(F.count(v) > 0, F.kll_sketch_get_quantile_double(F.kll_sketch_agg_double(v, F.lit(min(max(k, 8), 65_535))), F.array(*map(F.lit, at))))


def metric_columns(a: Agg, v: Column, whole: bool = False) -> dict[str, Column]:
    """Aggregate columns of one metric over the value column v; whole: of a scope, not of each of many buckets."""
    b = a.body
    if a.type == "stats":
        return {"count": F.count(v), "min": F.min(v), "max": F.max(v), "avg": F.avg(v), "sum": F.coalesce(F.sum(v), F.lit(0.0))}
    if a.type in ("min", "max"):
        return {"value": (F.min if a.type == "min" else F.max)(v)}
    if a.type == "cardinality":
        if b.get("mode") == "sketch":  # bounded memory however many values there are
            return {"value": F.hll_sketch_estimate(F.hll_sketch_agg(v.cast("string"), b.get("precision", 14)))}
        n = F.count_distinct(v)
        return {"value": F.least(n, F.lit(b["threshold"])) if "threshold" in b else n}
    if a.type == "percentiles":
        at, c = [p / 100 for p in sorted(float(p) for p in b["percents"])], b.get("tdigest", {}).get("compression", 100)
        # exact: percentiles; a bucket has a sketch that begins small
        return {"values": sketched(v, at, int(40 * c)) if whole else F.percentile_approx(v, F.array(*map(F.lit, at)), 100 * c)}
    if a.type == "percentile_ranks":
        n = F.count(v)
        return {f"r{i}": F.when(n > 0, (F.count_if(v < x) + F.count_if(v == x) * 0.5) / n * 100) for i, x in enumerate(sorted(float(x) for x in b["values"]))}
    raise AssertionError(a.type)


def java_double(x: float) -> str:
    """As Java writes a double."""
    if x == 0 or 1e-3 <= abs(x) < 1e7:
        return repr(float(x))
    m, _, e = f"{x!r}".partition("e")
    if not e:
        digits = f"{x:.17e}"
        m, _, e = repr(float(x / 10 ** int(digits.partition("e")[2]))), "", digits.partition("e")[2]
    return f"{m if '.' in m else m + '.0'}E{int(e)}"


def metric_json(a: Agg, row, prefix: str) -> dict:
    g = lambda k: number(row[f"{prefix}{k}"])
    if a.type == "stats":
        return {k: g(k) for k in ("count", "min", "max", "avg", "sum")}
    if a.type in ("min", "max", "cardinality"):
        return {"value": g("value")}
    if a.type == "top_metrics":
        return {"top": [{"sort": [number(t.sort)], "metrics": {m: number(t[f"m{i}"]) for i, m in enumerate(a.body["metrics"])}} for t in row[f"{prefix}top"] or []]}
    if a.type == "percentiles":
        keys = sorted(float(p) for p in a.body["percents"])
        got = row[f"{prefix}values"] or [None] * len(keys)
    else:
        keys = sorted(float(x) for x in a.body["values"])
        got = [row[f"{prefix}r{i}"] for i in range(len(keys))]
    if a.body.get("keyed", True):
        return {"values": {java_double(k): number(v) for k, v in zip(keys, got)}}
    return {"values": [{"key": number(k), "value": number(v)} for k, v in zip(keys, got)]}


def _top_columns(a: Agg, mapping: Mapping) -> dict[str, Column]:
    """top_metrics of size 1 as an aggregate: the document first by (missing last, the sort, id)."""
    name, desc = a.body["sort"]
    s = value(name, mapping)
    row = F.struct(s.alias("sort"), *[value(m, mapping).alias(f"m{i}") for i, m in enumerate(a.body["metrics"])])
    return {"top": F.array(F.min_by(row, F.struct(s.isNull(), -s if desc else s, column("id"))))}


def _ranked(a: Agg) -> bool:
    """Whether its values are found by their ranks: exact percentiles, which are no aggregate column."""
    return a.type == "percentiles" and a.body.get("mode") != "sketch"


def aggregate_columns(subs: list[Agg], mapping: Mapping, obj: Column | None = None, path: str | None = None, whole: bool = False) -> list[Column]:
    out = []
    for a in subs:
        if _ranked(a):
            continue
        if a.type == "top_metrics":
            cols = _top_columns(a, mapping) if a.body["size"] == 1 else {}
        else:
            v = value(a.body["field"], mapping, obj, path)
            f = mapping.find(a.body["field"])[1]
            cols = metric_columns(a, v, whole) if not (f and f.type == LIST) else {"value": F.size(F.array_distinct(F.flatten(F.collect_set(v))))}
        out += [c.alias(f"{a.name}/{k}") for k, c in cols.items()]
    return out


def aggregate(df: DataFrame, by: list[str], subs: list[Agg], mapping: Mapping, obj: Column | None = None, path: str | None = None, more: tuple[Column, ...] = ()) -> DataFrame:
    """(by, more, metrics) by the columns by, which hold no null; without by one row."""
    cols = [*more, *aggregate_columns(subs, mapping, obj, path, not by)]
    out = df.groupBy(*by).agg(*cols) if cols else df.select(*by).distinct() if by else None
    for a in filter(_ranked, subs):
        got = percentiles(df.select(*by, value(a.body["field"], mapping, obj, path).alias("v")), by, a.body["percents"]).withColumnRenamed("values", f"{a.name}/values")
        out = got if out is None else out.join(got, by, "left") if by else out.crossJoin(F.broadcast(got))
    return out


def percentiles(df: DataFrame, by: list[str], percents: list) -> DataFrame:
    """(by, values): the exact percentiles of v, without a task that holds the values of a large bucket.

    Sketched percentiles on both sides of each one that is wanted cut a bucket's values into parts; the parts are counted,
    and only those that hold a wanted rank are sorted. Where a sketch is off, a part is larger and the answer the same.
    Buckets of up to WIDE values are aggregated whole. Without by there is one row, of null where no value is.
    The cuts are fetched here, once: a sketch that is made twice has other values, and the parts would not be those counted."""
    ps = [p / 100 for p in sorted(float(p) for p in percents)]
    df = df.where(F.col("v").isNotNull())
    ends = sorted({min(max(p + d, 0.0), 1.0) for p in ps for d in (-NEAR, NEAR)})
    beside = lambda left, right, on, how="inner": left.join(F.broadcast(right), on, how) if on else left.crossJoin(F.broadcast(right))
    large = beside(df, df.groupBy(*by).agg(F.count("v").alias("n")).where(F.col("n") > WIDE).drop("n"), by, "left_semi") if by else df
    cuts = large.groupBy(*by).agg(sketched(F.col("v"), ends, ACCURACY).alias("cuts")).where(F.col("cuts").isNotNull())
    wide = df.sparkSession.createDataFrame(cuts.collect(), cuts.schema)

    # a value's part is the number of cuts up to it, counted over every step-th of them and then within a step
    step = math.ceil(math.sqrt(len(ends)))
    up_to = lambda places: sum((F.when(F.col("v") >= F.get("cuts", i), 1).otherwise(0) for i in places), F.lit(0))
    parted = beside(df, wide, by).withColumn("steps", up_to(F.lit(i) for i in range(step - 1, len(ends), step)) * step)
    parted = parted.select(*by, "v", (F.col("steps") + up_to(F.col("steps") + i for i in range(step - 1))).alias("part"))

    # parts with the ranks in them: of each percent the one below its position and the one above
    at = F.transform(F.array(*map(F.lit, ps)), lambda p: (F.col("n") - 1) * p)
    ranks = F.transform(F.flatten(F.transform(at, lambda x: F.array(F.floor(x), F.ceil(x)))), lambda r, i: F.struct(i.alias("i"), r.alias("r")))
    whole = Window.partitionBy(*by or [F.lit(0)])
    parts = parted.groupBy(*by, "part").agg(F.count("v").alias("m"))
    parts = parts.withColumns({"n": F.sum("m").over(whole), "before": F.sum("m").over(whole.orderBy("part")) - F.col("m")})
    held = F.filter("ranks", lambda x: (x["r"] >= F.col("before")) & (x["r"] < F.col("before") + F.col("m")))
    wanted = parts.withColumn("ranks", ranks).withColumn("ranks", held).where(F.size("ranks") > 0).drop("m")

    near = beside(parted, wanted.select(*by, "part"), [*by, "part"], "left_semi").groupBy(*by, "part", "v").agg(F.count("v").alias("c"))
    near = near.withColumn("upto", F.sum("c").over(Window.partitionBy(*by, "part").orderBy("v")))
    near = beside(near, wanted, [*by, "part"]).withColumn("end", F.col("before") + F.col("upto"))
    hits = near.select(*by, "n", "v", F.explode(F.filter("ranks", lambda x: (x["r"] >= F.col("end") - F.col("c")) & (x["r"] < F.col("end")))).alias("rank"))
    found = hits.groupBy(*by).agg(F.max("n").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("rank.i", "v"))), lambda x: x["v"]).alias("got"))
    between = lambda x, lo, hi: F.when(lo == hi, lo).otherwise((F.ceil(x) - x) * lo + (x - F.floor(x)) * hi)
    values = F.transform(at, lambda x, i: between(x, F.get("got", 2 * i), F.get("got", 2 * i + 1)))
    out = found.select(*by, F.when(F.col("n").isNotNull(), values).alias("values"))
    if not by:
        return out
    return out.unionByName(beside(df, wide.select(*by), by, "left_anti").groupBy(*by).agg(F.percentile("v", F.array(*map(F.lit, ps))).alias("values")))


def top_of(df: DataFrame, a: Agg, mapping: Mapping, by: list[str]) -> DataFrame:
    """(by, top): the first size documents of each bucket, by a ranked window that Spark cuts before its shuffle."""
    name, desc = a.body["sort"]
    s = value(name, mapping)
    keys = order([(s, desc), (column("id"), False)])
    got = df.withColumn("__row", F.row_number().over(Window.partitionBy(*by).orderBy(*keys))).where(F.col("__row") <= a.body["size"])
    row = F.struct(F.col("__row"), s.alias("sort"), *[value(m, mapping).alias(f"m{i}") for i, m in enumerate(a.body["metrics"])])
    return got.groupBy(*by).agg(F.array_sort(F.collect_list(row)).alias(f"{a.name}/top"))


# --- buckets ------------------------------------------------------------------------------------------------------


def chosen(v: Column, b: dict) -> Column:
    """Whether a key is included and not excluded."""
    out = F.lit(True)
    for key in ("include", "exclude"):
        if key in b:
            x = b[key]
            hit = v.rlike(x["pattern"]) if isinstance(x, dict) else v.isin(x) if x else F.lit(False)
            out = out & (hit if key == "include" else ~hit)
    return out


def histogram_key(a_type: str, b: dict, v: Column, loc: str = "") -> Column:
    if a_type == "histogram":
        step, off = float(b["interval"]), float(b.get("offset", 0))
        return F.floor((v - off) / step).cast("double") * step + off + F.lit(0.0)
    (kind, unit), off = _date_interval(b, loc)
    if kind == "fixed":
        return F.floor((v - off) / unit).cast("double") * unit + float(off)
    at = F.date_trunc(unit, F.timestamp_millis(F.floor(v - off).cast("long")))
    return F.unix_millis(at).cast("double") + float(off)


def _bucketed(df: DataFrame, key: Column, subs: list[Agg], mapping: Mapping, obj=None, path=None) -> DataFrame:
    """(key, doc_count, sub-metrics) by key."""
    df = df.withColumn("key", key).where(F.col("key").isNotNull())
    out = aggregate(df, ["key"], subs, mapping, obj, path, (F.count(F.lit(1)).alias("doc_count"),))
    for a in subs:
        if a.type == "top_metrics" and a.body["size"] > 1:
            out = out.join(top_of(df, a, mapping, ["key"]), "key")
    return out


def terms_frame(df: DataFrame, a: Agg, mapping: Mapping) -> DataFrame:
    """All buckets of a terms: key, doc_count and metrics, before order and size."""
    name, b = a.body["field"], a.body
    path, f = (None, q.ID) if name == "_id" else mapping.find(name)
    if path:
        sub = name[len(path) + 1 :]
        part = {KEYWORD: "t", TEXT: "t", NUMBER: "n", DATE: "n", BOOL: "b", LIST: "e"}[f.type]
        o = df.withColumn("__o", F.explode(object_filter(b.get("where"), mapping, path)))
        v = F.col("__o")[f"{sub}__{part}"]
        o = o.withColumn("key", F.explode(v) if f.type == LIST else v).where(F.col("key").isNotNull()).where(chosen(F.col("key"), b))
        own = [s for s in a.subs if s.type != "terms" and mapping.find(s.body["field"])[0]]
        docs = [s for s in a.subs if s.type != "terms" and not mapping.find(s.body["field"])[0]]
        out = aggregate(o.dropDuplicates(["id", "key"]), ["key"], docs, mapping, more=(F.count(F.lit(1)).alias("doc_count"),))
        for s in own:  # objects holding the value, narrowed by the sub-aggregation's own where
            w = s.body.get("where")
            x = o if w is None else o.where(predicate(w, mapping, True, path, F.col("__o")))
            out = out.join(aggregate(x, ["key"], [s], mapping, F.col("__o"), path), "key", "left")
        return out
    v = value(name, mapping)
    if f.type == LIST:
        return _bucketed(df.withColumn("__e", F.explode(v)).where(chosen(F.col("__e"), b)), F.col("__e"), a.subs, mapping)
    return _bucketed(df.where(v.isNotNull()).where(chosen(v, b)), v, a.subs, mapping)


def _order_columns(a: Agg) -> list[Column]:
    out, subs = [], {s.name: s for s in a.subs}
    for name, member, desc in a.body["order"]:
        if name in ("_count", "_key"):
            c = F.col("doc_count" if name == "_count" else "key")
        else:
            s = subs[name]
            if s.type in ("percentiles", "percentile_ranks"):
                asked = sorted(float(x) for x in s.body.get("percents", s.body.get("values")))
                i = asked.index(float(member))
                c = F.get(F.col(f"`{name}/values`"), F.lit(i)) if s.type == "percentiles" else F.col(f"`{name}/r{i}`")
            elif s.type == "top_metrics":
                c = F.get(F.col(f"`{name}/top`"), F.lit(0))[f"m{s.body['metrics'].index(member)}"]
            else:
                c = F.col(f"`{name}/{member}`")
        out.append(c.desc_nulls_last() if desc else c.asc_nulls_last())
    return out


def terms_top(df: DataFrame, a: Agg, mapping: Mapping) -> DataFrame:
    """The buckets of the answer, in order."""
    return terms_frame(df, a, mapping).where(F.col("doc_count") >= a.body["min_doc_count"]).orderBy(*_order_columns(a)).limit(a.body["size"])


def range_frame(df: DataFrame, a: Agg, mapping: Mapping) -> DataFrame:
    """(key = number of the range, doc_count, metrics); ranges may overlap, so a value goes to each that holds it."""
    v = value(a.body["field"], mapping)
    tests = []
    for i, r in enumerate(a.body["ranges"]):
        c = v.isNotNull()
        if r.get("from") is not None:
            c = c & (v >= float(r["from"]))
        if r.get("to") is not None:
            c = c & (v < float(r["to"]))
        tests.append(F.when(c, F.lit(i)))
    return _bucketed(df.withColumn("__r", F.explode(F.array_compact(F.array(*tests)))), F.col("__r"), a.subs, mapping)


def histogram_frame(df: DataFrame, a: Agg, mapping: Mapping) -> DataFrame:
    v = value(a.body["field"], mapping)
    return _bucketed(df.where(v.isNotNull()), histogram_key(a.type, a.body, v, a.loc), a.subs, mapping)


def composite_frame(df: DataFrame, a: Agg, mapping: Mapping) -> DataFrame:
    """(one column k0.. per source, doc_count, metrics): the page after the cursor. A document is once in a bucket."""
    keys, ways = [], []
    for i, s in enumerate(a.body["sources"]):
        (_, body), = s.items()
        (kind, spec), = body.items()
        v = value(spec["field"], mapping)
        f = q.ID if spec["field"] == "_id" else mapping.find(spec["field"])[1]
        df = df.withColumn(f"k{i}", F.explode(v) if f.type == LIST else v if kind == "terms" else histogram_key(kind, spec, v, a.loc))
        df = df.where(F.col(f"k{i}").isNotNull())
        keys.append(f"k{i}")
        ways.append((F.col(f"k{i}"), spec.get("order") == "desc"))
    cursor = a.body.get("after")
    if cursor is not None:
        got = []
        for (col, _), s in zip(ways, a.body["sources"]):
            v = cursor[next(iter(s))]
            got.append(float(v) if q.is_number(v) else v)
        df = df.where(after_cursor(ways, got))
    out = aggregate(df, keys, a.subs, mapping, more=(F.count(F.lit(1)).alias("doc_count"),))
    for s in a.subs:
        if s.type == "top_metrics" and s.body["size"] > 1:
            out = out.join(top_of(df, s, mapping, keys), keys)
    return out.orderBy(*order(ways)).limit(a.body["size"])


# --- answers ------------------------------------------------------------------------------------------------------


def _subs(a: Agg, row) -> dict:
    return {s.name: metric_json(s, row, f"{s.name}/") for s in a.subs if s.type != "terms"}


def run(df: DataFrame, every: DataFrame, aggs: list[Agg], mapping: Mapping, room: list[int] | None = None) -> dict:
    """Answers of all aggregations over the hits df; every: all live documents, for global."""
    room = room if room is not None else [MAX_BUCKETS]
    out: dict = {}
    plain = [a for a in aggs if a.type in METRICS and not mapping.find(a.body.get("field", ""))[0] and not (a.type == "top_metrics" and a.body["size"] > 1)]
    filters = [a for a in aggs if a.type == "filter"]
    # a distinct count groups by its values first, where sketches would hold a buffer for each value
    heavy = any(a.body.get("mode") == "sketch" for a in plain)
    alone = [a for a in plain if heavy and a.type == "cardinality" and a.body.get("mode") != "sketch"]
    # distinct entries of lists are counted over rows of entries: no task holds them all
    lists = [a for a in plain if a.type == "cardinality" and a.body["field"] in mapping.fields and mapping.fields[a.body["field"]].type == LIST]
    alone = [a for a in alone if a not in lists]
    plain = [a for a in plain if a not in alone and a not in lists]
    for a in lists:
        entries = df.select(F.explode(value(a.body["field"], mapping)).alias("v"))
        out[a.name] = metric_json(a, entries.agg(*[c.alias(f"{a.name}/{k}") for k, c in metric_columns(a, F.col("v")).items()]).first(), f"{a.name}/")
    if plain or filters:  # one pass for all metrics and filter counts
        counts = [F.count_if(predicate(a.body["query"], mapping, True)).alias(f"{a.name}/n") for a in filters]
        row = aggregate(df, [], plain, mapping, more=tuple(counts)).first()
        for a in plain:
            out[a.name] = metric_json(a, row, f"{a.name}/")
        for a in filters:
            _spend(room, 1, a)
            out[a.name] = {"doc_count": row[f"{a.name}/n"], **run(matching(df, a.body["query"], mapping), every, a.subs, mapping, room)}
    for a in alone:
        out[a.name] = metric_json(a, aggregate(df, [], [a], mapping).first(), f"{a.name}/")
    for a in sorted(aggs, key=lambda a: a.name):
        if a.name in out:
            continue
        if a.type == "top_metrics":
            row = top_of(df.withColumn("__all", F.lit(1)), a, mapping, ["__all"]).first()
            out[a.name] = metric_json(a, row, f"{a.name}/") if row else {"top": []}
        elif a.type in METRICS:
            path = mapping.find(a.body["field"])[0]
            o = df.select(F.explode(object_filter(a.body.get("where"), mapping, path)).alias("__o"))
            out[a.name] = metric_json(a, aggregate(o, [], [a], mapping, F.col("__o"), path).first(), f"{a.name}/")
        elif a.type == "terms":
            out[a.name] = _terms_answer(df, a, mapping, room)
        elif a.type == "range":
            got = {r.key: r for r in range_frame(df, a, mapping).collect()}
            blank = aggregate(df.limit(0), [], a.subs, mapping).first() if a.subs else None
            out[a.name] = {"buckets": [_range_bucket(a, r, got.get(i), blank) for i, r in enumerate(a.body["ranges"])]}
            _spend(room, len(a.body["ranges"]), a)
        elif a.type in ("histogram", "date_histogram"):
            out[a.name] = _histogram_answer(df, a, mapping, room)
        elif a.type == "composite":
            rows = composite_frame(df, a, mapping).collect()
            _spend(room, len(rows), a)
            names = [next(iter(s)) for s in a.body["sources"]]
            buckets = [{"key": {n: number(r[f"k{i}"]) for i, n in enumerate(names)}, "doc_count": r.doc_count, **_subs(a, r)} for r in rows]
            out[a.name] = {**({"after_key": buckets[-1]["key"]} if buckets else {}), "buckets": buckets}
        elif a.type == "global":
            _spend(room, 1, a)
            out[a.name] = {"doc_count": every.count(), **run(every, every, a.subs, mapping, room)}
        else:  # filters
            keys = a.body["filters"]
            tests = {k: predicate(n, mapping, True) for k, n in keys.items()}
            other = ~_any(list(tests.values()))
            names = {**tests, **({a.body["other_bucket_key"]: other} if "other_bucket_key" in a.body else {})}
            row = df.agg(*[F.count_if(c).alias(f"n{i}") for i, c in enumerate(names.values())]).first()
            _spend(room, len(names), a)
            out[a.name] = {"buckets": {k: {"doc_count": row[f"n{i}"], **(run(df.where(names[k]), every, a.subs, mapping, room) if a.subs else {})} for i, k in sorted(enumerate(names), key=lambda x: x[1])}}
    return {a.name: out[a.name] for a in aggs}


def _any(parts: list[Column]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | p
    return out


def _spend(room: list[int], n: int, a: Agg) -> None:
    room[0] -= n
    if room[0] < 0:
        raise Refused((a.loc, f"more than {MAX_BUCKETS} buckets: widen the interval, lower the size or narrow the query"))


def _terms_answer(df: DataFrame, a: Agg, mapping: Mapping, room: list[int]) -> dict:
    frame = terms_frame(df, a, mapping)
    rows = frame.where(F.col("doc_count") >= a.body["min_doc_count"]).orderBy(*_order_columns(a)).limit(a.body["size"]).collect()
    _spend(room, len(rows), a)
    other = 0
    if len(rows) == a.body["size"] or a.body["min_doc_count"] > 1:
        bare = Agg(a.name, a.type, a.body, a.loc)
        other = (terms_frame(df, bare, mapping).agg(F.sum("doc_count")).first()[0] or 0) - sum(r.doc_count for r in rows)
    buckets = [{"key": number(r.key), "doc_count": r.doc_count, **_subs(a, r)} for r in rows]
    for s in (s for s in a.subs if s.type == "terms"):
        found = _terms_under(df, a, s, [r.key for r in rows], mapping) if rows else {}
        for b, r in zip(buckets, rows):
            b[s.name] = found.get(r.key, {"doc_count_error_upper_bound": 0, "sum_other_doc_count": 0, "buckets": []})
            _spend(room, len(b[s.name]["buckets"]), s)
    return {"doc_count_error_upper_bound": 0, "sum_other_doc_count": other, "buckets": buckets}


def _terms_under(df: DataFrame, a: Agg, s: Agg, keys: list, mapping: Mapping) -> dict:
    """Of each key of a nested terms a the terms s of the objects that hold it, all in one job."""
    path = mapping.find(a.body["field"])[0]
    wheres = [w for w in (a.body.get("where"), s.body.get("where")) if w is not None]
    o = df.select("id", F.explode(object_filter(q.All(tuple(wheres)) if wheres else None, mapping, path)).alias("__o"))
    for name, field in (("__outer", a.body["field"]), ("key", s.body["field"])):
        v = value(field, mapping, F.col("__o"), path)
        o = o.withColumn(name, F.explode(v) if mapping.find(field)[1].type == LIST else v)
    o = o.where(F.col("__outer").isin(keys) & F.col("key").isNotNull() & chosen(F.col("key"), s.body))
    each = o.dropDuplicates(["id", "__outer", "key"]).groupBy("__outer", "key").agg(F.count(F.lit(1)).alias("doc_count"))
    enough, size = F.col("doc_count") >= s.body["min_doc_count"], s.body["size"]
    whole = Window.partitionBy("__outer")
    each = each.withColumns({"__all": F.sum("doc_count").over(whole), "__rank": F.row_number().over(whole.orderBy(enough.desc(), *_order_columns(s)))})
    out: dict = {}
    for r in each.where(F.col("__rank") <= size).orderBy("__outer", "__rank").collect():
        got = out.setdefault(r["__outer"], {"doc_count_error_upper_bound": 0, "sum_other_doc_count": r["__all"], "buckets": []})
        if r.doc_count >= s.body["min_doc_count"]:
            got["buckets"].append({"key": number(r.key), "doc_count": r.doc_count})
            got["sum_other_doc_count"] -= r.doc_count
    return out


def _range_bucket(a: Agg, r: dict, row, blank) -> dict:
    lo, hi = r.get("from"), r.get("to")
    name = r.get("key") or f"{'*' if lo is None else java_double(float(lo))}-{'*' if hi is None else java_double(float(hi))}"
    out = {"key": name}
    if lo is not None:
        out["from"] = lo
    if hi is not None:
        out["to"] = hi
    subs = _subs(a, row) if row else {s.name: {"top": []} if s.type == "top_metrics" else metric_json(s, blank, f"{s.name}/") for s in a.subs}
    return {**out, "doc_count": row.doc_count if row else 0, **subs}


def calendar_next(ms: int, unit: str) -> int:
    return ms + 604_800_000 if unit == "week" else dm.add_months(ms, {"month": 1, "quarter": 3, "year": 12}[unit])


def _histogram_answer(df: DataFrame, a: Agg, mapping: Mapping, room: list[int]) -> dict:
    least = a.body["min_doc_count"]
    rows = histogram_frame(df, a, mapping).where(F.col("doc_count") >= max(least, 1)).orderBy("key").limit(room[0] + 1).collect()
    _spend(room, len(rows), a)
    out, got = {}, {r.key: r for r in rows}
    keys = [r.key for r in rows]
    if least == 0 and len(rows) > 1:
        keys, cut = _filled(a, keys, room[0] + len(rows))
        if cut:
            out["truncated"] = True
        room[0] -= len(keys) - len(rows)
    blank = aggregate(df.limit(0), [], a.subs, mapping).first() if a.subs and len(keys) > len(rows) else None
    buckets = []
    for k in keys:
        r = got.get(k)
        b = {"key": number(k)}
        if a.type == "date_histogram":
            b["key_as_string"] = dm.iso(k)
        b["doc_count"] = r.doc_count if r else 0
        b |= _subs(a, r) if r else {s.name: {"top": []} if s.type == "top_metrics" else metric_json(s, blank, f"{s.name}/") for s in a.subs}
        buckets.append(b)
    return {"buckets": buckets, **out}


def _filled(a: Agg, keys: list[float], most: int) -> tuple[list[float], bool]:
    """All keys from the first to the last; the given ones and True where they are too many or can't be told apart."""
    if a.type == "histogram":
        step, off = float(a.body["interval"]), float(a.body.get("offset", 0))
    else:
        (kind, unit), off = _date_interval(a.body, a.loc)
        if kind == "calendar":
            out, at = [], int(keys[0] - off)
            while at <= keys[-1] - off:
                out.append(float(at + off))
                if len(out) > most:
                    return keys, True
                at = calendar_next(at, unit)
            return out, False
        step, off = float(unit), float(off)
    lo, hi = round((keys[0] - off) / step), round((keys[-1] - off) / step)
    if hi - lo + 1 > most or max(abs(lo), abs(hi)) > 2**53:
        return keys, True
    out = [i * step + off for i in range(lo, hi + 1)]
    if out[0] != keys[0] or out[-1] != keys[-1]:
        return keys, False
    if any(not math.isfinite(x) for x in out) or len(set(out)) < len(out):
        return keys, True
    known = {round((k - off) / step): k for k in keys}
    return [known.get(i, x) for i, x in zip(range(lo, hi + 1), out)], False
