"""Query trees as columns. Matching knows true and false only, so nulls are taken out where they would matter: where a
condition stands under a not, or its value is shown rather than filtered by. Elsewhere conditions stay bare, and reach
the Parquet reader."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions import text as tx
from quern.functions.match import wants
from quern.plans import query as q
from quern.plans.mapping import BOOL, DATE, KEYWORD, NUMBER, TEXT, Field, Mapping

Part = Callable[[str], Column]


def column(name: str) -> Column:
    return F.col(f"`{name}`")


def top(name: str) -> Part:
    if name == "_id":
        return lambda k: F.lit(True) if k == "p" else column("_id__t")
    return lambda k: column(f"{name}__{k}")


def of_object(o: Column, sub: str) -> Part:
    return lambda k: o[f"{sub}__{k}"]


def _similar(keys: frozenset, least: float):
    @F.pandas_udf("boolean")
    def run(s: pd.Series) -> pd.Series:
        seen: dict = {}
        return s.map(lambda t: False if t is None else seen[t] if t in seen else seen.setdefault(t, tx.similarity(tx.trigrams(t), keys) >= least))

    return run


def _equal(part: Part, v, f: Field) -> Column | None:
    if isinstance(v, bool):
        return part("b").eqNullSafe(F.lit(v)) if f.type == BOOL else None
    if isinstance(v, str):
        return part("t").eqNullSafe(F.lit(tx.normalize(v))) if f.type in (KEYWORD, TEXT) else None
    return part("n").eqNullSafe(F.lit(float(v))) if f.type in (NUMBER, DATE) and q.is_number(v) else None


def leaf_column(leaf: q.Leaf, f: Field, part: Part) -> Column:
    op, v, w = leaf.op, leaf.value, wants(leaf)
    never = F.lit(False)

    def some(holds):
        if not w["texts"]:
            return never
        return reduce((lambda a, b: a & b) if w["every"] else (lambda a, b: a | b), map(holds, w["texts"]))

    if op == "exists":
        return part("p") if v is not False else ~part("p")
    if op in ("eq", "ne"):
        same = _equal(part, v, f)
        if op == "ne":
            return ~same if same is not None else F.lit(True)
        if same is None:
            return never
        return part("b") == v if isinstance(v, bool) else part("t") == tx.normalize(v) if isinstance(v, str) else part("n") == float(v)
    if op == "in":
        if f.type == BOOL:
            return part("b").isin([x for x in v if isinstance(x, bool)])
        if f.type in (NUMBER, DATE):
            got = [float(x) for x in v if q.is_number(x)]
            return part("n").isin(got) if got else never
        got = sorted({tx.normalize(x) for x in v if isinstance(x, str)})
        return part("t").isin(got) if got else never
    if op in ("lt", "lte", "gt", "gte"):
        n, x = part("n"), F.lit(float(v))
        return {"lt": n < x, "lte": n <= x, "gt": n > x, "gte": n >= x}[op] if q.is_number(v) else never
    if op == "between":
        return part("n").between(float(v[0]), float(v[1])) if all(map(q.is_number, v)) else never
    if op.startswith("contains"):
        return some(lambda x: part("t").contains(x))
    if op == "starts_with":
        return part("t").startswith(w["texts"][0])
    if op.startswith("words"):
        return some(lambda x: part("w").contains(x))
    if op == "similar":
        return _similar(w["keys"], w["min"])(part("t")) if w["keys"] else never
    if op in ("has", "has_any", "has_all"):
        return some(lambda x: F.array_contains(part("e"), x))
    if op == "empty":
        return F.coalesce(F.size(part("e")), F.lit(0)) <= 0
    if op == "nonempty":
        return F.size(part("e")) > 0
    return F.exists(part("xy"), lambda p: _box(w["box"], p))


def _box(box: dict, p: Column) -> Column:
    out = F.lit(True)
    for axis in ("x", "y"):
        for k, x in box.get(axis, {}).items():
            c, x = p[axis], F.lit(float(x))
            out = out & {"gt": c > x, "gte": c >= x, "lt": c < x, "lte": c <= x}[k]
    return out


def _cost(n) -> int:
    if isinstance(n, q.Leaf):
        return {"similar": 9, "words_all": 4, "words_any": 4, "contains": 3, "contains_any": 3, "contains_all": 3, "box": 3}.get(n.op, 1)
    return 5 if isinstance(n, q.Nested) else max((_cost(c) for c in n.children), default=0) if isinstance(n, (q.All, q.Any)) else _cost(n.child)


def predicate(node, mapping: Mapping, safe: bool = False, path: str | None = None, obj: Column | None = None) -> Column:
    """node (validated, date math resolved) as a boolean column. safe: never null."""
    if isinstance(node, (q.All, q.Any)):
        both = isinstance(node, q.All)
        parts = [predicate(c, mapping, safe, path, obj) for c in sorted(node.children, key=_cost)]
        return reduce((lambda a, b: a & b) if both else (lambda a, b: a | b), parts) if parts else F.lit(both)
    if isinstance(node, q.Not):
        return ~predicate(node.child, mapping, True, path, obj)
    if isinstance(node, q.Nested):
        inner = node.query
        out = F.exists(column(f"{node.path}__o"), lambda o: o.isNotNull() & predicate(inner, mapping, True, node.path, o))
        return F.coalesce(out, F.lit(False)) if safe else out
    if path:
        sub = node.field[len(path) + 1 :]
        f, part = mapping.fields[path].fields[sub], of_object(obj, sub)
    else:
        f = q.ID if node.field == "_id" else mapping.fields[node.field]
        part = top(node.field)
    out = leaf_column(node, f, part)
    if node.op == "exists":
        return out
    return F.coalesce(out, F.lit(False)) if safe else out


def object_filter(where, mapping: Mapping, path: str) -> Column:
    """The objects of path that where holds of (all that are objects without one)."""
    return F.filter(column(f"{path}__o"), lambda o: o.isNotNull() & (predicate(where, mapping, True, path, o) if where is not None else F.lit(True)))
