"""The matcher: a compiled predicate over analysed documents as dicts. Percolation verifies with it; tests hold the
column compiler against it."""

from __future__ import annotations

from collections.abc import Callable

from quern.functions import text as tx
from quern.plans import query as q


def wants(leaf: q.Leaf) -> dict:
    """A condition's constants in normal form."""
    op, v = leaf.op, leaf.value
    if op in ("contains", "starts_with", "has"):
        return {"texts": [tx.normalize(v)], "every": False}
    if op in ("contains_any", "contains_all", "has_any", "has_all"):
        return {"texts": sorted({tx.normalize(x) for x in v}), "every": op.endswith("all")}
    if op in ("words_all", "words_any"):
        return {"texts": sorted({w for w in map(tx.words, v) if w != " "}), "every": op.endswith("all")}
    if op == "similar":
        m = dict(v)
        return {"keys": tx.trigrams(tx.normalize(m["text"])), "min": float(m["min"])}
    if op == "box":
        return {"box": {a: dict(b) for a, b in v}}
    return {}


def in_box(box: dict, x: float, y: float) -> bool:
    for axis, at in (("x", x), ("y", y)):
        b = box.get(axis, {})
        if "gt" in b and not at > b["gt"] or "gte" in b and not at >= b["gte"] or "lt" in b and not at < b["lt"] or "lte" in b and not at <= b["lte"]:
            return False
    return True


def _leaf(leaf: q.Leaf, name: str) -> Callable[[dict], bool]:
    op, v, w = leaf.op, leaf.value, wants(leaf)
    p, t, n, b, e = (f"{name}__{k}" for k in "ptnbe")

    def equal(d, x):
        if isinstance(x, bool):
            return d.get(b) is not None and d[b] == x
        if isinstance(x, str):
            return d.get(t) is not None and d[t] == tx.normalize(x)
        return d.get(n) is not None and d[n] == float(x)

    def some(text, holds):
        return text is not None and (all if w["every"] else any)(holds(text, x) for x in w["texts"])

    if op == "exists":
        return lambda d: bool(d.get(p)) == (v is not False)
    if op == "empty":
        return lambda d: not d.get(p) or not len(d.get(e) if d.get(e) is not None else ())
    if op == "ne":
        return lambda d: not d.get(p) or not equal(d, v)
    inner = {
        "eq": lambda d: equal(d, v),
        "in": lambda d: any(equal(d, x) for x in v),
        "lt": lambda d: d.get(n) is not None and d[n] < v,
        "lte": lambda d: d.get(n) is not None and d[n] <= v,
        "gt": lambda d: d.get(n) is not None and d[n] > v,
        "gte": lambda d: d.get(n) is not None and d[n] >= v,
        "between": lambda d: d.get(n) is not None and v[0] <= d[n] <= v[1],
        "nonempty": lambda d: d.get(e) is not None and len(d[e]) > 0,
        "starts_with": lambda d: d.get(t) is not None and d[t].startswith(w["texts"][0]),
        "words_all": lambda d: bool(w["texts"]) and some(d.get(f"{name}__w"), lambda s, x: x in s),
        "similar": lambda d: d.get(t) is not None and bool(w["keys"]) and tx.similarity(tx.trigrams(d[t]), w["keys"]) >= w["min"],
        "box": lambda d: any(in_box(w["box"], xy["x"], xy["y"]) for xy in (d.get(f"{name}__xy") if d.get(f"{name}__xy") is not None else ())),
    }
    inner["words_any"] = inner["words_all"]
    for o in ("contains", "contains_any", "contains_all"):
        inner[o] = lambda d: some(d.get(t), lambda s, x: x in s)
    for o in ("has", "has_any", "has_all"):
        inner[o] = lambda d: d.get(e) is not None and len(d[e]) > 0 and some(set(d[e]), lambda s, x: x in s)
    test = inner[op]
    return lambda d: bool(d.get(p)) and test(d)


def compile_matcher(node, path: str | None = None) -> Callable[[dict], bool]:
    """The predicate of a resolved tree over an analysed document (or object of path)."""
    if isinstance(node, q.All):
        parts = [compile_matcher(c, path) for c in node.children]
        return lambda d: all(p(d) for p in parts)
    if isinstance(node, q.Any):
        parts = [compile_matcher(c, path) for c in node.children]
        return lambda d: any(p(d) for p in parts)
    if isinstance(node, q.Not):
        part = compile_matcher(node.child, path)
        return lambda d: not part(d)
    if isinstance(node, q.Nested):
        part, name = compile_matcher(node.query, node.path), f"{node.path}__o"
        return lambda d: any(o is not None and part(o) for o in (d.get(name) if d.get(name) is not None else ()))
    if node.field == "_id":
        leaf = _leaf(node, "_id")
        return lambda d: leaf(d if "_id__p" in d else {**d, "_id__p": True})
    return _leaf(node, node.field[len(path) + 1 :] if path else node.field)
