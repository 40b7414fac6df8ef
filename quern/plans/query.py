"""The query language: a JSON tree of all, any, not, nested and conditions."""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

from quern.functions import text as tx
from quern.plans import datemath as dm
from quern.plans.mapping import BOOL, DATE, KEYWORD, LIST, NESTED, NUMBER, POINT, TEXT, Field, Mapping, Refused

MAX_DEPTH, MAX_LEAVES, MAX_NODES, MAX_TEXT, MAX_LIST = 4, 50, 100, 500, 200
RANGES = ("lt", "lte", "gt", "gte", "between")
_TEXT_OPS = ("contains", "contains_any", "contains_all", "eq", "ne", "in", "exists", "starts_with", "similar")
OPS = {
    KEYWORD: _TEXT_OPS,
    TEXT: (*_TEXT_OPS, "words_all", "words_any"),
    LIST: ("has", "has_any", "has_all", "nonempty", "empty", "exists"),
    NUMBER: ("eq", "ne", "in", *RANGES, "exists"),
    DATE: ("eq", "ne", "in", *RANGES, "exists"),
    BOOL: ("eq", "ne", "exists"),
    POINT: ("box", "exists"),
    NESTED: ("exists",),
}
ALL_OPS = sorted({op for ops in OPS.values() for op in ops})
ID = Field(KEYWORD)


@dataclass(frozen=True)
class All:
    children: tuple


@dataclass(frozen=True)
class Any:
    children: tuple


@dataclass(frozen=True)
class Not:
    child: object


@dataclass(frozen=True)
class Inner:
    name: str | None = None
    size: int = 3
    fields: tuple = ()


@dataclass(frozen=True)
class Nested:
    path: str
    query: object
    inner: Inner | None = None


@dataclass(frozen=True)
class Leaf:
    field: str
    op: str
    value: object = None


EVERYTHING = All(())


class _Parser:
    def __init__(self, root: str):
        self.root, self.problems, self.nodes, self.leaves = root, [], 0, 0

    def bad(self, loc: str, message: str):
        self.problems.append((loc, message))

    def keys(self, m: dict, allowed: tuple, loc: str):
        for k in sorted(set(m) - set(allowed)):
            self.bad(f"{loc}.{k}", "unknown key")

    def node(self, v, loc: str, depth: int):
        self.nodes += 1
        if self.nodes > MAX_NODES:
            raise Refused((self.root, f"a query has at most {MAX_NODES} nodes"))
        if not isinstance(v, dict):
            self.bad(loc, "a node is all, any, not, nested or a condition")
            return None
        for kind, make in (("all", All), ("any", Any)):
            if kind in v:
                self.deep(depth)
                self.keys(v, (kind,), loc)
                if not isinstance(v[kind], list) or not v[kind]:
                    self.bad(f"{loc}.{kind}", f"{kind} needs a list of nodes")
                    return None
                return make(tuple(self.node(c, f"{loc}.{kind}.{i}", depth + 1) for i, c in enumerate(v[kind])))
        if "not" in v:
            self.keys(v, ("not",), loc)
            return Not(self.node(v["not"], f"{loc}.not", depth))
        if "nested" in v:
            self.deep(depth)
            self.keys(v, ("nested",), loc)
            b, loc = v["nested"], f"{loc}.nested"
            if not isinstance(b, dict):
                self.bad(loc, "nested is {path, query, inner_hits}")
                return None
            self.keys(b, ("path", "query", "inner_hits"), loc)
            if not isinstance(b.get("path"), str):
                self.bad(f"{loc}.path", "a nested node needs the path of its nested field")
            q = b.get("query", {"all": []})
            return Nested(b.get("path"), EVERYTHING if q == {"all": []} else self.node(q, f"{loc}.query", depth + 1), self.inner(b["inner_hits"], f"{loc}.inner_hits") if "inner_hits" in b else None)
        self.leaves += 1
        if self.leaves > MAX_LEAVES:
            raise Refused((self.root, f"a query has at most {MAX_LEAVES} conditions"))
        self.keys(v, ("field", "op", "value"), loc)
        if not isinstance(v.get("field"), str):
            self.bad(f"{loc}.field", "a condition needs a field")
        if v.get("op") not in ALL_OPS:
            self.bad(f"{loc}.op", f"unknown op {v.get('op')!r}")
        value = v.get("value")
        self.bounds(value, f"{loc}.value")
        return Leaf(v.get("field"), v.get("op"), _freeze(value))

    def deep(self, depth: int):
        if depth >= MAX_DEPTH:
            raise Refused((self.root, f"groups go {MAX_DEPTH} deep at most"))

    def bounds(self, v, loc: str):
        if isinstance(v, str) and len(v) > MAX_TEXT:
            self.bad(loc, f"a text has at most {MAX_TEXT} characters")
        if isinstance(v, list):
            if len(v) > MAX_LIST:
                self.bad(loc, f"a list has at most {MAX_LIST} values")
            for i, x in enumerate(v[:MAX_LIST]):
                if isinstance(x, (list, dict)):
                    self.bad(f"{loc}.{i}", "a list holds scalars")
                self.bounds(x, f"{loc}.{i}")
        if isinstance(v, dict):
            for k, x in v.items():
                self.bounds(x, f"{loc}.{k}")

    def inner(self, v, loc: str):
        if not isinstance(v, dict):
            self.bad(loc, "inner_hits is {name, size, fields}")
            return None
        self.keys(v, ("name", "size", "fields"), loc)
        name, size, fields = v.get("name"), v.get("size", 3), v.get("fields", [])
        if "name" in v and (not isinstance(name, str) or not name):
            self.bad(f"{loc}.name", "an inner_hits name is a text")
        if isinstance(size, bool) or not isinstance(size, int) or not 0 <= size <= 1000:
            self.bad(f"{loc}.size", "an inner_hits size is a whole number from 0 to 1000")
        if not isinstance(fields, list) or len(fields) > 100 or not all(isinstance(f, str) for f in fields):
            self.bad(f"{loc}.fields", "inner_hits fields are at most 100 names")
        return Inner(name, size, tuple(fields) if isinstance(fields, list) else ())


def _freeze(v):
    if isinstance(v, list):
        return tuple(map(_freeze, v))
    if isinstance(v, dict):
        return tuple(sorted((k, _freeze(x)) for k, x in v.items()))
    return v


def parse(v, loc: str = "query"):
    if isinstance(v, (str, bytes)):
        try:
            v = json.loads(v)
        except ValueError as e:
            raise Refused((loc, f"the query is not valid JSON: {e}")) from None
    if v == {"all": []}:
        return EVERYTHING
    p = _Parser(loc)
    node = p.node(v, loc, 0)
    if p.problems:
        raise Refused(*p.problems)
    return node


def is_number(v) -> bool:
    return tx.as_number(v) is not None


def _text(v) -> bool:
    return isinstance(v, str) and bool(v.strip())


def _texts(v) -> bool:
    return isinstance(v, tuple) and bool(v) and all(map(_text, v))


def _kind_ok(v, f: Field) -> bool:
    return is_number(v) if f.type in (NUMBER, DATE) else isinstance(v, bool) if f.type == BOOL else _text(v)


def _date_bound(v, loc: str, problems: list):
    if is_number(v):
        return None
    try:
        d = dm.parse(v) if isinstance(v, str) else None
        if d is None:
            raise dm.BadDate("a bound is a number, a date or date math")
        if not d.now:
            d.resolve(0, False), d.resolve(0, True)
        return d
    except dm.BadDate as e:
        problems.append((loc, str(e)))
        return False


def _range_problem(lo, hi, strict: bool, loc: str, problems: list):
    """Refuses bounds that leave nothing at any now: neither reads it, or both are now plus a fixed length."""
    d = [_date_bound(v, loc, problems) for v in (lo, hi)]
    if False in d:
        return
    fixed = [x is None or not x.now for x in d]
    if all(fixed) or all(x and x.fixed_offset for x in d):
        a = float(lo) if d[0] is None else d[0].resolve(0, False)
        b = float(hi) if d[1] is None else d[1].resolve(0, True)
        if a > b or strict and a == b:
            problems.append((loc, "the lower bound is past the upper"))


def leaf_problems(leaf: Leaf, f: Field, loc: str) -> list[tuple[str, str]]:
    op, v, out, at = leaf.op, leaf.value, [], f"{loc}.value"
    if op not in OPS[f.type]:
        return [(f"{loc}.op", f"{op} is not an op of {leaf.field!r}, a {f.type} field")]
    if op in ("empty", "nonempty") and v is not None:
        out.append((at, f"{op} takes no value"))
    elif op == "exists" and v is not None and not isinstance(v, bool):
        out.append((at, "exists takes true or false"))
    elif op in ("eq", "ne") and not _kind_ok(v, f):
        out.append((at, f"{op} on {leaf.field!r} needs a value of its type"))
    elif op == "in" and not (isinstance(v, tuple) and v and all(_kind_ok(x, f) for x in v)):
        out.append((at, f"in on {leaf.field!r} needs a list of values of its type"))
    elif op in ("lt", "lte", "gt", "gte"):
        if f.type == DATE:
            _date_bound(v, at, out)
        elif not is_number(v):
            out.append((at, f"{op} needs a number"))
    elif op == "between":
        if not isinstance(v, tuple) or len(v) != 2 or (f.type == NUMBER and not all(map(is_number, v))):
            out.append((at, "between needs [lo, hi]"))
        else:
            _range_problem(*v, False, at, out)
    elif op in ("contains", "starts_with", "has") and not _text(v):
        out.append((at, f"{op} needs a text value"))
    elif op == "has" and "," in v:
        out.append((at, "has takes one entry: use has_any or has_all"))
    elif op in ("contains_any", "contains_all", "has_any", "has_all", "words_all", "words_any") and not _texts(v):
        out.append((at, f"{op} needs a list of texts"))
    elif op in ("words_all", "words_any"):
        out += [(at, f"{op}: {x!r} holds no word") for x in v if tx.words(x) == " "]
    elif op == "similar":
        m = dict(v) if isinstance(v, tuple) and all(isinstance(x, tuple) and len(x) == 2 for x in v) else {}
        if set(m) != {"text", "min"} or not _text(m["text"]) or not is_number(m["min"]) or not 0 < m["min"] <= 1:
            out.append((at, "similar needs {text, min} with min above 0 and up to 1"))
    elif op == "box":
        axes = dict(v) if isinstance(v, tuple) and all(isinstance(x, tuple) and len(x) == 2 for x in v) else None
        if axes is None or set(axes) - {"x", "y"}:
            out.append((at, "box takes x and y"))
        else:
            for name, kind in (("x", f.x), ("y", f.y)):
                b = dict(axes.get(name, ()))
                los, his = [k for k in b if k in ("gt", "gte")], [k for k in b if k in ("lt", "lte")]
                if set(b) - {"gt", "gte", "lt", "lte"} or len(los) > 1 or len(his) > 1:
                    out.append((f"{at}.{name}", "an axis takes gt or gte, and lt or lte"))
                    continue
                for k, x in b.items():
                    if kind == NUMBER and not is_number(x):
                        out.append((f"{at}.{name}.{k}", "a bound of a number axis is a number"))
                    elif kind == DATE:
                        _date_bound(x, f"{at}.{name}.{k}", out)
                if not out and los and his:
                    _range_problem(b[los[0]], b[his[0]], los[0] == "gt" or his[0] == "lt", f"{at}.{name}", out)
    return out


def validate(node, mapping: Mapping, loc: str = "query", inner_ok: bool = True) -> None:
    """Refuses what the mapping can't answer; the first problem of each condition."""
    problems: list[tuple[str, str]] = []

    def walk(n, loc, path, negated):
        if isinstance(n, (All, Any)):
            for i, c in enumerate(n.children):
                walk(c, f"{loc}.{'all' if isinstance(n, All) else 'any'}.{i}", path, negated)
        elif isinstance(n, Not):
            walk(n.child, f"{loc}.not", path, True)
        elif isinstance(n, Nested):
            f = mapping.fields.get(n.path)
            if path or not f or f.type != NESTED:
                problems.append((f"{loc}.nested.path", f"{n.path!r} is not a nested field"))
                return
            if n.inner and (negated or not inner_ok):
                problems.append((f"{loc}.nested.inner_hits", "inner_hits can't be under a not or in an aggregation"))
            if n.query != EVERYTHING:
                walk(n.query, f"{loc}.nested.query", n.path, negated)
        else:
            if path:
                name = n.field[len(path) + 1 :] if n.field.startswith(path + ".") else None
                f = mapping.fields[path].fields.get(name) if name else None
            else:
                f = ID if n.field == "_id" else mapping.fields.get(n.field)
            if f is None:
                problems.append((f"{loc}.field", f"{n.field!r} is not a field here"))
            else:
                problems.extend(leaf_problems(n, f, loc)[:1])

    walk(node, loc, None, False)
    if problems:
        raise Refused(*problems)


def resolve(node, mapping: Mapping, now_ms: int):
    """node with all date math turned into Unix ms, at one now. gt, lte and upper bounds round up, the others down."""

    def ms(v, up):
        if not isinstance(v, str):
            return v
        try:
            return float(dm.parse(v).resolve(now_ms, up))
        except dm.BadDate:
            return float("inf")

    def go(n, path):
        if isinstance(n, (All, Any)):
            return replace(n, children=tuple(go(c, path) for c in n.children))
        if isinstance(n, Not):
            return Not(go(n.child, path))
        if isinstance(n, Nested):
            return replace(n, query=go(n.query, n.path))
        if n.op in ("lt", "lte", "gt", "gte"):
            return replace(n, value=ms(n.value, n.op in ("gt", "lte")))
        if n.op == "between":
            return replace(n, value=(ms(n.value[0], False), ms(n.value[1], True)))
        if n.op == "box":
            return replace(n, value=tuple((a, tuple((k, ms(x, k in ("gt", "lte"))) for k, x in b)) for a, b in n.value))
        return n

    return go(node, None)


def canonical(node) -> str:
    """One spelling for trees that mean the same: sorted distinct children, flat groups, no double not."""

    def go(n):
        if isinstance(n, (All, Any)):
            kind, parts = type(n).__name__, set()
            for c in n.children:
                g = go(c)
                parts |= set(g[1]) if g[0] == kind else {g}
            return parts.pop() if len(parts) == 1 else (kind, tuple(sorted(parts, key=repr)))
        if isinstance(n, Not):
            g = go(n.child)
            return g[1] if g[0] == "Not" else ("Not", g)
        if isinstance(n, Nested):
            return ("Nested", n.path, go(n.query))
        v = n.value
        if n.op in ("in", "contains_any", "contains_all", "has_any", "has_all", "words_all", "words_any"):
            v = tuple(sorted({tx.words(x) if n.op.startswith("words") else tx.normalize(x) if isinstance(x, str) else x for x in v}, key=repr))
        elif n.op in ("eq", "ne", "contains", "starts_with", "has") and isinstance(v, str):
            v = tx.normalize(v)
        elif n.op == "exists":
            v = v is not False
        return ("Leaf", n.field, n.op, tuple(float(x) if is_number(x) else x for x in v) if isinstance(v, tuple) else float(v) if is_number(v) else v)

    return repr(go(node))
