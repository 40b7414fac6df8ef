"""Which saved queries match each document: candidates by anchors, then the exact matcher.

A saved query that every matching document must share an atom with (a value, an entry, a word, three letters of a text,
a key of a similarity, a number inside an interval, a field's presence) is a candidate only where one of its anchors is
among the document's atoms. Queries without an anchor (not, ne, missing) are candidates everywhere. Queries of one
canonical form are one class. The anchors of up to SLICE classes are broadcast as tables; documents are read once a slice,
in Arrow batches of the columns that the queries name, probed and verified where they are, without a shuffle."""

from __future__ import annotations

import json
import math
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import text as tx
from quern.functions.match import compile_matcher, wants
from quern.operators.compile import column
from quern.operators.search import inner_specs
from quern.plans import query as q
from quern.plans.mapping import BOOL, DATE, KEYWORD, NUMBER, TEXT, Mapping, Refused

MAX_MATCHES, MAX_OFFSETS, SLICE = 1_000_000, 100_000, 200_000
#: Bins that the intervals of a field are dealt into.
BINS = 512
Atom = tuple[str, str, object]  # kind, field, term


def _rank(atoms: set[Atom] | None) -> tuple:
    """Fewer documents first: exact values, then words, then letters, then intervals, then presence; fewer atoms first."""
    if atoms is None:
        return (9, 0)
    cost = {"v": 0, "e": 1, "w": 2, "g": 3, "s": 4, "r": 5, "rx": 5, "ry": 5, "b": 6, "p": 8}
    return (max((cost[k] for k, _, _ in atoms), default=0), len(atoms))


def anchors(node, mapping: Mapping) -> set[Atom] | None:
    """Atoms of which every matching document has one; None where there are none such; empty where nothing matches."""
    if isinstance(node, q.All):
        return min((anchors(c, mapping) for c in node.children), key=_rank, default=None)
    if isinstance(node, q.Any):
        parts = [anchors(c, mapping) for c in node.children]
        return None if any(p is None for p in parts) else set().union(*parts)
    if isinstance(node, q.Not):
        return None
    if isinstance(node, q.Nested):
        return anchors(node.query, mapping) or {("p", node.path, "")}
    name, op, v, w = node.field, node.op, node.value, wants(node)
    f = q.ID if name == "_id" else mapping.find(name)[1]
    if op in ("ne", "empty") or op == "exists" and v is False:
        return None
    present = {("p", name, "")} if name != "_id" else None
    if op in ("eq", "in"):
        out = set()
        for x in v if isinstance(v, tuple) else (v,):
            if isinstance(x, bool):
                if f.type == BOOL:
                    out.add(("b", name, str(x).lower()))
            elif isinstance(x, str):
                if f.type in (KEYWORD, TEXT):
                    out.add(("v", name, tx.normalize(x)))
            elif f.type in (NUMBER, DATE):
                out.add(("v", name, float(x) + 0.0))
        return out
    if op in ("has", "has_any"):
        return {("e", name, x) for x in w["texts"]}
    if op == "has_all":
        return {("e", name, max(w["texts"], key=len))}
    if op in ("words_any", "words_all"):
        longest = [max(x.split(), key=len) for x in w["texts"]]
        return {("w", name, x) for x in (longest if op == "words_any" else [max(longest, key=len)])} if longest else set()
    if op in ("contains", "contains_any", "contains_all", "starts_with"):
        grams = [x[:3] if len(x) >= 3 else None for x in w["texts"]]
        if op == "contains_all":
            grams = [g for g in grams if g][:1] or [None]
        return present if None in grams else {("g", name, g) for g in grams}
    if op in ("lt", "lte", "gt", "gte", "between"):
        if not all(map(q.is_number, v if op == "between" else (v,))):
            return set()
        lo, hi = v if op == "between" else (-math.inf, v) if op[0] == "l" else (v, math.inf)
        return {("r", name, (float(lo), float(hi)))}
    if op == "similar" and w["keys"] and w["min"] > 0:
        # all keys but so many that a document without the others is not similar enough
        keys = sorted(w["keys"])
        return {("s", name, k) for k in keys[: len(keys) - math.ceil(w["min"] * len(keys) - 1e-6) + 1]}
    if op == "box":
        for axis in ("x", "y"):
            if b := w["box"].get(axis):
                lo, hi = (max((float(x) for k, x in b.items() if k[0] == "g"), default=-math.inf), min((float(x) for k, x in b.items() if k[0] == "l"), default=math.inf))
                return {("r" + axis, name, (lo, hi))}
    return present


class Intervals:
    """Classes by intervals of a field: each bin has those whose interval reaches into it."""

    def __init__(self, found: list[tuple[float, float, int]]):
        ends = np.unique([x for lo, hi, _ in found for x in (lo, hi) if math.isfinite(x)])
        self.edges = ends if len(ends) <= BINS else np.unique(np.quantile(ends, np.linspace(0, 1, BINS), method="nearest"))
        self.bins: list[list[int]] = [[] for _ in range(len(self.edges) + 1)]
        for lo, hi, c in found:
            for i in range(int(np.searchsorted(self.edges, lo, "right")), int(np.searchsorted(self.edges, hi, "right")) + 1):
                self.bins[i].append(c)

    def at(self, values) -> list[list[int]]:
        return [self.bins[i] for i in np.searchsorted(self.edges, np.asarray(values, np.float64), "right")]


def anchor_tables(rows: list[tuple[str, str, object, int]]) -> dict[tuple[str, str], object]:
    """(kind, field) -> classes by term, or by interval, of anchors (kind, field, term, class)."""
    terms: dict = {}
    spans: dict = {}
    for kind, name, term, c in rows:
        if kind[0] == "r":
            spans.setdefault((kind, name), []).append((*term, c))
        else:
            terms.setdefault((kind, name), {}).setdefault(term, []).append(c)
    return terms | {k: Intervals(v) for k, v in spans.items()}


def _part(kind: str, f) -> str:
    """The analysed part of a field that holds the atoms of a kind."""
    if kind in ("rx", "ry"):
        return "xy"
    return {"p": "p", "b": "b", "e": "e", "w": "w", "r": "n"}.get(kind) or ("t" if f.type in (KEYWORD, TEXT) else "n")


def _terms(kind: str, v) -> Iterable:
    """The atoms of one value, which is not missing."""
    if kind == "p":
        return ("",) if v else ()
    if kind == "b":
        return (str(bool(v)).lower(),)
    if kind == "e":
        return v
    if kind == "w":
        return v.split(" ")
    if kind == "g":
        return {v[i : i + 3] for i in range(len(v) - 2)}
    if kind == "s":
        return tx.trigrams(v)
    return [p[kind[1]] for p in v] if kind in ("rx", "ry") else (v,)


def candidates(tables: dict, cols: dict[str, list], n: int, mapping: Mapping) -> list[set[int]]:
    """Of each of n documents, given as columns, the classes that one of its atoms is an anchor of."""
    out: list[set[int]] = [set() for _ in range(n)]
    for (kind, name), table in tables.items():
        path, f = (None, q.ID) if name == "_id" else mapping.find(name)
        part = _part(kind, f)
        if path:
            key = f"{name[len(path) + 1 :]}__{part}"
            flat = [(i, o[key]) for i, objects in enumerate(cols[f"{path}__o"]) if objects is not None for o in objects if o is not None]
        else:
            flat = list(enumerate(cols[f"{name}__{part}"]))
        flat = [(i, t) for i, v in flat if v is not None and v is not pd.NA and not (isinstance(v, float) and v != v) for t in _terms(kind, v)]
        if isinstance(table, Intervals):
            for (i, _), got in zip(flat, table.at([t for _, t in flat]) if flat else ()):
                out[i].update(got)
        else:
            for i, t in flat:
                got = table.get(t)
                if got:
                    out[i].update(got)
    return out


def named_columns(tree, tables: Iterable, columns: list[str]) -> set[str]:
    """The analysed columns that a tree's matcher and the anchors' probes read."""
    found: set[str] = set()

    def of(name: str) -> None:
        found.update(c for c in columns if c.startswith(f"{name}__"))

    def walk(n) -> None:
        if isinstance(n, (q.All, q.Any)):
            for c in n.children:
                walk(c)
        elif isinstance(n, q.Not):
            walk(n.child)
        else:
            of(n.path if isinstance(n, q.Nested) else n.field)

    walk(tree)
    for _, name in tables:
        of(name.split(".")[0] if f"{name.split('.')[0]}__o" in columns else name)
    return found


def inner_offsets(specs: dict, doc: dict) -> dict:
    """Of each key of a query's inner hits: how many members hold, and the places of the first ones."""
    out = {}
    for key, s in specs.items():
        tests = [compile_matcher(n, s["path"]) for n in s["queries"]]
        members = doc.get(f"{s['path']}__o")
        at = [i for i, o in enumerate(members if members is not None else ()) if o is not None and any(t(o) for t in tests)]
        out[key] = {"total": len(at), "offsets": at[: s["size"]]}
    return out


def percolate(docs: DataFrame, queries: Iterable[tuple[str, object]], mapping: Mapping, now_ms: int, brute: bool = False) -> DataFrame:
    """(id, queries: sorted ids of the matching saved queries, inner: for each the JSON of its inner hits, or empty)
    for every document of docs.

    queries: (id, tree), the list of saved queries, which the driver holds. brute verifies all of them everywhere."""
    ids: dict[str, list[str]] = {}
    trees: dict[str, object] = {}
    specs: dict[str, dict] = {}
    for name, tree in queries:
        if found := inner_specs(tree, mapping):
            specs[name] = {k: {**s, "queries": [q.resolve(n, mapping, now_ms) for n in s["queries"]]} for k, s in found.items()}
        key = q.canonical(tree)
        ids.setdefault(key, []).append(name)
        trees.setdefault(key, q.resolve(tree, mapping, now_ms))
    classes = sorted(ids)
    frames = []
    for lo in range(0, max(len(classes), 1), SLICE):
        frames.append(_slice(docs, classes[lo : lo + SLICE], trees, ids, specs, mapping, brute))
    if len(frames) == 1:
        return frames[0]
    found = frames[0]
    for f in frames[1:]:
        found = found.union(f)
    got = found.groupBy("id").agg(F.array_sort(F.flatten(F.collect_list(F.arrays_zip("queries", "inner")))).alias("x"))
    return got.select("id", F.col("x.queries").alias("queries"), F.col("x.inner").alias("inner"))


def _slice(docs: DataFrame, classes: list[str], trees: dict, ids: dict, specs: dict, mapping: Mapping, brute: bool) -> DataFrame:
    """percolate() for some of the classes."""
    always, rows, reads = [], [], set()
    for i, key in enumerate(classes):
        atoms = None if brute else anchors(trees[key], mapping)
        if atoms is None:
            always.append(i)
        else:
            rows += [(k, name, term, i) for k, name, term in sorted(atoms, key=repr)]
    tables = anchor_tables(rows)
    for key in classes:
        reads |= named_columns(trees[key], (), docs.columns)
    names = sorted(reads | named_columns(q.EVERYTHING, tables, docs.columns))
    sent = docs.sparkSession.sparkContext.broadcast((tables, [trees[k] for k in classes], [sorted(ids[k]) for k in classes], always, {m: specs[m] for k in classes for m in ids[k] if m in specs}))

    def verify(frames):
        tables, trees, ids, always, specs = sent.value
        compiled: dict = {}
        for pdf in frames:
            cols, n, out = {c: pdf[c].tolist() for c in names}, len(pdf), []
            for i, (name, got) in enumerate(zip(pdf["id"].tolist(), candidates(tables, cols, n, mapping))):
                match = []
                if got or always:
                    doc = {c: None if (v := x[i]) is pd.NA or isinstance(v, float) and v != v else v for c, x in cols.items()}
                    for c in (*always, *got):
                        if c not in compiled:
                            compiled[c] = compile_matcher(trees[c])
                        if compiled[c](doc):
                            match += ids[c]
                    match.sort()
                out.append((name, match, [json.dumps(inner_offsets(specs[m], doc)) if m in specs else "" for m in match]))
            yield pd.DataFrame(out, columns=["id", "queries", "inner"])

    return docs.select("id", *[column(c) for c in names if c != "id"]).mapInPandas(verify, "id string, queries array<string>, inner array<string>")


def guard(matches: DataFrame) -> list:
    """The rows, refused rather than cut where there are too many matches."""
    n = matches.agg(F.sum(F.size("queries"))).first()[0] or 0
    if n > MAX_MATCHES:
        raise Refused(("docs", f"{n} matches, more than {MAX_MATCHES}: send fewer documents"))
    rows = matches.collect()
    shown = sum(len(k["offsets"]) for r in rows for x in r.inner if x for k in json.loads(x).values())
    if shown > MAX_OFFSETS:
        raise Refused(("docs", f"{shown} inner hits, more than {MAX_OFFSETS}: send fewer documents"))
    return rows
