"""From JSON documents, or from typed columns, to analysed columns."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import text as tx
from quern.plans import mapping as mp


def analyse_value(v, f: mp.Field) -> dict:
    """Parts of one value; a value of another type is present and has no typed part."""
    if f.type in (mp.KEYWORD, mp.TEXT):
        out = {"t": tx.as_text(v)}
        if f.type == mp.TEXT:
            out["w"] = tx.words(v) if isinstance(v, str) else None
        return out
    if f.type == mp.LIST:
        return {"e": tx.entries(v)}
    if f.type == mp.NUMBER:
        return {"n": tx.as_number(v)}
    if f.type == mp.DATE:
        return {"n": tx.as_date(v)}
    if f.type == mp.BOOL:
        return {"b": v if isinstance(v, bool) else None}
    if f.type == mp.POINT:
        pairs = v if isinstance(v, list) and any(isinstance(p, list) for p in v) else [v]
        read = {mp.NUMBER: tx.as_number, mp.DATE: tx.as_date}
        found = []
        for p in pairs:
            if isinstance(p, list) and len(p) == 2:
                x, y = read[f.x](p[0]), read[f.y](p[1])
                if x is not None and y is not None:
                    found.append((x, y))
                    if len(found) == mp.MAX_POINTS:
                        break
        return {"xy": [{"x": x, "y": y} for x, y in sorted(set(found))]}
    members = v if isinstance(v, list) else [v] if isinstance(v, dict) else []
    return {"o": [analyse_object(m, f) for m in members[: mp.MAX_MEMBERS]]}


def analyse_object(m, f: mp.Field) -> dict | None:
    if not isinstance(m, dict):
        return None
    out = {"__json": json.dumps(m, ensure_ascii=False)}
    for sub, g in f.fields.items():
        v = m.get(sub)
        out[f"{sub}__p"] = v is not None
        parts = analyse_value(v, g) if v is not None else dict.fromkeys(mp.PARTS[g.type])
        out |= {f"{sub}__{k}": x for k, x in parts.items()}
    return out


def analyse(doc: dict, mapping: mp.Mapping) -> dict:
    out = {}
    for name, f in mapping.fields.items():
        v = doc.get(name)
        out[f"{name}__p"] = v is not None
        kinds = ["o"] if f.type == mp.NESTED else mp.PARTS[f.type]
        parts = analyse_value(v, f) if v is not None else dict.fromkeys(kinds)
        out |= {f"{name}__{k}": x for k, x in parts.items()}
    return out


def infer(v) -> str | None:
    """The type that a first value gives its field under dynamic true; None: it gives none."""
    if isinstance(v, bool):
        return mp.BOOL
    if isinstance(v, str):
        return mp.TEXT
    if isinstance(v, (int, float)):
        return mp.NUMBER
    return mp.LIST if isinstance(v, list) and v else None


def inferred(bodies: DataFrame, mapping: mp.Mapping, body: str = "body", order: str = "seq") -> mp.Mapping:
    """mapping with the fields that the documents bring, typed by their first value in order; strict refuses them."""
    if mapping.dynamic == "false":
        return mapping
    known = set(mapping.fields) | {f"{p}.{s}" for p, f in mapping.fields.items() for s in f.fields}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first: dict[str, tuple] = {}
        for pdf in frames:
            for raw, at in zip(pdf["body"], pdf["at"]):
                for k, v in tx.loads(raw).items():
                    kind = infer(v)
                    if v is not None and k not in known and (kind or mapping.dynamic == "strict"):
                        if k and len(k) <= mp.MAX_NAME and k != "_id":
                            first[k] = min(first.get(k, (at, kind)), (at, kind), key=lambda x: x[0])
        yield pd.DataFrame([(k, kind, at) for k, (at, kind) in first.items()], columns=["name", "kind", "at"])

    found = bodies.select(F.col(body).alias("body"), F.col(order).alias("at")).mapInPandas(run, "name string, kind string, at long")
    rows = found.groupBy("name").agg(F.min_by("kind", "at").alias("kind")).collect()
    if mapping.dynamic == "strict" and rows:
        raise mp.Refused(*[(r.name, "not in the mapping, which is strict") for r in sorted(rows)])
    return mapping.merge({r.name: r.kind for r in rows})


def analysed(docs: DataFrame, mapping: mp.Mapping) -> DataFrame:
    """docs(id, body, seq, version) as mapping.schema(). JSON is read in Python, once: Spark's reader would lose
    repeated keys, number literals and Python's text rules."""
    schema = mapping.schema()
    names = [f.name for f in schema]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [analyse(tx.loads(b), mapping) for b in pdf.body]
            out = {n: pd.Series([r.get(n) for r in rows], dtype=object) for n in names if "__" in n}
            yield pd.DataFrame({**out, "_id__t": pdf.id.map(tx.normalize), "id": pdf.id, "body": pdf.body, "seq": pdf.seq, "version": pdf.version})[names]

    return docs.select("id", "body", "seq", "version").mapInPandas(run, schema)


def _udf(fn, kind):
    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.Series:
        seen: dict = {}
        return s.map(lambda v: None if v is None else seen[v] if v in seen else seen.setdefault(v, fn(v)))

    return run


def _member(f: mp.Field, texts: dict[str, Column]):
    """An object of a nested field from a struct of typed values; texts: of a sub-field the normal forms of all objects."""

    def run(o: Column, i: Column) -> Column:
        parts = [F.to_json(o).alias("__json")]
        for sub, g in sorted(f.fields.items()):
            parts.append(o[sub].isNotNull().alias(f"{sub}__p"))
            if g.type in (mp.NUMBER, mp.DATE):
                parts.append((o[sub].cast("double") + F.lit(0.0)).alias(f"{sub}__n"))
            elif g.type == mp.BOOL:
                parts.append(o[sub].alias(f"{sub}__b"))
            elif g.type == mp.KEYWORD:
                parts.append(F.get(texts[sub], i).alias(f"{sub}__t"))
            else:
                raise mp.Refused((f"fields.{sub}", f"{g.type} can't be read from a column"))
        return F.when(o.isNotNull(), F.struct(*parts))

    return run


def from_columns(df: DataFrame, mapping: mp.Mapping, columns: dict[str, Column], id: Column, body: Column | None = None) -> DataFrame:
    """Analysed columns straight from typed ones: numbers, dates and bools stay in the JVM, texts are normalised in
    Arrow batches. A null is a missing field. Nested fields take an array of structs of typed values. Lists are read whole;
    of JSON documents (analysed) the first MAX_MEMBERS objects and MAX_POINTS points count."""
    norm, wordy = _udf(tx.normalize, "string"), _udf(tx.words, "string")
    lists = F.pandas_udf(lambda s: s.map(lambda v: None if v is None else sorted({tx.normalize(x) for x in v if x} - {""})), "array<string>")

    def number(c: Column, kind: str) -> Column:
        d = c.cast("double")
        if kind in ("tinyint", "smallint", "int"):  # always finite: bare, so that conditions reach the reader
            return d
        return F.when(F.isnan(d) | (F.abs(d) == float("inf")), F.lit(None)).otherwise(d + F.lit(0.0))

    def date(c: Column, kind: str) -> Column:
        return F.floor(F.unix_micros(c.cast("timestamp")) / 1000).cast("double") if kind.startswith(("timestamp", "date")) else number(c, kind)

    # a UDF can't run inside a lambda: texts of objects are normalised as arrays first
    many = F.pandas_udf(lambda s: s.map(lambda v: None if v is None else [None if x is None else tx.normalize(x) for x in v]), "array<string>")
    texts: dict[str, dict[str, Column]] = {}
    for name, f in mapping.fields.items():
        for sub in [k for k, g in f.fields.items() if g.type == mp.KEYWORD] if f.type == mp.NESTED else ():
            at = f"{name}.{sub}\x00"  # no name that a table has
            df = df.withColumn(at, many(columns[name].getField(sub).cast("array<string>")))
            texts.setdefault(name, {})[sub] = F.col(f"`{at}`")
    kinds = dict(df.select(*[c.alias(n) for n, c in columns.items()]).dtypes)
    out = [id.cast("string").alias("id"), norm(id.cast("string")).alias("_id__t"), (body if body is not None else F.lit("{}")).alias("body"), F.lit(0).cast("long").alias("seq"), F.lit(None).cast("long").alias("version")]
    for name, f in sorted(mapping.fields.items()):
        c = columns[name]
        out.append(c.isNotNull().alias(f"{name}__p"))
        if f.type in (mp.KEYWORD, mp.TEXT):
            out.append(norm(c).alias(f"{name}__t"))
            if f.type == mp.TEXT:
                out.append(wordy(c).alias(f"{name}__w"))
        elif f.type == mp.LIST:
            out.append(lists(c).alias(f"{name}__e"))
        elif f.type in (mp.NUMBER, mp.DATE):
            out.append((number(c, kinds[name]) if f.type == mp.NUMBER else date(c, kinds[name])).alias(f"{name}__n"))
        elif f.type == mp.BOOL:
            out.append(c.alias(f"{name}__b"))
        elif f.type == mp.POINT:
            out.append(F.array_sort(F.array_distinct(F.transform(c, lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y"))))).alias(f"{name}__xy"))
        else:
            out.append(F.transform(c, _member(f, texts.get(name, {}))).alias(f"{name}__o"))
    return df.select(*out)
