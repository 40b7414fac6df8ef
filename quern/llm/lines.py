"""Line dedup (operator 8) and substring dedup by unit hashing (operator 3)."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import SPACES, lower_ascii, named, packed, row_key, scratch, table


def line_key(line: Column) -> Column:
    return lower_ascii(F.trim(line, F.lit(SPACES)))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def frequent_line_drops(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k row key, drops): of each document that has some, the 0-based lines whose key at least min_docs documents hold.

    Only digests travel: each document gives its distinct digests once and the count combines before its shuffle. The
    frequent digests are a written table of one row each, so the join with them is one that Spark can split where a line
    is hot."""
    digests = F.transform(F.transform(_lines(named(text_col)), line_key), lambda k: F.when(F.char_length(k) >= min_chars, F.unhex(F.md5(k))))
    d = docs.select(row_key(id_col, text_col).alias("k"), digests.alias("digests"))
    counts = d.select(F.explode(F.array_distinct("digests")).alias("digest")).where("digest is not null").groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
    frequent = scratch(docs.sparkSession, counts.where(F.col("n") >= min_docs).select("digest"), "frequent")
    at = d.select("k", F.posexplode("digests").alias("pos", "digest")).where("digest is not null")
    return at.join(frequent, "digest", "left_semi").groupBy("k").agg(F.collect_set("pos").alias("drops"))


def with_lines_dropped(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, text, n_lines, n_dropped): each row of docs as a struct, its text without the lines that many documents
    share, its lines before and those dropped.

    A line's key is the line stripped of ASCII white space with A-Z lower-cased; keys of min_chars code points or more
    found in min_docs rows or more lose all their lines. Every row counts as one document, repeated rows and rows that
    share an id too. A null or empty text is one empty line and becomes the empty text; a text whose lines all go becomes
    empty. An empty table gives an empty table. Columns may have any name. Time and memory are linear in the lines of a
    text."""
    drops = frequent_line_drops(docs, min_docs, min_chars, id_col, text_col)
    out = docs.select(packed(docs), row_key(id_col, text_col).alias("k")).join(drops, "k", "left")
    text = F.col("row").getField(text_col)
    lines = _lines(text)
    # bound once, as a struct: in a lambda an expression of the row would be split again for each line
    bound = F.array(F.struct(lines.alias("lines"), F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("drops")).alias("left")))
    kept = F.transform(bound, lambda s: F.array_join(F.transform(s["left"], lambda i: F.get(s["lines"], i)), "\n"))[0]
    return out.select(
        "row",
        F.when(F.col("drops").isNull(), F.coalesce(text, F.lit(""))).otherwise(kept).alias("text"),
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(F.size("drops"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def drop_frequent_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = None) -> DataFrame:
    """docs with the texts that with_lines_dropped gives; the other columns pass as they are, but for chars_col (where
    there is one of that name), which follows the texts that have changed."""
    out = with_lines_dropped(docs, min_docs, min_chars, id_col, text_col)
    n_chars = F.char_length(F.col("text")).cast("long")

    def column(c: str) -> Column:
        was = F.col("row").getField(c)
        if c == text_col:
            return F.col("text").alias(c)
        return (F.when(F.col("n_dropped") > 0, n_chars).otherwise(was) if c == chars_col else was).alias(c)

    return out.select(*[column(c) for c in docs.columns])


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that ten documents or more hold. Null and empty texts are one empty line, which
    stays; each row is a document, repeated rows too; an empty table gives no rows."""
    out = with_lines_dropped(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SQL_KEY = f"translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_LOWER}')"

OP8_SQL = f"""
WITH numbered AS (SELECT doc_id, text, row_number() OVER () AS row_no FROM documents),
lines AS (
  SELECT doc_id, row_no, unnest(range(1, len(ls) + 1)) AS pos, unnest(ls) AS line
  FROM (SELECT doc_id, row_no, string_split(coalesce(text, ''), chr(10)) AS ls FROM numbered)
), keyed AS (SELECT doc_id, row_no, pos, line, {_SQL_KEY} AS k FROM lines),
frequent AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT row_no) >= 10),
marked AS (SELECT doc_id, row_no, pos, line, k IN (SELECT k FROM frequent) AS gone FROM keyed)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY row_no, doc_id
"""

#: Words that a run of repeated units needs to go: of a passage of 50 words at least 20 stand in whole units, if it begins
#: and ends within sentences of up to 15 words.
MIN_WORDS = 20
_UNIT_END = re.compile(r"\n|[.!?](?=[ \t])")
#: The same for Spark: where a unit ends, as places of no width.
_UNIT_ENDS = r"(?<=\n)|(?<=[.!?])(?=[ \t])"


def units_of(text: str) -> list[tuple[int, int, bytes, int]]:
    """(start, end, key, words) of the units of a text, which together are the whole text: lines, their line feeds with
    them, and within a line, which may be a paragraph of any length, sentences, that end at . ! or ? before a blank or
    tab. A unit's key is its words, A-Z lower-cased, joined by one blank; a unit without a word has the empty key."""
    ends = [m.end() for m in _UNIT_END.finditer(text)]
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    out, start = [], 0
    for end in ends:
        words = text[start:end].encode("utf-8", "surrogatepass").lower().split()
        out.append((start, end, b" ".join(words), len(words)))
        start = end
    return out


def runs_of(text: str, repeated: set[int], min_words: int) -> list[tuple[int, int]]:
    """(start, end) in code points, ascending: runs of neighbouring repeated units (by number; units without a word
    between them belong to the run) that hold at least min_words words."""
    out, begin, last, words = [], None, 0, 0
    for n, (start, end, key, size) in enumerate([*units_of(text), (0, 0, b"-", 0)]):
        if not key:
            continue
        if n in repeated:
            begin, last, words = (start if begin is None else begin), end, words + size
        else:
            if begin is not None and words >= min_words:
                out.append((begin, last))
            begin, words = None, 0
    return out


def repeated_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k row key, units): the numbers of each row's units whose key an earlier unit has.

    Earlier is a smaller id (null ids last), for rows of one id a smaller hash of the row, then a smaller number in the
    text; wholly repeated rows are one document. Units go by 128-bit digests: the first of each is an aggregate with a
    combine before its shuffle, written as a table (one row for each digest that occurs again), so the join back, whose
    other side has a row for each unit, is one that Spark can split where a unit is hot."""

    units = F.split(named(text_col), _UNIT_ENDS, -1)
    key = lambda u: F.trim(F.regexp_replace(lower_ascii(u), r"[\x20\x09-\x0D]+", " "))
    digests = F.transform(F.transform(units, key), lambda w: F.when(w != "", F.unhex(F.md5(w))))
    own = named(id_col).cast("long")
    d = docs.where(named(text_col).isNotNull()).select(own.isNull().alias("miss"), own.alias("id"), row_key(id_col, text_col).alias("k"), digests.alias("digests"))
    units = d.select("miss", "id", F.xxhash64("k").alias("kh"), "k", F.posexplode("digests").alias("unit", "digest")).where("digest is not null")
    rank = F.struct("miss", "id", "kh", "unit")
    first = units.groupBy("digest").agg(F.min(rank).alias("first"), F.max(rank).alias("last")).where("first <> last").select("digest", "first")
    first = scratch(docs.sparkSession, first, "first-units")
    return units.join(first, "digest").where(rank != F.col("first")).groupBy("k").agg(F.collect_set("unit").alias("units"))


def with_units_removed(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, text, removed): each row of docs as a struct, its text without the passages that stand earlier in the corpus,
    and the offsets of what went as structs (start, end) in code points of the input.

    Units are lines and their sentences (units_of); of each key the earliest unit stays (repeated_units). A run of
    neighbouring units that are repeats goes if it holds min_words words or more: shorter ones are common phrases and
    boilerplate, which line dedup is for; with min_words=1 every repeat goes. Units are judged on the input. A null text
    stays null, an empty one empty, and neither has removed passages (an empty array); an empty table gives an empty
    table; columns may have any name; the time is linear in the length of a text."""
    again = repeated_units(docs, id_col, text_col)
    out = docs.select(packed(docs), row_key(id_col, text_col).alias("k")).join(again, "k", "left")

    @F.pandas_udf("text string, starts array<long>, ends array<long>")
    def cut(text: pd.Series, units: pd.Series) -> pd.DataFrame:
        found = []
        for t, u in zip(text, units):
            runs = runs_of(t, set(u.tolist()), min_words) if t is not None and u is not None else []
            if not runs:
                found.append((None, [], []))
                continue
            at = [0, *[x for run in runs for x in run], len(t)]
            found.append(("".join(t[a:b] for a, b in zip(at[::2], at[1::2])), [a for a, _ in runs], [b for _, b in runs]))
        return pd.DataFrame(found, columns=["text", "starts", "ends"])

    text = F.col("row").getField(text_col)
    out = out.withColumn("got", cut(F.when(F.col("units").isNotNull(), text), F.col("units")))
    spans = F.arrays_zip(F.col("got.starts").alias("start"), F.col("got.ends").alias("end"))
    return out.select("row", F.coalesce("got.text", text).alias("text"), spans.alias("removed"))


def remove_repeated_units(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the texts that with_units_removed leaves; all other columns as they are."""
    out = with_units_removed(docs, min_words, id_col, text_col)
    return out.select(*[F.col("text").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the code points and passages removed from it, their offsets in the input ("start-end", by
    commas) and the digest of what is left. A null text counts as empty; repeated rows have one result each."""
    out = with_units_removed(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.transform("removed", lambda r: F.concat_ws("-", r["start"].cast("string"), r["end"].cast("string")))
    return out.select(
        "row.doc_id",
        F.coalesce(F.char_length("row.text"), F.lit(0)).cast("long").alias("n_chars"),
        F.aggregate("removed", F.lit(0).cast("long"), lambda a, r: a + r["end"] - r["start"]).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.array_join(spans, ",").alias("removed_at"),
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )


OP3_SQL = f"""
WITH cut AS (
  SELECT doc_id, coalesce(length(text), 0) AS n_chars,
         string_split(regexp_replace(replace(coalesce(text, ''), chr(10), chr(10) || chr(1)), '([.!?])([ \\t])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS us
  FROM documents
), units AS (SELECT doc_id, unnest(range(0, len(us))) AS unit_no, unnest(us) AS u FROM cut),
placed AS (
  SELECT doc_id, unit_no, u, regexp_extract_all(translate(u, '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS words,
         sum(length(u)) OVER (PARTITION BY doc_id ORDER BY unit_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS end_at
  FROM units
), ranked AS (
  SELECT doc_id, unit_no, end_at - length(u) AS start_at, end_at, len(words) AS n_words,
         row_number() OVER (PARTITION BY array_to_string(words, ' ') ORDER BY doc_id, unit_no) > 1 AS again,
         row_number() OVER (PARTITION BY doc_id ORDER BY unit_no) AS nth
  FROM placed WHERE len(words) > 0
), islands AS (
  SELECT *, nth - row_number() OVER (PARTITION BY doc_id, again ORDER BY unit_no) AS island FROM ranked
), runs AS (
  SELECT doc_id, min(unit_no) AS a, max(unit_no) AS b, min(start_at) AS start_at, max(end_at) AS end_at
  FROM islands WHERE again GROUP BY doc_id, island HAVING sum(n_words) >= {MIN_WORDS}
), per AS (
  SELECT doc_id, sum(end_at - start_at) AS n_removed, count(*) AS n_spans,
         string_agg(start_at::BIGINT::VARCHAR || '-' || end_at::BIGINT::VARCHAR, ',' ORDER BY start_at) AS removed_at
  FROM runs GROUP BY doc_id
), kept AS (
  SELECT p.doc_id, string_agg(p.u, '' ORDER BY p.unit_no) FILTER (WHERE r.doc_id IS NULL) AS text
  FROM placed p LEFT JOIN runs r ON p.doc_id = r.doc_id AND p.unit_no BETWEEN r.a AND r.b GROUP BY p.doc_id
)
SELECT c.doc_id, c.n_chars::BIGINT AS n_chars, coalesce(p.n_removed, 0)::BIGINT AS n_removed, coalesce(p.n_spans, 0)::BIGINT AS n_spans,
       coalesce(p.removed_at, '') AS removed_at, sha256(coalesce(k.text, '')) AS kept_sha256
FROM cut c JOIN kept k ON c.doc_id = k.doc_id LEFT JOIN per p ON c.doc_id = p.doc_id
"""
