"""Mixing sources to target weights with a time-varying curriculum (operator 6)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import WORD, named, packed, row_key, table

#: Weight schedules by rank of the source: knots (time from 0 to 1, weight), straight between. Early, even, late.
SCHEDULES = (((0.0, 2.0), (1.0, 0.0)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.0), (1.0, 2.0)))
ROWS_PER_BUCKET = 20_000


def source_targets(sizes: DataFrame, weights: Sequence[float], cap: float) -> DataFrame:
    """sizes(source, source_size) with rank, weight and target: weights shared by code point rank (null last), the
    whole of all sizes shared by weight, no target above cap times its source's size, the excess reshared by weight.

    Closed form instead of rounds: in order of size over weight, sources below the level fill up, and the level
    is what the others get per weight. One row per source; the window holds no more."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("rank", F.row_number().over(order) - 1)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    s = ranked.withColumn("weight", w).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    by = Window.orderBy((F.col("most") / F.col("weight")).asc(), F.col("rank").asc())
    below = by.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumns(
        {
            "total": F.sum("source_size").over(every),
            "full": F.coalesce(F.sum("most").over(below), F.lit(0.0)),
            "left": F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing)),
        }
    )
    s = s.withColumn("level", (F.col("total") - F.col("full")) / F.col("left"))
    # It rises as long as full sources pass on what they can't take, and falls from where sources that aren't full
    # are held for full: the largest is the one
    s = s.withColumn("level", F.max("level").over(every))
    target = F.least(F.col("most"), F.col("level") * F.col("weight"))
    return s.select("source", "source_size", "rank", "weight", F.coalesce(target, F.lit(0.0)).alias("target"))


def _time(share: Column, rank: Column, schedules) -> Column:
    """The time at which a source has spent this share of its demand: the integral of its schedule, inverted."""
    out = F.lit(None).cast("double")
    for r, knots in enumerate(schedules):
        area = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:])]
        total, done = sum(area), 0.0
        here = F.lit(float(knots[-1][0]))
        pieces = []
        for (t0, w0), (t1, w1), a in zip(knots, knots[1:], area):
            slope, need = (w1 - w0) / (t1 - t0), share * total - done
            if abs(slope) < 1e-12:
                dt = need / (w0 or 1.0)
            else:
                dt = (F.sqrt(F.greatest(F.lit(0.0), F.lit(w0 * w0) + need * (2 * slope))) - w0) / slope
            pieces.append((done + a, F.lit(float(t0)) + dt))
            done += a
        for upto, t in reversed(pieces):
            here = F.when(share * total <= upto, t).otherwise(here)
        out = F.when(rank % len(schedules) == r, here).otherwise(out)
    return F.least(F.greatest(out, F.lit(0.0)), F.lit(1.0))


def plan_mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(row, id, size, source_size, rank, target, before, passes, taken): each row of docs as a struct, its words, its
    source's words, rank and target, the words of the source ahead of it, how many times it is taken, and the words that
    makes.

    Within a source, documents stand in the order of a hash of id and text (then id, size), which reruns repeat. Whole
    passes take every document; the partial pass takes those whose middle word lies before what is left of the target, so
    the words taken are within half a document of it. The running sum is two-level: totals of hash ranges of the source,
    then sums within a range, so no task holds a whole source, nor the rows without an id. Null texts and empty ones have
    size 0 and are not taken; a null source is a source, the last; wholly repeated rows are documents of their own, next
    to each other; columns may have any name; no rows give no rows."""
    lean = docs.select(
        packed(docs), named(id_col).alias("id"), named(source_col).alias("src"), row_key(id_col, text_col).alias("at"), F.coalesce(F.regexp_count(named(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size")
    )
    n = docs.count()
    digits = 1
    while 16**digits * ROWS_PER_BUCKET < n and digits < 8:
        digits += 1
    lean = lean.withColumn("bucket", F.substring("at", 1, digits))
    totals = lean.groupBy("src", "bucket").agg(F.sum("size").alias("words"))
    ahead = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("ahead", F.coalesce(F.sum("words").over(ahead), F.lit(0)))
    targets = source_targets(totals.groupBy(F.col("src").alias("source")).agg(F.sum("words").alias("source_size")), weights, cap)
    targets = targets.select(F.col("source").alias("s"), "source_size", "rank", "target")
    # one row per source and range, far fewer than documents; Spark broadcasts it below its own threshold only
    starts = totals.join(targets, F.col("src").eqNullSafe(F.col("s")))
    starts = starts.select(F.col("src").alias("s"), F.col("bucket").alias("b"), "ahead", "source_size", "rank", "target")
    within = Window.partitionBy("src", "bucket").orderBy("at", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    d = lean.withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0)))
    d = d.join(starts, F.col("src").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).withColumn("before", F.col("before") + F.col("ahead"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    d = d.withColumn("whole", whole)
    rest = F.col("target") - F.col("whole") * F.col("source_size")
    part = (F.col("before") + F.col("size") / 2.0 <= rest).cast("long")
    d = d.withColumn("passes", F.when(F.col("size") > 0, F.col("whole") + part).otherwise(F.lit(0)).cast("long"))
    return d.select("row", "id", "size", "source_size", "rank", "target", "before", "passes", (F.col("passes") * F.col("size")).alias("taken"))


def position(pass_no: Column, schedules=SCHEDULES) -> Column:
    """Where a copy of plan_mix's row stands in training, 0 to 1: where its source's cumulative token demand, the integral
    of the source's weight schedule over time, reaches the copy's middle word."""
    share = (pass_no * F.col("source_size") + F.col("before") + F.col("size") / 2.0) / F.col("target")
    return _time(F.least(share, F.lit(1.0)), F.col("rank"), schedules)


def curriculum(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: int = 3, schedules=SCHEDULES, partitions: int | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: one row per copy taken, with pass_no and position, range-sorted by position (then id, pass).

    plan_mix tells which copies are taken, position() where they stand. All columns of docs pass as they are, but pass_no
    and position take the place of columns of those names. Nulls, repeated rows and empty tables as in plan_mix."""
    d = plan_mix(docs, weights, cap, id_col, text_col, source_col).where("passes > 0")
    d = d.withColumn("pass_no", F.explode(F.sequence(F.lit(0), (F.col("passes") - 1).cast("int"))))
    d = d.withColumn("position", position(F.col("pass_no"), schedules))
    keys = ["position", "id", "pass_no"]
    d = (d.repartitionByRange(partitions, *keys) if partitions else d.repartitionByRange(*keys)).sortWithinPartitions(*keys)
    own = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("pass_no", "position")]
    return d.select(*own, "pass_no", "position")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words that the mix takes of it, the number of its copies and where the first of them stands
    in training (null where none does). Null texts have size 0; a null source is the last one; repeated rows are
    documents of their own; an empty table gives no rows."""
    d = plan_mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    first = F.when(F.col("passes") > 0, position(F.lit(0)))
    return d.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "passes", first.alias("first_position"))


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, '-') || chr(1) || coalesce('t' || text, 'n')) AS at,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rank FROM d GROUP BY source
), w AS (
  SELECT *, CASE rank % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, source_size * 3.0::DOUBLE AS most FROM s
), c AS (
  SELECT *, (sum(source_size) OVER ())::DOUBLE AS total,
         coalesce(sum(most) OVER (ORDER BY most / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS filled,
         sum(weight) OVER (ORDER BY most / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM w
), l AS (SELECT max((total - filled) / rest) AS level FROM c),
t AS (SELECT source, source_size, rank, least(most, level * weight) AS target FROM c, l),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.rank,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.at, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 0 END AS whole
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), q AS (
  SELECT *, (CASE WHEN size = 0 THEN 0 ELSE whole + CASE WHEN before + size / 2.0 <= target - whole * source_size THEN 1 ELSE 0 END END)::BIGINT AS passes,
         least((before + size / 2.0)::DOUBLE / target, 1.0::DOUBLE) AS share
  FROM p
)
SELECT doc_id, size, source_size, target, (passes * size)::BIGINT AS taken, passes,
       CASE WHEN passes > 0 THEN CASE rank % 3
         WHEN 0 THEN (sqrt(greatest(0.0::DOUBLE, 4.0::DOUBLE + share * -4.0::DOUBLE)) - 2.0::DOUBLE) / -2.0::DOUBLE
         WHEN 1 THEN share
         ELSE sqrt(greatest(0.0::DOUBLE, share * 4.0::DOUBLE)) / 2.0::DOUBLE END END AS first_position
FROM q
"""
