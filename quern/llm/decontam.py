"""Benchmark decontamination by spaced seeds (operator 2), in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import named, packed, row_key, table

#: Token positions that a seed reads; the others may differ.
MASKS = ((0, 1, 2, 4, 7, 8), (0, 1, 3, 5, 6, 8), (0, 2, 3, 5, 7, 8), (1, 2, 3, 6, 7, 8))
SPAN = 9
#: A hit counts if WINDOW aligned tokens around it agree in at least NEEDED places (0.8 of them). The masks find every
#: window with up to two substitutions. Items of fewer tokens, down to SPAN, count as a whole, with one substitution
#: (which in an item of SPAN tokens is not the last).
WINDOW, NEEDED = 13, 11
#: Bytes of seeds, each with its item's tokens, up to which they are broadcast.
MAX_BROADCAST_BYTES = 64_000_000
#: What parts words: ASCII but for digits and letters.
_PARTS = r"[\x00-/:-@\[-`{-\x7f]+"


def tokens(text: Column) -> Column:
    """Lower-cased words, parted by ASCII other than digits and letters. Null and empty texts have none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), _PARTS), lambda w: w != "")


def _hashes(text: Column) -> Column:
    return F.transform(tokens(text), lambda w: F.xxhash64(w))


def _seeds(df: DataFrame, hashes: str, place: str) -> DataFrame:
    """df with one row per place and mask (mask, place, key); rows of fewer than SPAN tokens have none."""
    n = len(MASKS)
    # No filter on the hashes and no null key: either would have Spark hash every text, or make every key, twice
    df = df.withColumn("__p", F.explode(F.when(F.size(hashes) >= SPAN, F.sequence(F.lit(0), (F.size(hashes) - SPAN + 1) * n - 1))))
    df = df.withColumns({place: (F.col("__p") / n).cast("int"), "__m": F.col("__p") % n})
    key = F.lit(None).cast("long")
    for m, mask in enumerate(MASKS):
        at = [F.get(F.col(hashes), F.col(place) + o) for o in mask]
        key = F.when(F.col("__m") == m, F.xxhash64(F.lit(m), *at)).otherwise(key)
    return df.withColumn("__key", F.coalesce(key, F.lit(0))).drop("__p", "__m")


def _agreement(i: str, j: str) -> tuple[Column, Column]:
    """Which tokens around a hit agree, and the most agreeing tokens of the WINDOW-token windows that hold the hit and lie
    inside both texts; for an item of fewer tokens the window is the item."""
    back, h, u = WINDOW - SPAN, F.size("__h"), F.size("__u")
    same = F.transform(
        F.sequence(F.lit(-back), F.lit(WINDOW - 1)),
        lambda k: F.when(F.get(F.col("__h"), F.when(F.col(i) + k >= 0, F.col(i) + k)) == F.get(F.col("__u"), F.when(F.col(j) + k >= 0, F.col(j) + k)), 1).otherwise(0),
    )
    add = lambda a, x: a + x
    inside = [
        F.when(
            (F.col(i) >= s) & (F.col(j) >= s) & (F.col(i) - s + WINDOW <= h) & (F.col(j) - s + WINDOW <= u),
            F.aggregate(F.slice("__same", back - s + 1, WINDOW), F.lit(0), add),
        ).otherwise(0)
        for s in range(back + 1)
    ]
    short = F.when((u < WINDOW) & (F.col(i) >= F.col(j)) & (F.col(i) - F.col(j) + u <= h), F.aggregate(F.slice("__same", back + 1 - F.col(j), u), F.lit(0), add)).otherwise(0)
    return same, F.greatest(*inside, short)


def contaminated(docs: DataFrame, items: DataFrame, id_col="doc_id", text_col="text", item_col="item_id", item_text="text", max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """(__k row key, doc_id, item_id, agreeing, from_token, to_token): the documents that hold a passage of an item.

    A document holds one where a seed of it (SPAN tokens read through a mask) equals a seed of the item and at least
    NEEDED of WINDOW aligned tokens around the hit agree; of an item of SPAN to WINDOW - 1 tokens all tokens but one.
    Items of the same tokens count as the one with the least id; items of fewer than SPAN tokens contaminate nothing, nor
    do null and empty texts; a passage lies inside the document, so one of fewer tokens than the window has none;
    repeated documents are found alike and give one row; no items or no documents give no rows. Other columns don't
    matter.

    The bytes of the items' seeds are reckoned first. Up to max_broadcast_bytes they are broadcast, and documents are
    read, probed and verified in one stage without a shuffle; beyond, keys are joined in a shuffle that Spark can
    split, and the hits are brought back to both texts."""
    d = docs.select(row_key(id_col, text_col).alias("__k"), named(id_col).alias("doc_id"), _hashes(named(text_col)).alias("__h"))
    u = items.select(named(item_col).alias("item_id"), _hashes(named(item_text)).alias("__u"))
    u = u.groupBy("__u").agg(F.min("item_id").alias("item_id"))
    seeds = _seeds(u, "__u", "__j").select("__key", "item_id", "__j", "__u")
    probes = _seeds(d, "__h", "__i")
    tokens_of = F.size("__u").cast("long")
    size = u.agg(F.sum(F.greatest(tokens_of - (SPAN - 1), F.lit(0)) * len(MASKS) * (8 * tokens_of + 48))).first()[0] or 0
    if size <= max_broadcast_bytes:
        hits = probes.join(F.broadcast(seeds), "__key")
    else:
        found = probes.select("__k", "__i", "__key").join(seeds.drop("__u"), "__key").select("__k", "__i", "item_id", "__j").distinct()
        hits = found.join(d, "__k").join(u, "item_id")
    same, most = _agreement("__i", "__j")
    hits = hits.withColumn("__same", same).withColumn("agreeing", most)
    # What fails goes after the grouping: a filter here would move into the join and put it out of generated code
    good = F.when(F.col("agreeing") >= F.least(F.lit(NEEDED), F.size("__u") - 1), F.col("__i"))
    found = hits.groupBy("__k", "doc_id", "item_id").agg(
        F.max("agreeing").cast("long").alias("agreeing"), F.min(good).cast("long").alias("from_token"), (F.max(good) + SPAN).cast("long").alias("to_token")
    )
    return found.where("from_token is not null")


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col="doc_id", text_col="text", **names) -> DataFrame:
    """docs without the rows that hold a passage of an item; all columns as they are, whatever their names. Rows with
    null or empty texts stay, repeated rows go or stay together; an empty table stays empty."""
    bad = contaminated(docs, items, id_col, text_col, **names).select("__k").distinct()
    return docs.select(packed(docs), row_key(id_col, text_col).alias("__k")).join(bad, "__k", "left_anti").select("row.*")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per contaminated document and item; null, empty and short texts have none, repeated documents one."""
    found = contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.drop("__k")


_SQL_WORDS = f"list_filter(string_split_regex(lower(coalesce(text, '')), '{_PARTS}'), lambda w: w <> '')"
_SQL_KEYS = " UNION ALL ".join(
    f"SELECT {m} AS m, id, t, p, concat_ws(' ', {', '.join(f't[p + {o + 1}]' for o in mask)}) AS k FROM {{0}}_at" for m, mask in enumerate(MASKS)
)
_SQL_SAME = [f"CASE WHEN i + {k} >= 0 AND j + {k} >= 0 AND i + {k} < len(t) AND j + {k} < len(u) AND t[i + {k} + 1] = u[j + {k} + 1] THEN 1 ELSE 0 END" for k in range(SPAN - WINDOW, WINDOW)]
_SQL_MOST = ", ".join(
    f"CASE WHEN i >= {s} AND j >= {s} AND i - {s} + {WINDOW} <= len(t) AND j - {s} + {WINDOW} <= len(u) THEN {' + '.join(_SQL_SAME[WINDOW - SPAN - s : WINDOW - SPAN - s + WINDOW])} ELSE 0 END"
    for s in range(WINDOW - SPAN + 1)
)
_SQL_SHORT = " + ".join(f"CASE WHEN {k} >= -j AND {k} < len(u) - j THEN {x} ELSE 0 END" for k, x in zip(range(SPAN - WINDOW, WINDOW), _SQL_SAME))
OP2_SQL = f"""
WITH d AS (SELECT doc_id AS id, {_SQL_WORDS} AS t FROM documents),
b AS (SELECT min(item_id) AS id, t FROM (SELECT item_id, {_SQL_WORDS} AS t FROM benchmark) GROUP BY t),
d_at AS (SELECT id, t, unnest(range(0, len(t) - {SPAN - 1})) AS p FROM d WHERE len(t) >= {SPAN}),
b_at AS (SELECT id, t, unnest(range(0, len(t) - {SPAN - 1})) AS p FROM b WHERE len(t) >= {SPAN}),
dk AS ({_SQL_KEYS.format("d")}), bk AS ({_SQL_KEYS.format("b")}),
hits AS (SELECT dk.id AS doc_id, bk.id AS item_id, dk.p AS i, bk.p AS j, dk.t AS t, bk.t AS u FROM dk JOIN bk ON dk.m = bk.m AND dk.k = bk.k),
seen AS (
  SELECT doc_id, item_id, i, least({NEEDED}, len(u) - 1) AS needed,
         greatest({_SQL_MOST}, CASE WHEN len(u) < {WINDOW} AND i >= j AND i - j + len(u) <= len(t) THEN {_SQL_SHORT} ELSE 0 END) AS agreeing
  FROM hits
)
SELECT doc_id, item_id, max(agreeing)::BIGINT AS agreeing, (min(i) FILTER (WHERE agreeing >= needed))::BIGINT AS from_token,
       ((max(i) FILTER (WHERE agreeing >= needed)) + {SPAN})::BIGINT AS to_token
FROM seen GROUP BY doc_id, item_id HAVING count(*) FILTER (WHERE agreeing >= needed) > 0
"""
