"""Groups of a key, streamed: what the similarity operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import scratch


def by_key(
    df: DataFrame,
    key: list[str],
    each: Callable[[pd.DataFrame], pd.DataFrame | None],
    schema: str,
    small: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame] | None = None,
    upto: int = 1,
) -> DataFrame:
    """each() over the rows of every key, as mapInPandas over partitions sorted by key: no Python call a group through
    Spark, which matters with hundreds of thousands of small groups. Groups of 2 to upto rows go to small() instead, many
    at once, with the number of each row's group. A task holds one group and a batch at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None

        def flush(pdf: pd.DataFrame, last: bool):
            k = pdf[key].to_numpy()
            begin = np.concatenate([[0], np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1])
            end = np.append(begin[1:], len(pdf))
            whole = np.arange(len(begin)) < len(begin) - (not last)
            size, out = end - begin, []
            few = whole & (size > 1) & (size <= upto)
            if small is not None and few.any():
                of = np.repeat(np.arange(len(begin)), size)
                rows = few[of]
                out.append(small(pdf[rows], of[rows]))
            for g in np.flatnonzero(whole & (size > (upto if small is not None else 1))):
                got = each(pdf.iloc[begin[g] : end[g]])
                if got is not None:
                    out.append(got)
            return [x for x in out if len(x)], pdf.iloc[len(pdf) if last else begin[-1] :]

        for pdf in frames:
            if len(pdf):
                out, rest = flush(pdf if rest is None or not len(rest) else pd.concat([rest, pdf]), False)
                if out:
                    yield pd.concat(out)
        if rest is not None and len(rest):
            out, _ = flush(rest, True)
            if out:
                yield pd.concat(out)

    # a number, or else small rows that take long are gathered in a few tasks
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, *key).sortWithinPartitions(*key).mapInPandas(run, schema)


def split_hot(rows: DataFrame, key: list[str], member: str, most: int) -> DataFrame:
    """rows with lo and hi: groups of up to most rows as they are (0, 0); larger ones dealt into blocks, and each pair
    of blocks is a group of its own. Every pair of rows of a key meets in one group (of blocks lo and hi; within a
    block where lo = hi), so nothing is capped; a group holds about 2 * most rows. The sizes of the larger groups
    are a written table, which Spark broadcasts below its threshold only."""
    hot = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > most)
    hot = scratch(rows.sparkSession, hot, "hot")
    g = F.ceil(F.coalesce(F.col("__n"), F.lit(1)) / most).cast("int")
    rows = rows.join(hot, key, "left").withColumn("__g", g)
    rows = rows.withColumn("block", F.pmod(F.xxhash64(member), F.col("__g")).cast("int"))
    rows = rows.withColumn("__o", F.explode(F.sequence(F.lit(0), F.col("__g") - 1)))
    return rows.withColumns({"lo": F.least("block", "__o"), "hi": F.greatest("block", "__o")}).drop("__n", "__g", "__o")


def forest(dist: np.ndarray, most: float) -> np.ndarray:
    """Edges (pairs of places) of a minimum spanning forest of the graph of distances up to most: Prim, by rows."""
    n = len(dist)
    far = most + 1
    best, via, out, free = np.full(n, far, np.float64), np.zeros(n, np.int64), [], np.ones(n, bool)
    i = 0
    for _ in range(n):
        free[i] = False
        d = dist[i]
        nearer = free & (d < best) & (d <= most)
        best[nearer], via[nearer] = d[nearer], i
        j = int(np.where(free, best, far + 1).argmin())
        if not free[j]:
            break
        if best[j] <= most:
            out.append((via[j], j))
        i = j
    return np.array(out, np.int64).reshape(-1, 2)
