"""Helpers that the operators of this folder share."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space that ends a word: [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(name: str) -> Column:
    """The column of exactly this name, dots and backticks in it included."""
    return F.col("`" + name.replace("`", "``") + "`")


def every(df: DataFrame) -> list[Column]:
    """All columns of df by their exact names."""
    return [named(c) for c in df.columns]


def packed(df: DataFrame) -> Column:
    """All columns of df as one struct, so that no column of an operator can clash with them; `row.*` unpacks it."""
    return F.struct(*every(df)).alias("row")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which every executor sees. Where it is unset, one of our own if driver and
    executors are one process; on a cluster that is refused."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        sc = spark.sparkContext
        if not sc.getCheckpointDir():
            if not re.match(r"local(\[|$)", sc.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="quern-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def _on_disk(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def scratch(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """df as a table written to the shared folder: cuts lineage, survives lost executors. It goes when the application
    ends, or earlier by discard()."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    fs, at = _on_disk(spark, path)
    fs.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that scratch() wrote and that nothing reads any more."""
    for df in tables:
        fs, at = _on_disk(df.sparkSession, df._scratch)
        fs.delete(at, True)


def some(df: DataFrame) -> bool:
    """Whether df has a row."""
    return df.limit(1).count() > 0


def row_key(id_col: str, text_col: str) -> Column:
    """Tells rows apart by id and whole text; repeated rows share it, null and empty differ."""
    return F.md5(
        F.concat(
            F.coalesce(named(id_col).cast("string"), F.lit("-")),
            F.lit("\x01"),
            F.coalesce(F.concat(F.lit("t"), named(text_col)), F.lit("n")),
        )
    )


def lower_ascii(c: Column) -> Column:
    """A-Z lower-cased, everything else as it is."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def modulus(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(named(id_col).cast("string"), F.lit("")).cast("binary")) % n


def text_bytes(df: DataFrame, text_col: str) -> int:
    """UTF-8 bytes of all texts: what sizes partitions."""
    return int(df.agg(F.sum(F.octet_length(named(text_col)))).first()[0] or 0)


MIX = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser over uint64 (splitmix)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Lookup:
    """A hash table over uint64 keys in numpy: open addressing, linear probes."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.bits = keys, max(4, int(np.ceil(np.log2(max(len(keys), 1) * 3))))
        self.slots, self.probes = np.full(1 << self.bits, -1, np.int32), 0
        at, left = self._home(keys), np.arange(len(keys), dtype=np.int32)
        while len(left):
            self.probes += 1
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            lost = self.slots[at] != left
            at, left = (at[lost] + 1) & ((1 << self.bits) - 1), left[lost]

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (mix64(keys) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, want: np.ndarray) -> np.ndarray:
        """The place of each key, or -1."""
        out = np.full(len(want), -1, np.int64)
        if not len(self.keys):
            return out
        at, left = self._home(want), np.arange(len(want))
        for _ in range(self.probes):
            got = self.slots[at]
            hit = (got >= 0) & (self.keys[got] == want[left])
            out[left[hit]] = got[hit]
            on = (got >= 0) & ~hit
            if not on.any():
                break
            at, left = (at[on] + 1) & ((1 << self.bits) - 1), left[on]
        return out


def components(edges: DataFrame) -> DataFrame:
    """(node long, component long): the smallest node reachable over undirected edges (a, b), as a scratch table.

    Rounds of: every node takes the least label of its neighbours, then the label of its label. Both are
    groupBy-min or joins on a node, so a hub costs a skewed join that Spark splits, never a list in one task.
    Each round is a written table, and the one before it goes. No edges: no rows."""
    spark = edges.sparkSession
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = scratch(spark, both, "edges")
    label = both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component"))
    label = scratch(spark, label, "labels")
    while True:
        heard = (
            both.join(label.select(F.col("node").alias("b"), F.col("component").alias("c")), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("c").alias("heard"))
        )
        new = label.join(heard, "node").select("node", F.col("component").alias("was"), F.least("component", "heard").alias("c"))
        up = label.select(F.col("node").alias("c"), F.col("component").alias("above"))
        new = new.join(up, "c").select("node", "was", F.least("c", "above").alias("component"))
        new = scratch(spark, new, "labels")
        discard(label)
        if not some(new.where("component <> was")):
            discard(both)
            return new.select("node", "component")
        label = new
