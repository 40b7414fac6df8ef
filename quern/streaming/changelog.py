"""Versioned writes: an ordered change log, the state it adds up to, and its application in batch or as a stream."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHANGES = "shard int, seq long, op string, id string, body string, version long, ts_ms long"


def shard_of(id: Column, shards: int) -> Column:
    """FNV-1a of the id's bytes, modulo the number of shards; 32 bits, in the JVM."""
    bytes_ = F.transform(F.regexp_extract_all(F.hex(id.cast("binary")), F.lit("(..)")), lambda h: F.conv(h, 16, 10).cast("long"))
    h = F.aggregate(bytes_, F.lit(2166136261).cast("long"), lambda a, b: (a.bitwiseXOR(b) * 16777619).bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.pmod(h, F.lit(shards)).cast("int")


def net(changes: DataFrame, by: str = "id", seq: str = "seq") -> DataFrame:
    """The last change of each key. An aggregate, so that a hot key is combined before its shuffle."""
    cols = [c for c in changes.columns if c != by]
    return changes.groupBy(by).agg(F.max_by(F.struct(*cols), seq).alias("c")).select(by, "c.*")


def versioned(changes: DataFrame) -> DataFrame:
    """Changes that take effect when every one carries an external version: of each id those above all versions
    before them in seq order; the others are noops. A ranked running maximum, no state in Python."""
    before = Window.partitionBy("id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    top = F.max("version").over(before)
    return changes.withColumn("applied", top.isNull() | (F.col("version") > top))


def live(state: DataFrame) -> DataFrame:
    return state.where(F.col("op") != "delete")


def pruned(state: DataFrame, now_ms: int, gc_deletes_ms: int) -> DataFrame:
    """state without tombstones older than gc_deletes."""
    return state.where((F.col("op") != "delete") | (F.col("ts_ms") > now_ms - gc_deletes_ms))


def merged(state: DataFrame, changes: DataFrame) -> DataFrame:
    """The state after changes. Idempotent: a change is known by its seq, and an old one never beats a newer."""
    return net(state.select(*_names()).unionByName(changes.select(*_names())))


def _names() -> list[str]:
    return [c.split()[0] for c in CHANGES.split(", ")]


def unchanged(changes: DataFrame, state: DataFrame) -> DataFrame:
    """changes with noop: whether the body is what the state holds already (first 8 bytes of SHA-256), for ids that
    the batch names once."""
    h = lambda c: F.substring(F.sha2(c.cast("binary"), 256), 1, 16)
    once = changes.groupBy("id").count().where("count = 1").select("id")
    held = live(state).select("id", h(F.col("body")).alias("hash"))
    same = changes.where(F.col("op") == "upsert").join(once, "id", "left_semi").select("id", h(F.col("body")).alias("hash")).join(held, ["id", "hash"], "left_semi").select("id", F.lit(True).alias("noop"))
    return changes.join(same, "id", "left").withColumn("noop", F.coalesce("noop", F.lit(False)))


def digest(body: str | None) -> bytes | None:
    """What tells bodies apart."""
    return None if body is None else hashlib.sha256(body.encode("utf-8", "surrogatepass")).digest()[:16]


def fold(items: list[dict], held: dict[str, tuple], seqs: dict[int, int], shard) -> list[dict]:
    """What each item of a request does, in order: held is id -> (op, seq, version, digest). if_seq and create are
    checked against the state as the items before have left it; an external version applies only above the largest."""
    out = []
    for it in items:
        op, seq, version, mark = held.get(it["id"], (None, 0, None, None))
        exists = op not in (None, "delete", "query_delete")
        res = {"op": it["op"], "id": it["id"], "shard": shard(it["id"]), "status": 200, "error": it.get("error")}
        if it.get("error"):
            res["status"] = 400
        elif it.get("if_seq") is not None and it["if_seq"] != (seq if exists else 0):
            res |= {"status": 409, "error": "the document has another seq", "seq": seq}
        elif it["op"] == "create" and exists:
            res |= {"status": 409, "error": "the document exists", "seq": seq}
        elif it.get("version") is not None and version is not None and it["version"] <= version:
            res |= {"result": "noop", "seq": seq, "version": version}
        elif it["op"].endswith("delete") and not exists and it.get("version") is None:
            res |= {"status": 404, "result": "not_found"}
        elif it["op"] == "upsert" and exists and digest(it["body"]) == mark and it.get("version") is None:
            res |= {"result": "noop", "seq": seq}
        else:
            s = res["shard"]
            seqs[s] = seqs.get(s, 0) + 1
            version = it["version"] if it.get("version") is not None else version
            kind = "upsert" if it["op"] == "create" else it["op"]
            held[it["id"]] = (kind, seqs[s], version, digest(it["body"]))
            res |= {"seq": seqs[s], "version": version, "result": "deleted" if kind.endswith("delete") else "updated" if exists else "created", "change": (s, seqs[s], kind, it["id"], it["body"], version)}
            res["status"] = 201 if res["result"] == "created" else 200
        out.append(res)
    return out


def apply_stream(changes: DataFrame, state_path: str, checkpoint: str, then=None, interval: str | None = None, gc_deletes_ms: int | None = None):
    """Applies a stream of changes to a state kept as numbered Parquet snapshots, one for each micro-batch.

    A batch that is run again writes the same snapshot again from the same one before it, so a restart repeats nothing;
    snapshots before those two go. With gc_deletes_ms, deletes older than the batch's newest change by more are forgotten.
    then(state, batch) is called on each, for instance to percolate."""
    spark = changes.sparkSession

    def each(batch: DataFrame, n: int) -> None:
        now = batch.select(*_names())
        before = spark.read.schema(CHANGES).parquet(f"{state_path}/{n - 1}") if n else spark.createDataFrame([], CHANGES)
        state = merged(before, now)
        if gc_deletes_ms is not None and (newest := now.agg(F.max("ts_ms")).first()[0]) is not None:
            state = pruned(state, newest, gc_deletes_ms)
        state.write.mode("overwrite").parquet(f"{state_path}/{n}")
        old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{state_path}/{n - 2}")
        old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)
        if then:
            then(spark.read.schema(CHANGES).parquet(f"{state_path}/{n}"), n)

    w = changes.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=interval) if interval else w.trigger(availableNow=True)).start()
