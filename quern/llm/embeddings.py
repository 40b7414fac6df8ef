"""Embedding near-dedup: iterative quantisation, multi-index tables, exact rerank (operator 10)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.blocks import by_key, forest, split_hot
from quern.llm.common import components, discard, named, scratch, table

#: Vectors that the rotations are learned on, at most, and their bytes; rounds of learning; bits of a code.
MAX_FIT, MAX_FIT_BYTES, ROUNDS, BITS = 10_000, 64_000_000, 30, 64
#: Share of the pairs just at the threshold that the tables are to find; vectors of one group compared in a task.
RECALL, MOST = 0.98, 2_000
#: A group with more candidate pairs than this for each of its vectors is compared where it lies, with the vectors, if it
#: has more than SMALL of them.
SPARSE, SMALL = 4, 24


def _sound(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))


def _unit(vectors, dim: int) -> np.ndarray:
    x = np.zeros((len(vectors), dim))
    for i, v in enumerate(vectors):
        x[i, : len(v)] = v
    x /= np.maximum(np.abs(x).max(1, keepdims=True), 1e-300)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def learn(x: np.ndarray, rotations: int, seed: int = 3) -> np.ndarray:
    """Per rotation the (dim, BITS) projection whose signs are the code: a basis of the space (a random one of BITS
    dimensions where it has more), turned again and again to lessen the distance of the data to the corners of the cube.

    Nothing is taken off and no axis is dropped for all rotations: what two vectors share in a mean or in minor axes
    is part of their cosine, and without it the angle that tables_for() reckons with would be wider."""
    rng, out, dim = np.random.default_rng(seed), [], x.shape[1]
    k = min(dim, BITS)
    for _ in range(rotations):
        axes = np.linalg.qr(rng.standard_normal((dim, k)))[0] if dim > BITS else np.eye(dim)
        p, bits = x @ axes, []
        for _ in range(-(-BITS // k)):
            r = np.linalg.qr(rng.standard_normal((k, k)))[0]
            for _ in range(ROUNDS):
                u, _, vt = np.linalg.svd(np.where(p @ r >= 0, 1.0, -1.0).T @ p) if len(p) else (r.T, 0, np.eye(k))
                r = (u @ vt).T
            bits.append(axes @ r)
        out.append(np.hstack(bits)[:, :BITS])
    return np.stack(out)


def tables_for(n: int, threshold: float) -> tuple[int, int]:
    """Bits of a table's key, about as many as leave a few vectors a key, and how many tables reach RECALL."""
    bits = min(32, max(6, round(math.log2(max(n, 2))) - 3))
    one = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - RECALL) / math.log(1 - one))


def candidates_within(threshold: float) -> int:
    """Hamming distance of whole codes that pairs at the threshold stay within but for one in ten thousands."""
    p = math.acos(threshold) / math.pi
    return math.ceil(BITS * p + 4 * math.sqrt(BITS * p * (1 - p)))


class Tables:
    """The multi-index tables: rotations of BITS bits each, cut into keys."""

    def __init__(self, rotations: np.ndarray, bits: int, n: int, within: int):
        self.rotations, self.bits, self.n, self.within, self.per = rotations, bits, n, within, BITS // bits
        self.low = np.uint64((1 << bits) - 1)

    def codes(self, x: np.ndarray) -> np.ndarray:
        """(vectors, rotations) codes."""
        return np.stack([np.packbits(x @ p >= 0, axis=1, bitorder="little").view(np.uint64)[:, 0] for p in self.rotations], 1)

    def place(self, t: int) -> tuple[int, np.uint64]:
        """The rotation of a table, and the shift of its key."""
        return t // self.per, np.uint64(t % self.per * self.bits)

    def meet(self, a: np.ndarray, b: np.ndarray, t: int) -> np.ndarray:
        """Whether codes, which broadcast, are candidates of table t: equal keys, whole codes within the distance."""
        r, shift = self.place(t)
        x = a[..., r] ^ b[..., r]
        return (((x >> shift) & self.low) == 0) & (np.bitwise_count(x) <= self.within)

    def earlier(self, a: np.ndarray, b: np.ndarray, t: int) -> np.ndarray:
        """Whether codes are candidates of a table before t."""
        out = np.zeros(np.broadcast_shapes(a.shape[:-1], b.shape[:-1]), bool)
        for s in range(t):
            out |= self.meet(a, b, s)
        return out


_GROUP = ["table", "key", "lo", "hi"]


def _candidates(rows: DataFrame, tables: Tables) -> DataFrame:
    """(a, b, table) for the candidate pairs of sparse groups, (table, key, lo, hi, block, node) for the members of
    dense ones (a is null)."""

    def compare(g: pd.DataFrame) -> pd.DataFrame | None:
        code, node, block = g.code.to_numpy().view(np.uint64), g.node.to_numpy(), g.block.to_numpy()
        near = np.empty((len(g), len(g)), bool)
        for lo in range(0, len(g), 256):
            near[lo : lo + 256] = np.bitwise_count(code[lo : lo + 256, None] ^ code[None]) <= tables.within
        if g.lo.iloc[0] != g.hi.iloc[0]:
            near &= block[:, None] != block[None]
        np.fill_diagonal(near, False)
        has = np.flatnonzero(near.any(1))
        if not len(has):
            return None
        one = {c: int(g[c].iloc[0]) for c in _GROUP}
        if near.sum() // 2 <= SPARSE * len(has):
            a, b = np.nonzero(np.triu(near))
            return pd.DataFrame(one | {"block": 0, "node": -1, "a": np.minimum(node[a], node[b]), "b": np.maximum(node[a], node[b])})
        return pd.DataFrame(one | {"block": block[has], "node": node[has], "a": -1, "b": -1})

    def small(g: pd.DataFrame, of: np.ndarray) -> pd.DataFrame:
        code, node, block, whole = g.code.to_numpy().view(np.uint64), g.node.to_numpy(), g.block.to_numpy(), (g.lo == g.hi).to_numpy()
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for apart in range(1, SMALL):
            i = np.flatnonzero(of[apart:] == of[:-apart])
            j = i + apart
            near = (np.bitwise_count(code[i] ^ code[j]) <= tables.within) & (whole[i] | (block[i] != block[j]))
            left.append(i[near]), right.append(j[near])
        i, j = np.concatenate(left), np.concatenate(right)
        return pd.DataFrame({c: g[c].to_numpy()[i] for c in _GROUP} | {"block": 0, "node": -1, "a": np.minimum(node[i], node[j]), "b": np.maximum(node[i], node[j])})

    return by_key(rows, _GROUP, compare, "table int, key long, lo int, hi int, block int, node long, a long, b long", small, SMALL)


def _sparse_links(pairs: DataFrame, vectors: DataFrame, tables: Tables, threshold: float, dim: int) -> DataFrame:
    """(a, b, na, nb, new) of the candidate pairs that are links; new where no dense group counts the pair."""

    @F.pandas_udf("link boolean, new boolean")
    def compare(ra: pd.Series, rb: pd.Series, ca: pd.Series, cb: pd.Series, t: pd.Series) -> pd.DataFrame:
        link, new = np.zeros(len(t), bool), np.zeros(len(t), bool)
        for lo in range(0, len(t), 1000):
            here = slice(lo, lo + 1000)
            va, vb = ([np.frombuffer(x, np.float64) for x in r.iloc[here]] for r in (ra, rb))
            size = np.array([len(x) == len(y) for x, y in zip(va, vb)], bool)
            link[here] = size & ((_unit(va, dim) * _unit(vb, dim)).sum(1) >= threshold)
            a, b = (np.stack([np.frombuffer(x, np.uint64) for x in c.iloc[here]]) for c in (ca, cb))
            for k in np.unique(t.iloc[here]):
                at = lo + np.flatnonzero(t.iloc[here].to_numpy() == k)
                new[at] = ~tables.earlier(a[at - lo], b[at - lo], int(k))
        return pd.DataFrame({"link": link, "new": new})

    side = lambda x: vectors.select(F.col("node").alias(x), F.col("n").alias("n" + x), F.col("raw").alias("r" + x), F.col("codes").alias("c" + x))
    out = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("got", compare("ra", "rb", "ca", "cb", "table"))
    return out.where("got.link").select("a", "b", "na", "nb", F.col("got.new").alias("new"))


def _dense_links(members: DataFrame, vectors: DataFrame, tables: Tables, threshold: float, dim: int) -> DataFrame:
    """(a, b, links): a spanning forest of each dense group's links (links 0), and of its vectors (a = b) the links that
    no earlier table has."""

    def compare(g: pd.DataFrame) -> pd.DataFrame | None:
        node, n, block, t = g.node.to_numpy(), g.n.to_numpy(), g.block.to_numpy(), int(g.table.iloc[0])
        arrays = [np.frombuffer(b, np.float64) for b in g.raw]
        x, size = _unit(arrays, dim), np.array([len(a) for a in arrays])
        codes = np.stack([np.frombuffer(c, np.uint64) for c in g.codes])
        links, count = np.zeros((len(g), len(g)), bool), np.zeros(len(g), np.int64)
        for lo in range(0, len(g), 256):
            here = slice(lo, lo + 256)
            part = (x[here] @ x.T >= threshold) & (size[here, None] == size[None]) & (node[here, None] != node[None])
            if g.lo.iloc[0] != g.hi.iloc[0]:
                part &= block[here, None] != block[None]
            part &= tables.meet(codes[here, None], codes[None], t)
            links[here] = part
            count[here] = (part & ~tables.earlier(codes[here, None], codes[None], t)) @ n
        if not links.any():
            return None
        tree, told = forest(np.where(links, 0.0, 9.0), 1.0), np.flatnonzero(count)
        return pd.DataFrame(
            {"a": np.concatenate([node[tree[:, 0]], node[told]]), "b": np.concatenate([node[tree[:, 1]], node[told]]), "links": np.concatenate([np.zeros(len(tree), np.int64), count[told]])}
        )

    return by_key(members.join(vectors, "node"), _GROUP, compare, "a long, b long, links long")


def linked(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, n_links, component_id, kept) for every row.

    Vectors that are null, empty, zero or hold null or non-finite parts link with nothing; vectors of different
    lengths don't link. Equal vectors are one class with a count, so a vector said a million times costs one row; a
    row's links are the others of its class and all rows of the classes linked with it. component_id is the least id
    that is not null of what links connect; where all ids of a component are null, it is null and all its rows are kept.
    Repeated ids count as vectors of their own. No rows give no rows.

    Into the tables go nodes and codes, not vectors. Classes that share a key in a table and whose whole codes are near
    are candidates; in groups with few of them they leave as pairs, each once, and are compared in double precision with
    the vectors; in groups with many the vectors come to the group, are compared there, and only their numbers of links
    and a spanning forest leave the task. Either way a pair counts in the first table that has it as candidate. Groups of
    more than MOST classes are dealt into pairs of blocks. Rotations are learned on a hash sample of MAX_FIT classes at
    most, all rows are indexed."""
    spark = vectors.sparkSession
    v = vectors.select(named(id_col).alias("id"), F.transform(named(vec_col), lambda x: x + F.lit(0.0).cast("float")).alias("v"))
    good = v.where(_sound(F.col("v")))
    classes = good.groupBy("v").agg(F.min("id").alias("c"), F.count(F.lit(1)).alias("n")).withColumn("node", F.monotonically_increasing_id())
    classes = scratch(spark, classes, "classes")
    total, dim = classes.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    dim = dim or 1
    bits, n_tables = tables_for(total, threshold)
    most = max(1, min(MAX_FIT, MAX_FIT_BYTES // (8 * dim)))
    sample = classes if total <= most else classes.where(F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < int(most / total * (1 << 30)))
    x = _unit(sample.select("v").toPandas().v.tolist(), dim)
    tables = Tables(learn(x[np.lexsort(x.T[::-1])], -(-n_tables // (BITS // bits))), bits, n_tables, candidates_within(threshold))
    sent = spark.sparkContext.broadcast(tables.rotations)
    tables.rotations = None

    def encode(frames):
        here = Tables(sent.value, bits, n_tables, tables.within)
        for pdf in frames:
            for lo in range(0, len(pdf), 500):
                part = pdf.iloc[lo : lo + 500]
                codes = here.codes(_unit(part.v.tolist(), dim))
                raw = [np.asarray(a, np.float64).tobytes() for a in part.v]
                yield pd.DataFrame({"node": part.node.to_numpy(), "n": part.n.to_numpy(), "raw": raw, "codes": [c.tobytes() for c in codes]})

    def index(frames):
        for pdf in frames:
            code = np.stack([np.frombuffer(c, np.uint64) for c in pdf.codes]) if len(pdf) else np.zeros((0, 1), np.uint64)
            for t in range(n_tables if len(pdf) else 0):
                r, shift = tables.place(t)
                yield pd.DataFrame({"table": np.int32(t), "key": ((code[:, r] >> shift) & tables.low).view(np.int64), "node": pdf.node.to_numpy(), "code": code[:, r].view(np.int64)})

    encoded = scratch(spark, classes.select("node", "n", "v").mapInPandas(encode, "node long, n long, raw binary, codes binary"), "vectors")
    rows = encoded.select("node", "codes").mapInPandas(index, "table int, key long, node long, code long")
    found = scratch(spark, _candidates(split_hot(rows, ["table", "key"], "node", MOST), tables), "candidates")
    pairs = found.where("a >= 0").groupBy("a", "b").agg(F.min("table").alias("table"))
    one = scratch(spark, _sparse_links(pairs, encoded, tables, threshold, dim), "links")
    two = scratch(spark, _dense_links(found.where("a < 0").drop("a", "b"), encoded, tables, threshold, dim), "links")
    counts = one.where("new").select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("nb").alias("links")), F.struct(F.col("b").alias("node"), F.col("na").alias("links")))).alias("x")).select("x.*")
    counts = counts.union(two.where("a = b").select("a", "links")).groupBy("node").agg(F.sum("links").alias("links"))
    part = components(one.select("a", "b").union(two.where("a <> b").select("a", "b")).distinct())
    of = classes.select("v", "c", "n", "node").join(part, "node", "left").withColumn("component", F.coalesce("component", "node")).join(counts, "node", "left")
    least = of.groupBy("component").agg(F.min("c").alias("component_id"))
    of = of.join(least, "component").select("v", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id", F.lit(True).alias("in"))
    of = scratch(spark, of, "heads")
    discard(found, one, two, encoded)
    out = v.withColumn("v", F.when(F.coalesce(_sound(F.col("v")), F.lit(False)), F.col("v"))).join(of, "v", "left")
    component = F.when(F.col("in"), F.col("component_id")).otherwise(F.col("id"))
    out = out.select("id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector with its direct links, the least vec_id that links reach and whether that is its own. Null, zero and
    non-finite vectors have no links; repeated rows are vectors of their own; an empty table gives no rows."""
    return linked(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
