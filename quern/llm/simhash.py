"""SimHash near-dedup by recursive coordinate filtering (operator 9)."""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.blocks import by_key, forest, split_hot
from quern.llm.common import MIX, components, discard, mix64, named, packed, row_key, scratch, some, table

#: Words of a shingle; bits of a fingerprint; similarity (Jaccard of shingle sets) from which texts are linked.
SHINGLE, BITS, SIMILAR = 5, 128, 0.8
#: A strip is 7 coordinates; its filters are the 16 words of a perfect code, within weight 1 of one of which any
#: pattern lies. Lists of about LEAF fingerprints end the recursion; RECALL is the share of pairs just at the
#: threshold that the repeats find; MOST fingerprints of one list are compared in a task.
STRIP, LEAF, RECALL, MOST = 7, 600, 0.985, 3_000
#: Nearest candidates of a list that a class is first held against; shingles of a block whose sets meet in a task.
RANKS, BLOCK_SHINGLES = 3, 2_000_000
_WORD = re.compile(r"\w+")


def _bits_apart(similar: float) -> float:
    """Share of bits in which fingerprints of sets of this Jaccard similarity (and equal size) differ."""
    return math.acos(2 * similar / (1 + similar)) / math.pi


def candidates_within(similar: float = SIMILAR, bits: int = BITS) -> int:
    """Distance that pairs just at the threshold stay within but for one in some thousands."""
    p = _bits_apart(similar)
    return math.ceil(bits * p + 3.5 * math.sqrt(bits * p * (1 - p)))


def _decode() -> np.ndarray:
    """The code word (0 to 15) within weight 1 of each pattern of 7 bits: the Hamming code."""
    out = np.zeros(128, np.int64)
    for x in range(128):
        bits = [(x >> i) & 1 for i in range(7)]
        syndrome = 0
        for i, b in enumerate(bits):
            if b:
                syndrome ^= i + 1
        if syndrome:
            bits[syndrome - 1] ^= 1
        out[x] = sum(bits[i] << k for k, i in enumerate((2, 4, 5, 6)))
    return out


def _meets(levels: int, within: int) -> np.ndarray:
    """The chance that fingerprints 0 to within bits apart pass the same filters on all strips of one repeat: the sum
    over the ways in which the bits that differ fall into the strips."""
    code, same = _decode(), np.zeros(STRIP + 1)
    for e in range(128):
        same[e.bit_count()] += (code == code[np.arange(128) ^ e]).mean()
    ways, rest = np.ones(1), BITS - STRIP * levels
    for _ in range(levels):
        ways = np.convolve(ways, same)
    return np.array([sum(ways[k] * math.comb(rest, d - k) for k in range(min(d + 1, len(ways)))) / math.comb(BITS, d) for d in range(within + 1)])


def plan(n: int, similar: float = SIMILAR) -> tuple[int, int]:
    """Levels of recursion for n fingerprints and repeats to reach RECALL, over all distances that pairs just at the
    threshold can have: all repeats are of one fingerprint, so pairs further apart than the mean meet less often."""
    levels = min(round(math.log(max(n / LEAF, 1), 16)), BITS // STRIP)  # none: one list of all, as at the recursion's end
    p, within = _bits_apart(similar), candidates_within(similar)
    meets = _meets(levels, within)
    share = np.array([math.comb(BITS, d) * p**d * (1 - p) ** (BITS - d) for d in range(within + 1)])

    def missed(repeats: int) -> float:
        return 1 - share @ (1 - (1 - meets) ** repeats)

    high = 1
    while missed(high) > 1 - RECALL:
        high *= 2
    low = high // 2
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if missed(middle) > 1 - RECALL else (low, middle)
    return levels, high


def shingle_sets(texts) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the five-word shingles of each text: lower-cased words, joined; texts of one
    to four words are one shingle, those without a word have none."""
    found = [_WORD.findall(t.lower()) if t else () for t in texts]
    sizes = np.fromiter((len(f) for f in found), np.int64, len(found))
    flat = np.empty(int(sizes.sum()), object)
    at = 0
    for f in found:
        flat[at : at + len(f)] = f
        at += len(f)
    if not at:
        return [np.zeros(0, np.uint64)] * len(found)
    ids, words = pd.factorize(flat)
    h = pd.util.hash_array(words, categorize=False)[ids]
    with np.errstate(over="ignore"):
        s = np.zeros(max(len(h) - SHINGLE + 1, 0), np.uint64)
        for k in range(SHINGLE):
            s = s * MIX + h[k : k + len(s)]
    s, out, at = mix64(s), [], 0
    for n in sizes:
        if n >= SHINGLE:
            out.append(np.unique(s[at : at + n - SHINGLE + 1]))
        elif n:
            x = np.uint64(n)
            with np.errstate(over="ignore"):
                for y in h[at : at + n]:
                    x = x * MIX + y
            out.append(mix64(np.array([x], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def fingerprint(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits: the sign of the sum over shingles of a random vector of +1 and -1 that the shingle's hash gives."""
    both = np.stack([shingles, mix64(shingles ^ MIX)], 1)
    ones = np.unpackbits(both.view(np.uint8), axis=1).sum(0, dtype=np.int64)
    f = np.packbits(2 * ones > len(shingles)).view(np.int64)
    return int(f[0]), int(f[1])


def _chunks(text: pd.Series, chars: float = 4e6):
    size = text.str.len().fillna(0).to_numpy().cumsum()
    for part in np.split(np.arange(len(text)), np.searchsorted(size, np.arange(chars, size[-1] if len(size) else 0, chars))):
        if len(part):
            yield part


def sketches(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """(id, k row key, digest, size, f0, f1): of each row the 128-bit digest of its set of shingles (null without a
    word), the set's size and its fingerprint."""

    def run(frames):
        for pdf in frames:
            for part in _chunks(pdf.text):
                p = pdf.iloc[part]
                sets = shingle_sets(p.text.tolist())
                f = [fingerprint(s) if len(s) else (None, None) for s in sets]
                out = pd.DataFrame({"id": p.id.to_numpy(), "miss": p.miss.to_numpy(), "k": p.k.to_numpy()})
                out["digest"] = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                out["size"] = [len(s) for s in sets]
                out["f0"], out["f1"] = pd.array([x[0] for x in f], "Int64"), pd.array([x[1] for x in f], "Int64")
                yield out

    # no null ids in pandas, which would make floats of a batch's ids
    own = named(id_col).cast("long")
    d = docs.select(F.coalesce(own, F.lit(0)).alias("id"), own.isNull().alias("miss"), row_key(id_col, text_col).alias("k"), named(text_col).alias("text"))
    out = d.mapInPandas(run, "id long, miss boolean, k string, digest binary, size long, f0 long, f1 long")
    return out.select(F.when(~F.col("miss"), F.col("id")).alias("id"), "k", "digest", "size", "f0", "f1")


def _coordinates(r: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of coordinates in repeat r, and its random centre."""
    rng = np.random.default_rng(1000 + r)
    return rng.permutation(BITS), rng.integers(0, 2, BITS, dtype=np.uint8)


def _strips(f: np.ndarray, r: int, first: int, last: int) -> np.ndarray:
    """Numbers of the filters that fingerprints (n, 2) pass on strips first to last - 1 of repeat r, as one key."""
    order, centre = _coordinates(r)
    bits = np.unpackbits(np.ascontiguousarray(f).view(np.uint8).reshape(len(f), 16), axis=1) ^ centre
    code, key = _decode(), np.zeros(len(f), np.int64)
    for level in range(first, last):
        strip = bits[:, order[level * STRIP : (level + 1) * STRIP]].astype(np.int64) @ (1 << np.arange(STRIP))
        key = key * 16 + code[strip]
    return key


def candidate_lists(classes: DataFrame, n: int, similar: float = SIMILAR) -> DataFrame:
    """Lists of classes(node, size, f0, f1, comp) to be compared, as rows (r, key, lo, hi, block and what classes has).

    Recursion: a fingerprint passes one filter on each strip of a repeat, as many strips as planned for n. Lists of more
    than MOST are dealt into pairs of blocks: filtering them on further strips would part pairs that the planned repeats
    are to find."""
    levels, repeats = plan(n, similar)

    def deal(frames):
        for pdf in frames:
            f = pdf[["f0", "f1"]].to_numpy(np.int64)
            for r in range(repeats):
                yield pd.DataFrame({"r": np.int32(r), "key": _strips(f, r, 0, levels)} | {c: pdf[c].to_numpy() for c in _CLASS})

    rows = classes.select(*_CLASS).mapInPandas(deal, "r int, key long, " + ", ".join(f"{c} long" for c in _CLASS))
    return split_hot(rows, ["r", "key"], "node", MOST)


_CLASS = ["node", "size", "f0", "f1", "comp"]
_LIST = ["r", "key", "lo", "hi"]


def _apart(f: np.ndarray) -> np.ndarray:
    """Bits in which fingerprints (n, 2) differ, each with each; some rows at a time, as a pair of blocks is large."""
    d = np.empty((len(f), len(f)), np.uint8)
    for lo in range(0, len(f), 256):
        part = f[lo : lo + 256]
        d[lo : lo + 256] = np.bitwise_count(part[:, 0][:, None] ^ f[:, 0][None]) + np.bitwise_count(part[:, 1][:, None] ^ f[:, 1][None])
    return d


def _ranks(d: np.ndarray) -> np.ndarray:
    """The rank of each distance in its row."""
    rank = np.empty(d.shape, np.int32)
    for lo in range(0, len(d), 256):
        order = np.argsort(d[lo : lo + 256], axis=1, kind="stable")
        np.put_along_axis(rank[lo : lo + 256], order, np.arange(d.shape[1], dtype=np.int32)[None], 1)
    return rank


def _near(g: pd.DataFrame, within: int, similar: float) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of a list's rows are candidates (within the distance, of sizes that allow the similarity, of different
    components, and of both blocks where it is a pair of blocks), and all distances (255: no candidate for the others)."""
    d = _apart(np.ascontiguousarray(g[["f0", "f1"]].to_numpy(np.int64)).view(np.uint64))
    if g.lo.iloc[0] != g.hi.iloc[0]:
        block = g.block.to_numpy()
        d[block[:, None] == block[None]] = 255
    comp, size = g.comp.to_numpy(), g["size"].to_numpy()
    for lo in range(0, len(d), 256):
        part, here = size[lo : lo + 256, None], slice(lo, lo + 256)
        d[here][(comp[here, None] == comp[None]) | (np.minimum(part, size[None]) < similar * np.maximum(part, size[None]))] = 255
    return d <= within, d


def _first_pairs(lists: DataFrame, within: int, similar: float) -> DataFrame:
    """(a, b, more): of every list the candidates that are among the RANKS nearest of either, and a spanning forest of the
    nearest; and (a, a, more) for each class that has further candidates."""

    def compare(g: pd.DataFrame) -> pd.DataFrame | None:
        near, d = _near(g, within, similar)
        has = np.flatnonzero(near.any(1))
        if not len(has):
            return None
        near, d, node = near[np.ix_(has, has)], d[np.ix_(has, has)], g.node.to_numpy()[has]
        more = np.zeros(len(has), bool)
        if near.sum(1).max() > RANKS:
            now = near & (_ranks(d) < RANKS)
            now |= now.T
            more = (near & ~now).any(1)
            near = now
        a, b = np.nonzero(np.triu(near))
        if more.any():
            tree = forest(d, within)
            a, b = np.concatenate([tree[:, 0], a]), np.concatenate([tree[:, 1], b])
        return pd.DataFrame(
            {"a": np.concatenate([np.minimum(node[a], node[b]), node[more]]), "b": np.concatenate([np.maximum(node[a], node[b]), node[more]]), "more": np.arange(len(a) + int(more.sum())) >= len(a)}
        )

    return by_key(lists, _LIST, compare, "a long, b long, more boolean").distinct()


def _rest(lists: DataFrame, within: int, similar: float) -> DataFrame:
    """(r, key, lo, hi, x, y, part, and what classes has): the classes of every list that have candidates of other
    components, in pairs x <= y of parts of at most BLOCK_SHINGLES shingles (or one class)."""

    def compare(g: pd.DataFrame) -> pd.DataFrame | None:
        near, _ = _near(g, within, similar)
        has = np.flatnonzero(near.any(1))
        if not len(has):
            return None
        g, near = g.iloc[has], near[np.ix_(has, has)]
        part = (np.cumsum(g["size"].to_numpy()) // BLOCK_SHINGLES).astype(np.int32)
        out = []
        for x in np.unique(part):
            for y in np.unique(part[part >= x]):
                if near[np.ix_(part == x, part == y)].any():
                    out.append(g[(part == x) | (part == y)].assign(x=x, y=y, part=part[(part == x) | (part == y)]))
        return pd.concat(out)[[*_LIST, "x", "y", "part", "block", "node", "size", "f0", "f1", "comp"]] if out else None

    return by_key(lists, _LIST, compare, "r int, key long, lo int, hi int, x int, y int, part int, block int, node long, size long, f0 long, f1 long, comp long")


def _settled(rest: DataFrame, sets: DataFrame, within: int, similar: float) -> DataFrame:
    """(a, b): verified links that connect all components that candidates of rest link. A pair whose sides are connected
    by then is not looked at again, so a group of m near copies costs some m comparisons."""

    def compare(g: pd.DataFrame) -> pd.DataFrame | None:
        near, d = _near(g, within, similar)
        if g.x.iloc[0] != g.y.iloc[0]:
            part = g.part.to_numpy()
            near &= part[:, None] != part[None]
        i, j = np.nonzero(np.triu(near))
        order = np.argsort(d[i, j], kind="stable")
        s, node = [np.frombuffer(x, np.uint64) for x in g.s], g.node.to_numpy()
        up = {c: c for c in g.comp}

        def root(c):
            while up[c] != c:
                up[c] = up[up[c]]
                c = up[c]
            return c

        comp, out = g.comp.to_numpy(), []
        for x, y in zip(i[order], j[order]):
            p, q = root(comp[x]), root(comp[y])
            if p != q and _jaccard(s[x], s[y]) >= similar:
                up[max(p, q)] = min(p, q)
                out.append((min(node[x], node[y]), max(node[x], node[y])))
        return pd.DataFrame(out, columns=["a", "b"]) if out else None

    return by_key(rest.join(sets, "node"), [*_LIST, "x", "y"], compare, "a long, b long").distinct()


def _jaccard(x: np.ndarray, y: np.ndarray) -> float:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(len(x) + len(y) - both, 1)


def _sets(classes: DataFrame, nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, s): the sets of shingles of these classes, read from the text of one row of each."""

    def run(frames):
        for pdf in frames:
            for part in _chunks(pdf.text):
                p = pdf.iloc[part]
                yield pd.DataFrame({"node": p.node.to_numpy(), "s": [x.tobytes() for x in shingle_sets(p.text.tolist())]})

    one = classes.join(nodes, "node").select(F.col("first.k").alias("k"), "node")
    d = docs.select(row_key(id_col, text_col).alias("k"), named(text_col).alias("text")).join(one, "k")
    return d.select("node", "text").mapInPandas(run, "node long, s binary").dropDuplicates(["node"])


def _verified(edges: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """Of the edges those whose texts' sets of shingles have a Jaccard similarity of at least similar, exactly."""

    @F.pandas_udf("double")
    def jaccard(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([_jaccard(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(a, b)], dtype="float64")

    pairs = edges.join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a")
    pairs = pairs.join(sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
    return pairs.where(jaccard("sa", "sb") >= similar).select("a", "b")


def linked_classes(classes: DataFrame, docs: DataFrame, n: int, similar: float, id_col: str, text_col: str) -> DataFrame:
    """(node, component): what verified links connect, in two rounds.

    First each class is held against its RANKS nearest of each list and a spanning forest of the list; the classes with
    further candidates then meet again, with the sets of shingles themselves, and every pair that the links found by then
    do not connect is looked at. So no candidate pair across groups is passed over, no task emits the pairs of a group,
    and the number of jobs is the same at every size (but for the rounds of components, which grow with the diameter)."""
    spark, within = docs.sparkSession, candidates_within(similar)
    found = scratch(spark, _first_pairs(candidate_lists(classes.withColumn("comp", F.col("node")), n, similar), within, similar), "pairs")
    edges = found.where("not more").select("a", "b")
    ends = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    sets = scratch(spark, _sets(classes, ends, docs, id_col, text_col), "shingles")
    good = scratch(spark, _verified(edges, sets, similar), "links")
    part = components(good)
    more = found.where("more").select(F.col("a").alias("node")).distinct()
    if not some(more):
        return part
    left = classes.join(more, "node").join(part, "node", "left").withColumn("comp", F.coalesce("component", "node"))
    rest = scratch(spark, _rest(candidate_lists(left, n, similar), within, similar), "rest")
    new = scratch(spark, _settled(rest, sets, within, similar), "links") if some(rest) else None
    if new is None or not some(new):
        return part
    label = lambda side: part.select(F.col("node").alias(side), F.col("component").alias(f"c{side}"))
    over = new.join(label("a"), "a", "left").join(label("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    top = components(over).select(F.col("node").alias("component"), F.col("component").alias("top"))
    # a class may be a component of its own, which part does not have
    alone = top.join(part.select("component").distinct(), "component", "left_anti").select(F.col("component").alias("node"), F.col("top").alias("component"))
    moved = part.join(top, "component", "left").select("node", F.coalesce("top", "component").alias("component"))
    return moved.union(alone)


def groups(docs: DataFrame, similar: float = SIMILAR, id_col="doc_id", text_col="text") -> DataFrame:
    """(id, k row key, group_id, first_k): near-duplicate groups of all rows; first_k is the key of the row that stays.

    Rows with the same set of shingles are one class. Classes are linked where the Jaccard similarity of their sets is
    at least similar; groups are what links connect, group_id is the smallest id in a group (null where all its ids are).
    Null texts and texts without a word are groups of their own; repeated rows are copies; ids may repeat; an empty
    table has no groups. Nothing of a group meets in one task but what a list of the recursion holds; components are
    found by joins. Texts reach Python in Arrow batches, which Spark bounds in bytes, and in parts of some MB of them,
    or one text."""
    spark = docs.sparkSession
    s = scratch(spark, sketches(docs, id_col, text_col), "sketches")
    known = s.where("digest is not null")
    first = F.struct(F.col("id").isNull().alias("last"), F.col("id").alias("id"), F.col("k").alias("k"))
    classes = known.groupBy("digest").agg(F.first("size").alias("size"), F.first("f0").alias("f0"), F.first("f1").alias("f1"), F.min(first).alias("first"))
    classes = scratch(spark, classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    part = linked_classes(classes, docs, classes.count(), similar, id_col, text_col)
    of_class = classes.select("digest", "node", "first").join(part, "node", "left").withColumn("component", F.coalesce("component", "node"))
    of_class = scratch(spark, of_class.select("digest", "component", "first"), "heads")
    of_group = of_class.groupBy("component").agg(F.min("first").alias("first"))
    heads = scratch(spark, of_class.select("digest", "component").join(of_group, "component").select("digest", "first"), "heads")
    discard(of_class)
    out = s.select("id", "k", "digest").join(heads, "digest", "left")
    return out.select("id", "k", F.coalesce(F.col("first.id"), "id").alias("group_id"), F.coalesce(F.col("first.k"), "k").alias("first_k"))


def drop_near_copies(docs: DataFrame, similar: float = SIMILAR, id_col="doc_id", text_col="text") -> DataFrame:
    """docs with one row of each group, the one of the smallest id (null last; then of the least row key); all columns as
    they are, whatever their names. Of wholly repeated rows one stays. Null texts and texts without a word stay, one of
    each id; an empty table stays empty."""
    g = groups(docs, similar, id_col, text_col)
    stay = scratch(docs.sparkSession, g.where("k = first_k").groupBy("k").agg(F.count(F.lit(1)).alias("n")), "stay")
    out = docs.select(packed(docs), row_key(id_col, text_col).alias("k")).join(stay, "k")
    if some(stay.where("n > 1")):
        out = out.where("n = 1").union(out.where("n > 1").dropDuplicates(["k"]))
    return out.select("row.*")


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its group and whether it is the one that stays. Null and empty texts are groups of their own;
    of rows that repeat an id and a text all are marked as kept or none; an empty table gives no rows."""
    g = groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return g.select(F.col("id").alias("doc_id"), "group_id", (F.col("k") == F.col("first_k")).alias("kept"))
