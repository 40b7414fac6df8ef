"""Removal of long repeated byte strings over a whole corpus by prefix-free parsing (operator 4).

Prefix-free parsing cuts a text at rolling-hash triggers, so that equal text gives equal phrases wherever it stands. Here
the trigger of a window of WINDOW bytes is the least hash of its K-byte strings: every window has one, so none is missed,
and the windows that share a trigger form a phrase. Phrases overlap by WINDOW - 1 bytes, as prefix-free ones do, so every
window lies inside one phrase. The distinct phrases are the dictionary, the phrases of all texts in corpus order the
parse.

The parse is sorted by phrase, then by corpus order: of each phrase the first occurrence is kept, all windows of the
others are repeats. (A suffix array of the parse sorts by further phrases too; they decide nothing, as no window reaches
beyond its phrase.) Equal windows of different phrases have the same trigger, so the dictionary is dealt out by trigger,
and each part's suffix array, by prefix doubling up to WINDOW bytes, has them next to each other; with the corpus order of
the phrases' first occurrences it tells which window is the first."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import Lookup, mix64, named, scratch, table, text_bytes
from quern.llm.suffix_tree import pack, unpack

WINDOW, K = 100, 20
CHUNK_BYTES, BATCH_BYTES, PARTS = 1_500_000, 20_000_000, 8
#: The dictionary of a trigger with more distinct phrases than this is dealt out by window (128-bit digests) instead.
HOT = 4_000
_RNG = np.random.default_rng(11)
_BYTE = _RNG.integers(1, 1 << 63, (2, 256), dtype=np.int64).astype(np.uint64)
_BASE = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_INVERSE = tuple(np.uint64(pow(int(b), -1, 1 << 64)) for b in _BASE)
_POWERS: dict = {}
_LAST = np.iinfo(np.int64).max


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    if which not in _POWERS or len(_POWERS[which][0]) < n:
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            up = np.full(size, _BASE[which])
            up[0] = 1
            down = np.full(size, _INVERSE[which])
            down[0] = 1
            _POWERS[which] = (np.cumprod(up), np.cumprod(down))
    return _POWERS[which]


class Rolling:
    """Hashes of any substring of a byte array, from sums of byte values times powers of an odd base modulo 2 ** 64."""

    def __init__(self, data: np.ndarray, which: int = 0):
        self.up, self.down = _powers(which, len(data) + 1)
        with np.errstate(over="ignore"):
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[which][data] * self.up[: len(data)], dtype=np.uint64)])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.sums[end] - self.sums[start]) * self.down[start]


def phrases(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Of texts data[starts:ends] the runs of windows that share a trigger: text, first and last window start (in
    data), hash of the trigger, hash of all the run's bytes."""
    n = len(data)
    if n < WINDOW:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    roll = Rolling(data)
    at = np.arange(n - K + 1)
    h = mix64(roll(at, at + K))
    m = (h & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    span, w = WINDOW - K + 1, 1
    while w * 2 <= span:
        m = np.minimum(m[:-w], m[w:])
        w *= 2
    m = np.minimum(m[: len(m) - (span - w)], m[span - w :]) if span > w else m
    trigger = (m & np.uint64(0xFFFFFFFF)).astype(np.int64)  # of each window start
    doc = np.repeat(np.arange(len(starts)), ends - starts)
    ok = np.flatnonzero(doc[: len(trigger)] == doc[WINDOW - 1 : WINDOW - 1 + len(trigger)])
    if not len(ok):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    new = np.ones(len(ok), bool)
    new[1:] = (trigger[ok[1:]] != trigger[ok[:-1]]) | (doc[ok[1:]] != doc[ok[:-1]])
    first = ok[new]
    last = ok[np.append(np.flatnonzero(new)[1:] - 1, len(ok) - 1)]
    t = trigger[first]
    with np.errstate(over="ignore"):
        shape = ((t - first).astype(np.uint64) << np.uint64(32)) | (last - first).astype(np.uint64)
        whole = mix64(roll(first, last + WINDOW) + mix64(shape))
    return doc[first], first - starts[doc[first]], last - starts[doc[first]], h[t], whole


def _texts(pdf: pd.DataFrame):
    """Chunks of rows: rows, the texts' bytes end to end, starts and ends."""
    raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in pdf.text]
    size = np.cumsum([len(r) for r in raw]) if raw else np.zeros(0, np.int64)
    for part in np.split(np.arange(len(raw)), np.searchsorted(size, np.arange(CHUNK_BYTES, size[-1] if len(size) else 0, CHUNK_BYTES))):
        if len(part):
            lens = np.array([len(raw[i]) for i in part])
            yield pdf.iloc[part], np.frombuffer(b"".join(raw[i] for i in part), np.uint8), np.cumsum(lens) - lens, np.cumsum(lens)


def _by_bucket(bucket: np.ndarray, n: int, *arrays: np.ndarray) -> list[tuple[int, bytes]]:
    order = np.argsort(bucket, kind="stable")
    ends = np.searchsorted(bucket[order], np.arange(n + 1))
    return [(int(b), pack(*(a[order[ends[b] : ends[b + 1]]] for a in arrays))) for b in np.flatnonzero(np.diff(ends))]


def _doc_bucket(k: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of a document, of its hash as the JVM reckons it: pmod(k, buckets)."""
    return k % buckets


def _later(keys: list[np.ndarray], ids: np.ndarray, k: np.ndarray, at: np.ndarray):
    """Sorts by keys, then document, then place. Returns the order, where a group of equal keys begins in it, and
    which entries are not their group's first (nor the same place of a repeated row)."""
    order = np.lexsort([at, k, ids, *keys[::-1]])
    new = np.ones(len(order), bool)
    if len(order) > 1:
        new[1:] = np.any([x[order[1:]] != x[order[:-1]] for x in keys], axis=0)
    head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    later = (ids[order] != ids[head]) | (k[order] != k[head]) | (at[order] != at[head])
    return order, new, later


def suffix_ranks(text: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The places of the windows text[s:s+WINDOW] in the sorted order of windows; equal windows share theirs.

    The suffix array of text, cut off at WINDOW bytes, by prefix doubling: ranks of 8-byte strings, of 16, 32 and 64 from
    pairs of ranks, and of WINDOW from the two of 64 that cover a window. The bytes themselves are compared, not hashes."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(WINDOW, np.uint8)])
    key, width = np.zeros(n, np.uint64), 8
    for k in range(width):
        key = (key << np.uint64(8)) | padded[k : k + n]
    rank = np.unique(key, return_inverse=True)[1]
    while width * 2 <= WINDOW:
        after = np.zeros(n, np.int64)  # beyond the end: rank 0, which no window reads
        after[: n - width] = rank[width:]
        rank = np.unique((rank << 32) | after, return_inverse=True)[1]
        width *= 2
    return np.unique((rank[starts] << 32) | rank[starts + WINDOW - width], return_inverse=True)[1]


def _find(docs: DataFrame, buckets: int) -> DataFrame:
    """(db, blob): for each bucket of documents runs of windows (k, first, last, trigger, what) where what is 1 for
    windows that also start earlier, 2 for a distinct phrase whose trigger others share, 3 the same with a hot trigger."""

    def parse(frames):
        for pdf in frames:
            for part, data, starts, ends in _texts(pdf):
                doc, first, last, trigger, whole = phrases(data, starts, ends)
                if not len(doc):
                    continue
                ids, k = part.doc_id.to_numpy(np.int64)[doc], part.k.to_numpy(np.int64)[doc]
                order, new, later = _later([trigger, whole], ids, k, first)
                again = order[later]
                rows = [(b % buckets, True, b, blob) for b, blob in _by_bucket(_doc_bucket(k[again], buckets), buckets, k[again], first[again].astype(np.uint32), last[again].astype(np.uint32), trigger[again], np.ones(len(again), np.uint8))]
                own = np.sort(order[new])
                arrays = trigger[own], whole[own], ids[own], k[own], first[own].astype(np.uint32), (last - first)[own].astype(np.uint8)
                rows += [(b, False, 0, blob) for b, blob in _by_bucket(((trigger[own] >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64), buckets, *arrays)]
                yield pd.DataFrame(rows, columns=["bucket", "done", "db", "blob"])

    def meet(frames):
        held: dict[int, list] = {}
        for pdf in frames:
            if pdf.done.any():
                yield pdf.loc[pdf.done, ["db", "blob"]]
            for bucket, done, blob in zip(pdf.bucket, pdf.done, pdf.blob):
                if not done:
                    held.setdefault(bucket, []).append(unpack(blob, np.uint64, np.uint64, np.int64, np.int64, np.uint32, np.uint8))
        while held:
            trigger, whole, ids, k, first, more = (np.concatenate(x) for x in zip(*held.popitem()[1]))
            order, new, later = _later([trigger, whole], ids, k, first)
            heads = order[new]  # one of each distinct phrase, sorted by trigger
            _, at, n = np.unique(trigger[heads], return_inverse=True, return_counts=True)
            shared = n[at] > 1
            pick = np.concatenate([order[later], heads[shared]])
            what = np.concatenate([np.ones(int(later.sum()), np.uint8), np.where(n[at][shared] > HOT, 3, 2).astype(np.uint8)])
            if len(pick):
                rows = _by_bucket(_doc_bucket(k[pick], buckets), buckets, k[pick], first[pick], first[pick] + more[pick], trigger[pick], what)
                yield pd.DataFrame(rows, columns=["db", "blob"])

    out = docs.select("doc_id", "k", "text").mapInPandas(parse, "bucket int, done boolean, db int, blob binary")
    return out.repartition(buckets, "bucket").mapInPandas(meet, "db int, blob binary")


def _flags(blobs) -> tuple[Lookup, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Runs of windows by document: a lookup of k, and where each one's runs begin and end in the arrays."""
    got = [unpack(b, np.int64, np.uint32, np.uint32, np.uint64, np.uint8) for b in blobs]
    k, first, last, trigger, what = (np.concatenate(x) for x in zip(*got)) if got else (np.zeros(0, t) for t in (np.int64, np.uint32, np.uint32, np.uint64, np.uint8))
    order = np.argsort(k, kind="stable")
    u, begin = np.unique(k[order], return_index=True)
    return Lookup(u.view(np.uint64)), begin, np.append(begin[1:], len(k)), [x[order].astype(np.int64) if x.dtype == np.uint32 else x[order] for x in (first, last, trigger, what)]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept): of every row what is left when each byte covered by a
    WINDOW-byte string that also starts earlier goes.

    Earlier is a smaller id (null ids last), then for rows of one id a smaller hash of the row, then an earlier start;
    rows of the same id and text are one document and have one result. Null texts are empty. Matches don't cross
    rows. Strings are judged on the input. No rows give no rows.

    Texts travel once, to buckets of their hash of BATCH_BYTES on average, which a task holds whole (or one text, if that
    is larger); what travels for each phrase is two hashes and its place. Phrases are merged by task before they travel.
    The phrases of one trigger are counted in one task, 33 bytes for each distinct one of each part of CHUNK_BYTES of
    text; where they are more than HOT, their windows are dealt out."""
    spark = docs.sparkSession
    d = docs.select(named(id_col).cast("long").alias("doc_id"), named(text_col).alias("text"))
    d = d.withColumn("k", F.xxhash64("doc_id", "text", F.col("text").isNull()))
    # no null ids in pandas, which would make floats of a batch's ids
    d = d.select("text", "k", F.col("doc_id").isNull().alias("miss"), F.coalesce("doc_id", F.lit(_LAST)).alias("doc_id"))
    buckets = max(8, -(-text_bytes(d, "text") // BATCH_BYTES))
    found = scratch(spark, _find(d, buckets), "repeats")

    homed = d.withColumn("db", F.pmod("k", F.lit(buckets)).cast("int")).repartition(buckets, "db")

    parts = PARTS * buckets  # a suffix array takes some 60 bytes for each of its text

    def contexts(_, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        find, begin, end, (first, last, trigger, what) = _flags(right.blob)
        out = []
        for part, data, starts, ends in _texts(left):
            which = find(part.k.to_numpy(np.int64).view(np.uint64))
            picks = [(i, np.arange(begin[w], end[w])[what[begin[w] : end[w]] > 1]) for i, w in enumerate(which) if w >= 0]
            picks = [(i, x) for i, x in picks if len(x)]
            if not picks:
                continue
            row = np.concatenate([np.full(len(x), i) for i, x in picks])
            run = np.concatenate([x for _, x in picks])
            ids, k = part.doc_id.to_numpy(np.int64)[row], part.k.to_numpy(np.int64)[row]
            hot = what[run] == 3
            cold = np.flatnonzero(~hot)
            lens = last[run[cold]] - first[run[cold]] + WINDOW
            where = starts[row[cold]] + first[run[cold]]
            bucket = ((trigger[run[cold]] >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(parts + 1))
            for b in np.flatnonzero(np.diff(cuts)):
                o = order[cuts[b] : cuts[b + 1]]
                text = b"".join(data[s : s + n].tobytes() for s, n in zip(where[o], lens[o]))
                out.append((int(b), 0, pack(ids[cold[o]], k[cold[o]], first[run[cold[o]]], lens[o], np.frombuffer(text, np.uint8))))
            if hot.any():
                hr = run[hot]
                n = last[hr] - first[hr] + 1
                at = np.repeat(first[hr] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                src = np.repeat(row[hot], n)
                s = starts[src] + at
                one, two = mix64(Rolling(data)(s, s + WINDOW)), mix64(Rolling(data, 1)(s, s + WINDOW))
                ids, k = np.repeat(ids[hot], n), np.repeat(k[hot], n)
                out += [(b, 1, blob) for b, blob in _by_bucket((one % np.uint64(parts)).astype(np.int64), parts, one, two, ids, k, at)]
        return pd.DataFrame(out, columns=["bucket", "hot", "blob"])

    def settle(frames):
        held: dict[int, list] = {}
        for pdf in frames:
            for bucket, hot, blob in zip(pdf.bucket, pdf.hot, pdf.blob):
                held.setdefault(bucket, []).append((hot, blob))
        while held:
            texts, hot_parts = [], []
            for hot, blob in held.popitem()[1]:
                if hot:
                    hot_parts.append(unpack(blob, np.uint64, np.uint64, np.int64, np.int64, np.int64))
                else:
                    texts.append(unpack(blob, np.int64, np.int64, np.int64, np.int64, np.uint8))
            found = []
            if texts:
                ids, k, first, lens, text = (np.concatenate(x) for x in zip(*texts))
                n, begin = lens - WINDOW + 1, np.cumsum(lens) - lens
                step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                rank = suffix_ranks(text, np.repeat(begin, n) + step)
                again = np.flatnonzero(np.bincount(rank)[rank] > 1)
                phrase = np.repeat(np.arange(len(n)), n)[again]
                found.append(([rank[again]], ids[phrase], k[phrase], first[phrase] + step[again]))
            if hot_parts:
                one, two, ids, k, at = (np.concatenate(x) for x in zip(*hot_parts))
                found.append(([one, two], ids, k, at))
            repeats = []
            for keys, ids, k, at in found:
                order, _, later = _later(keys, ids, k, at)
                repeats.append((k[order[later]], at[order[later]]))
            k, at = (np.concatenate(x) for x in zip(*repeats))
            pick = np.lexsort([at, k])
            if len(pick):
                new = np.ones(len(pick), bool)
                new[1:] = (k[pick[1:]] != k[pick[:-1]]) | (at[pick[1:]] - at[pick[:-1]] > 1)
                first, last = pick[new], pick[np.append(np.flatnonzero(new)[1:] - 1, len(pick) - 1)]
                m = len(first)
                rows = _by_bucket(_doc_bucket(k[first], buckets), buckets, k[first], at[first].astype(np.uint32), at[last].astype(np.uint32), np.zeros(m, np.uint64), np.ones(m, np.uint8))
                yield pd.DataFrame(rows, columns=["db", "blob"])

    def finish(_, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        find, begin, end, (first, last, _t, what) = _flags(right.blob)
        out = []
        for part, data, starts, ends in _texts(left):
            which = find(part.k.to_numpy(np.int64).view(np.uint64))
            marks = np.zeros(len(data) + 1, np.int32)
            for s, w in zip(starts, which):
                if w >= 0:
                    r = np.arange(begin[w], end[w])
                    r = r[what[r] == 1]
                    np.add.at(marks, s + first[r], 1)
                    np.add.at(marks, s + last[r] + WINDOW, -1)
            gone = np.cumsum(marks)[:-1] > 0
            for doc_id, miss, s, e in zip(part.doc_id, part.miss, starts, ends):
                g = gone[s:e]
                kept = data[s:e][~g].tobytes()
                spans = int(g[:1].sum() + (g[1:] & ~g[:-1]).sum())
                out.append((None if miss else int(doc_id), e - s, int(g.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
        return pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]).assign(doc_id=lambda f: pd.array([x[0] for x in out], "Int64"))

    by_home = homed.groupBy("db")
    met = by_home.cogroup(found.groupBy("db")).applyInPandas(contexts, "bucket int, hot int, blob binary")
    settled = met.repartition(parts, "bucket").mapInPandas(settle, "db int, blob binary")
    settled = scratch(spark, settled, "settled")
    return homed.groupBy("db").cogroup(found.union(settled).groupBy("db")).applyInPandas(
        finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    )


def op4_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its bytes, those removed and their runs, and the digest of what is left. Null texts are empty;
    rows of one id and text are one document; an empty table gives no rows."""
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("kept")
