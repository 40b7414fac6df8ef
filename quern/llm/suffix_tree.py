"""Language-model scoring with a probabilistic suffix tree (operator 1)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import MIX, Lookup, mix64, modulus, named, scratch, table, text_bytes

#: A word can be part of a context, or be predicted by one, from this share of all tokens on (and two occurrences): the
#: vocabulary, of 1 / share = 2,000,000 words at most, which fits 21 bits and is what is broadcast. Contexts and strings
#: (a context and the next word) have no such bound: a string counts from MIN_COUNT on, a context by the divergence test.
WORD_SHARE, MIN_COUNT, DEPTH = 5e-7, 2, 3
#: Taken off each counted string for what a state has not seen; nats of likelihood that a counted string has to bring.
DISCOUNT, DIVERGENCE = 0.75, 1.0
#: Characters of texts that are packed together; bytes of text whose words a bucket takes; occurrences from which a word's
#: contexts are dealt out to several buckets.
CHUNK_CHARS, BATCH_BYTES, HOT = 4_000_000, 6_000_000, 400_000
END = np.uint64(0x5BD1E995A5A5A5A5)
PAD = 0.1


def token_hashes(texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts, one after the other, and their numbers: words [^\\x20\\x09-\\x0D]+ with A-Z
    lower-cased, then the end."""
    found = [t.encode("utf-8", "surrogatepass").lower().split() if t else () for t in texts]
    sizes = np.fromiter((len(f) + 1 for f in found), np.int64, len(found))
    flat = np.empty(int(sizes.sum()) - len(found), object)
    at = 0
    for f in found:
        flat[at : at + len(f)] = f
        at += len(f)
    ids, words = pd.factorize(flat) if at else (np.zeros(0, np.int64), np.zeros(0, object))
    h = np.full(int(sizes.sum()), END)
    inner = np.ones(len(h), bool)
    inner[np.cumsum(sizes) - 1] = False
    if at:
        h[inner] = pd.util.hash_array(words, categorize=False)[ids]
    return h, sizes


def _chunks(pdf: pd.DataFrame):
    size = pdf.text.str.len().fillna(0).to_numpy().cumsum()
    for part in np.split(np.arange(len(pdf)), np.searchsorted(size, np.arange(CHUNK_CHARS, size[-1] if len(size) else 0, CHUNK_CHARS))):
        if len(part):
            yield pdf.iloc[part]


def pack(*arrays: np.ndarray) -> bytes:
    z = zstandard.ZstdCompressor(level=1)
    parts = [z.compress(np.ascontiguousarray(a).tobytes()) for a in arrays]
    return np.array([len(arrays), *map(len, parts)], np.int64).tobytes() + b"".join(parts)


def unpack(blob: bytes, *kinds) -> list[np.ndarray]:
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    sizes, at, out, z = np.frombuffer(blob, np.int64, n, 8), 8 * (n + 1), [], zstandard.ZstdDecompressor()
    for size, kind in zip(sizes, kinds):
        out.append(np.frombuffer(z.decompress(blob[at : at + size]), kind))
        at += int(size)
    return out


def _delta(sorted_keys: np.ndarray) -> np.ndarray:
    return np.diff(sorted_keys, prepend=np.uint64(0))


def _count(docs: DataFrame) -> DataFrame:
    """(w, c): training tokens by hash, summed over the tasks' own sums."""

    def run(frames):
        keys, counts = [], []
        total = 0
        for pdf in frames:
            for part in _chunks(pdf[pdf.train]):
                u, c = np.unique(token_hashes(part.text)[0], return_counts=True)
                keys.append(u), counts.append(c)
                total += len(u)
                if total > 3_000_000:
                    u, back = np.unique(np.concatenate(keys), return_inverse=True)
                    yield pd.DataFrame({"w": u.view(np.int64), "c": np.bincount(back, np.concatenate(counts)).astype(np.int64)})
                    keys, counts, total = [], [], 0
        if keys:
            u, back = np.unique(np.concatenate(keys), return_inverse=True)
            yield pd.DataFrame({"w": u.view(np.int64), "c": np.bincount(back, np.concatenate(counts)).astype(np.int64)})

    return docs.select("text", "train").mapInPandas(run, "w long, c long").groupBy("w").agg(F.sum("c").alias("c"))


@dataclass
class Words:
    """The vocabulary, by hash, and what smooths all."""

    find: Lookup
    p: np.ndarray  # base probability of each
    total: int
    distinct: int
    parts: np.ndarray  # buckets that the contexts that end with the word are dealt out to

    def base(self, c: np.ndarray) -> np.ndarray:
        return (c + PAD) / (self.total + PAD * (self.distinct + 1))


def _places(words: Words, h: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Of each token its number (-1: rare), and those of the tokens one, two ... DEPTH before it (-1: none, rare, or beyond
    a rare one)."""
    s = words.find(h)
    starts = np.cumsum(sizes) - sizes
    place = np.arange(len(s)) - np.repeat(starts, sizes)
    before, ok = [], np.ones(len(s), bool)
    for d in range(1, DEPTH + 1):
        one = np.full(len(s), -1, np.int64)
        one[d:] = s[: max(len(s) - d, 0)]
        ok = ok & (place >= d) & (one >= 0)
        before.append(np.where(ok, one, -1))
    return s, before


def _contexts(before: list[np.ndarray]) -> np.ndarray:
    """A context as one key: 21 bits for each word, the nearer first, so that a context's extensions sort next to it."""
    key = np.zeros(len(before[0]), np.uint64)
    for one in before:
        key = (key << np.uint64(21)) | (one + 1).astype(np.uint64)
    return key


def _bucket(words: Words, near: np.ndarray, part: np.ndarray, buckets: int) -> np.ndarray:
    return (mix64(near.astype(np.uint64) * MIX + part.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def _part(words: Words, near: np.ndarray, far: np.ndarray) -> np.ndarray:
    """The part of a hot word's contexts that one belongs to, by the word before it."""
    return (mix64((far + 1).astype(np.uint64)) % words.parts[near].astype(np.uint64)).astype(np.int64)


def _hot_pairs(docs: DataFrame, sent) -> DataFrame:
    """(near, symbol, c): how often each symbol (-1: any rare word) follows a hot word in training texts."""

    def run(frames):
        words, keys, counts, total = sent.value, [], [], 0

        def flush():
            u, back = np.unique(np.concatenate(keys), return_inverse=True)
            c = np.bincount(back, np.concatenate(counts)).astype(np.int64)
            keys.clear(), counts.clear()
            return pd.DataFrame({"near": (u >> np.uint64(21)).astype(np.int64), "symbol": (u & np.uint64((1 << 21) - 1)).astype(np.int64) - 1, "c": c})

        for pdf in frames:
            for part in _chunks(pdf[pdf.train]):
                s, before = _places(words, *token_hashes(part.text))
                near = before[0]
                hot = near >= 0
                hot[hot] = words.parts[near[hot]] > 1
                u, c = np.unique((near[hot].astype(np.uint64) << np.uint64(21)) | (s[hot] + 1).astype(np.uint64), return_counts=True)
                keys.append(u), counts.append(c)
                total += len(u)
                if total > 3_000_000:
                    yield flush()
                    total = 0
        if keys:
            yield flush()

    return docs.select("text", "train").mapInPandas(run, "near long, symbol long, c long").groupBy("near", "symbol").agg(F.sum("c").alias("c"))


def _grown(words: Words, key: np.ndarray, sym: np.ndarray, c: np.ndarray, pairs: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The probability of each string (context key, symbol; sorted by them, each once), c: its training count.

    Level by level: the contexts of d words are runs of the sorted keys. Of each, the strings of MIN_COUNT or more give
    their discounted share; the context is a state if that makes its own continuations likelier than its suffix's
    distribution by more than DIVERGENCE a string; what it leaves goes to the suffix. Rare symbols have what their states
    leave them of 1, to be multiplied with their base probability. pairs: (near, symbol) keys and counts of hot words."""
    p = np.where(sym >= 0, words.p[np.maximum(sym, 0)], 1.0)
    for d in range(1, DEPTH + 1):
        ctx = key >> np.uint64(21 * (DEPTH - d))
        live = np.flatnonzero((ctx & np.uint64((1 << 21) - 1)) > 0)
        if not len(live):
            break
        node = np.cumsum(np.append(True, ctx[live][1:] != ctx[live][:-1])) - 1
        n = int(node[-1]) + 1
        # one entry for each symbol of a context of d words
        u, first, back = np.unique((node.astype(np.uint64) << np.uint64(21)) | (sym[live] + 1).astype(np.uint64), return_index=True, return_inverse=True)
        count, at, s, q = np.bincount(back, c[live]), node[first], sym[live][first], p[live][first]
        if d == 1 and len(pairs[0]):
            near = (ctx[live] - np.uint64(1)).astype(np.int64)
            hot_node = np.zeros(n, bool)
            hot_node[node] = words.parts[near] > 1
            # what follows a hot word stands in other buckets too: its counts come with the pairs
            of = np.full(len(words.p), -1)
            of[near] = node
            pn = of[(pairs[0] >> np.uint64(21)).astype(np.int64)]
            ok = pn >= 0
            u2 = (pn[ok].astype(np.uint64) << np.uint64(21)) | (pairs[0][ok] & np.uint64((1 << 21) - 1))
            own = ~hot_node[at]
            merged, place = np.unique(np.concatenate([u[own], u2, u[~own]]), return_inverse=True)
            count2 = np.bincount(place[: own.sum() + len(u2)], np.concatenate([count[own], pairs[1][ok]]), len(merged))
            s_all = (merged & np.uint64((1 << 21) - 1)).astype(np.int64) - 1
            back, u, count, at, s = np.searchsorted(merged, u)[back], merged, count2, (merged >> np.uint64(21)).astype(np.int64), s_all
            q = np.where(s >= 0, words.p[np.maximum(s, 0)], 1.0)
        total = np.bincount(at, count, n)
        keep = (count >= MIN_COUNT) & (s >= 0)
        a = np.where(keep, (count - DISCOUNT) / np.maximum(total[at], 1), 0.0)
        left, kinds = 1 - np.bincount(at, a, n), np.bincount(at, keep, n)
        rest = total - np.bincount(at, count * keep, n)
        own = a + left[at] * q
        gain = np.bincount(at[keep], count[keep] * np.log(own[keep] / q[keep]), n) + rest * np.log(np.maximum(left, 1e-12))
        state = (kinds > 0) & (gain > DIVERGENCE * (1 + kinds))
        p[live] = np.where(state[node], own[back], p[live])
    return p


def _score(docs: DataFrame, pairs: DataFrame | None, sent, buckets: int) -> DataFrame:
    """Scans all texts once more. Every token with a context goes, packed with others of its batch, to the bucket of the
    context's nearest word (a part of it, if the word is hot), which counts the training ones, grows its part of the tree
    and scores all; rare words go to a bucket that knows their count. Both come back as sums to the batch of texts."""

    def scan(frames):
        words, part_no, n = sent.value, TaskContext.get().partitionId(), 0
        for pdf in frames:
            for part in _chunks(pdf):
                h, sizes = token_hashes(part.text)
                s, before = _places(words, h, sizes)
                doc = np.repeat(np.arange(len(sizes), dtype=np.uint32), sizes)
                known, m = s >= 0, len(sizes)
                base = np.where(known, np.log10(words.p[np.maximum(s, 0)]), 0.0)
                batch = (part_no << 24) + n
                n += 1
                train = part.train.to_numpy(bool)
                held = before[0] >= 0
                ids, miss = part.doc_id.to_numpy(np.int64), part.miss.to_numpy(bool)
                own = pack(ids, miss, train, sizes, np.bincount(doc, known, m).astype(np.int64), np.bincount(doc, base, m), np.bincount(doc, np.where(held, 0.0, base), m))
                rows = [(batch % buckets, batch, 0, own)]
                key, symbol, d = _contexts(before)[held], (s[held] + 1).astype(np.uint32), doc[held]
                bucket = _bucket(words, before[0][held], _part(words, before[0][held], before[1][held]), buckets)
                order = np.lexsort((symbol, key, bucket))
                ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
                for b in np.flatnonzero(np.diff(ends)):
                    at = order[ends[b] : ends[b + 1]]
                    rows.append((int(b), batch, 1, pack(_delta(key[at]), symbol[at], (d[at] << np.uint32(1)) | train[d[at]])))
                w, d, y = h[~known], doc[~known], train[doc[~known]]
                order = np.lexsort((d, w))
                w, d, y = w[order], d[order], y[order]
                bucket = (w >> np.uint64(33)) % np.uint64(buckets)
                by = np.argsort(bucket, kind="stable")
                ends = np.searchsorted(bucket[by], np.arange(buckets + 1, dtype=np.uint64))
                for b in np.flatnonzero(np.diff(ends)):
                    at = by[ends[b] : ends[b + 1]]
                    rows.append((int(b), batch, 2, pack(_delta(w[at]), d[at], y[at])))
                yield pd.DataFrame(rows, columns=["bucket", "batch", "kind", "blob"]).assign(near=0, symbol=0, c=0)

    def sums(batch, doc, known, base, score):
        docs_, back = np.unique(doc, return_inverse=True)
        return (batch, False, pack(docs_.astype(np.uint32), np.bincount(back, known).astype(np.int64), np.bincount(back, base), np.bincount(back, score)))

    def rare(words, parts):
        parts.sort(key=lambda x: x[0])
        seen, train = [], []
        for _, blob in parts:
            d, _, y = unpack(blob, np.uint64, np.uint32, bool)
            seen.append(np.cumsum(d, dtype=np.uint64)), train.append(y)
        u, c = np.unique(np.concatenate(seen)[np.concatenate(train)], return_counts=True)
        find, c = Lookup(u), np.append(c, 0)
        for (batch, blob), w in zip(parts, seen):
            count = c[find(w)]
            logs = np.log10(words.base(count))
            yield sums(batch, unpack(blob, np.uint64, np.uint32, bool)[1], count > 0, logs, logs)

    def frequent(words, parts, pairs):
        parts.sort(key=lambda x: x[0])
        batches, keys, symbols, docs_ = [], [], [], []
        while parts:  # from the last on; what is unpacked goes
            batch, blob = parts.pop()
            d, symbol, doc = unpack(blob, np.uint64, np.uint32, np.uint32)
            batches.append((batch, len(doc))), keys.append(np.cumsum(d, dtype=np.uint64)), symbols.append(symbol), docs_.append(doc)
        key, symbol, doc = np.concatenate(keys), np.concatenate(symbols), np.concatenate(docs_)
        del keys, symbols, docs_
        order = np.lexsort((symbol, key))
        new = np.append(True, (key[order][1:] != key[order][:-1]) | (symbol[order][1:] != symbol[order][:-1]))
        string = np.empty(len(order), np.int64)
        string[order] = np.cumsum(new) - 1
        heads = order[new]
        key, symbol = key[heads], symbol[heads].astype(np.int64) - 1
        del order, new, heads
        logs, at = np.log10(_grown(words, key, symbol, np.bincount(string, doc & 1), pairs))[string], 0
        del string, key, symbol
        for batch, n in batches:
            zero = np.zeros(n)
            yield sums(batch, doc[at : at + n] >> np.uint32(1), zero, zero, logs[at : at + n])
            at += n

    def meet(frames):
        words, got = sent.value, {}
        for pdf in frames:
            own = pdf[pdf.kind == 0]
            if len(own):
                yield pd.DataFrame({"batch": own.batch, "own": True, "blob": own.blob})
            rest = pdf[(pdf.kind == 1) | (pdf.kind == 2)]
            for bucket, batch, kind, blob in zip(rest.bucket, rest.batch, rest.kind, rest.blob):
                got.setdefault(bucket, ([], [], []))[kind].append((batch, blob))
            hot = pdf[pdf.kind == 3]
            for bucket, g in hot.groupby("bucket"):
                key = (g.near.to_numpy().astype(np.uint64) << np.uint64(21)) | (g.symbol.to_numpy() + 1).astype(np.uint64)
                got.setdefault(bucket, ([], [], []))[0].append((key, g.c.to_numpy().astype(np.float64)))
        while got:
            _, (hot, strings, words_) = got.popitem()
            pairs = tuple(np.concatenate(x) for x in zip(*hot)) if hot else (np.zeros(0, np.uint64), np.zeros(0))
            out = list(frequent(words, strings, pairs)) if strings else []
            out += rare(words, words_) if words_ else []
            if out:
                yield pd.DataFrame(out, columns=["batch", "own", "blob"])

    def gather(frames):
        own, more = {}, {}
        for pdf in frames:
            for batch, is_own, blob in zip(pdf.batch, pdf.own, pdf.blob):
                if is_own:
                    own[batch] = blob
                else:
                    more.setdefault(batch, []).append(blob)
        total = sent.value.total
        for batch, blob in own.items():
            ids, miss, train, sizes, known, base, score = (x.copy() for x in unpack(blob, np.int64, bool, bool, np.int64, np.int64, np.float64, np.float64))
            got = [unpack(b, np.uint32, np.int64, np.float64, np.float64) for b in more.pop(batch, [])]
            for d, k, b, p in sorted(got, key=lambda x: (len(x[0]), x[0].tobytes(), x[3].tobytes())):  # one order of adding: reruns agree
                known[d] += k
                base[d] += b
                score[d] += p
            yield pd.DataFrame(
                {"doc_id": pd.arrays.IntegerArray(ids, miss), "held_out": ~train, "n_tokens": sizes, "n_known": known, "train_tokens": total, "base_score": base, "score": score}
            )

    out = docs.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("miss"), "text", "train")
    out = out.mapInPandas(scan, "bucket long, batch long, kind int, blob binary, near long, symbol long, c long")
    if pairs is not None:

        def deal(frames):
            words = sent.value
            for pdf in frames:
                near = pdf.near.to_numpy()
                times = words.parts[near]
                row = np.repeat(np.arange(len(pdf)), times)
                part = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                dealt = pd.DataFrame({"bucket": _bucket(words, near[row], part, buckets), "batch": 0, "kind": 3, "blob": None, "near": near[row], "symbol": pdf.symbol.to_numpy()[row], "c": pdf.c.to_numpy()[row]})
                # parts of one word may share a bucket, which needs its pairs once
                yield dealt.drop_duplicates(["bucket", "near", "symbol"])

        out = out.union(pairs.mapInPandas(deal, "bucket long, batch long, kind int, blob binary, near long, symbol long, c long"))
    out = out.repartition(buckets, "bucket").mapInPandas(meet, "batch long, own boolean, blob binary")
    return out.repartition(buckets, "batch").mapInPandas(
        gather, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )


def score_documents(docs: DataFrame, train, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row, by a suffix tree that is fitted
    on the rows for which train (a column) holds.

    The tree's root is the smoothed unigram distribution over all words. A context of one to DEPTH words of the vocabulary
    is a state if predicting by it, rather than by its longest suffix that is a state, makes its own continuations likelier
    by more than DIVERGENCE a string; its distribution is discounted and smoothed by its suffix's. A token is scored by
    the longest state that its context ends with. Null texts are empty and score their end; rows that share an id are
    scored each; with no training rows every token has the same probability; no rows give none; other columns don't
    matter.

    Only the vocabulary is broadcast; no task holds the tree: a bucket grows the subtrees of its words and scores the
    tokens that come with them. A word of more than HOT occurrences is dealt out by the word before it, and what follows
    it is counted beforehand, with a combine before the shuffle, and sent to all its parts."""
    spark = docs.sparkSession
    d = docs.select(named(id_col).cast("long").alias("doc_id"), named(text_col).alias("text"), train.alias("train"))
    buckets = max(8, -(-text_bytes(d, "text") // BATCH_BYTES))
    counts = scratch(spark, _count(d), "words")
    total, distinct = counts.agg(F.sum("c"), F.count(F.lit(1))).first()
    total = total or 0
    often = counts.where(F.col("c") >= max(2.0, WORD_SHARE * total)).toPandas().sort_values(["c", "w"], ascending=[False, True])
    c = often.c.to_numpy(np.int64)
    words = Words(Lookup(often.w.to_numpy(np.int64).view(np.uint64)), np.ones(1), total, distinct, 1 + c // HOT)
    words.p = words.base(c) if len(c) else np.ones(1)
    if not len(c):
        words.parts = np.ones(1, np.int64)
    sent = spark.sparkContext.broadcast(words)
    pairs = scratch(spark, _hot_pairs(d, sent), "pairs") if (words.parts > 1).any() else None
    return _score(d, pairs, sent, buckets)


def op1_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens, base score and score, from rows whose crc32 of the id is not 0 modulo 10 (a null id counts
    as the empty text). Null texts score their end; repeated rows are scored each; an empty table gives no rows."""
    return score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), modulus("doc_id", 10) != 0)
