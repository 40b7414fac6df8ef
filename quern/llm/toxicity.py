"""Toxicity by class-conditional Kneser-Ney models (operator 5)."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import MIX, Lookup, mix64, modulus, named, table

#: Labelled rows that the model is fitted on, at most (about: rows are chosen by a hash of their id), and the bytes of
#: their texts, at most (the bound on rows is lowered where texts are long).
MAX_FIT_ROWS, MAX_FIT_BYTES = 4_000, 64_000_000
#: Longest n-gram of characters; absolute discount; pseudo counts of either class that both together deal out.
ORDER, DISCOUNT, STRENGTH = 5, 0.75, 1.0
#: Share of words of a toxic text that the toxic model speaks; the others are ordinary ones.
SHARE = 0.002
FOLDS, CELLS = 3, 400_000
_WORD = re.compile(r"\w+")


def words_of(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words, the number of the word at each place of the texts one after the other, words of each text."""
    found = [_WORD.findall(t.lower()) if t else () for t in texts]
    sizes = np.fromiter((len(f) for f in found), np.int64, len(found))
    flat = np.empty(int(sizes.sum()), object)
    at = 0
    for f in found:
        flat[at : at + len(f)] = f
        at += len(f)
    if not at:
        return np.zeros(0, object), np.zeros(0, np.int64), sizes
    ids, words = pd.factorize(flat)
    return words, ids, sizes


def _parts(words: np.ndarray):
    """Places of the words, in parts of words of much the same length and CELLS characters at most (or one word)."""
    size = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    order, lo = np.argsort(size, kind="stable"), 0
    size = size[order]
    while lo < len(order):
        hi = lo + 1 + int(np.searchsorted(size[lo + 1 :] * np.arange(2, len(order) - lo + 1), CELLS, "right"))
        yield order[lo:hi]
        lo = hi


def _grams(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(orders, words, places) hashes of the n-grams that end at each place of ^word$, 0 where there is none, and
    (words, places): whether a character to predict stands there. Whole words, whatever their length."""
    width = max((len(w) for w in words), default=0) + 2
    raw = np.array(["\x01" + w + "\x02" for w in words], dtype=f"U{width}") if len(words) else np.zeros(0, f"U{width}")
    c = raw.view(np.uint32).reshape(len(raw), width).astype(np.uint64)
    out = np.zeros((ORDER, *c.shape), np.uint64)
    with np.errstate(over="ignore"):
        out[0] = np.where(c > 0, mix64(c * MIX + np.uint64(1)), 0)
        for k in range(1, ORDER):
            prev = out[k - 1, :, :-1]
            out[k, :, 1:] = np.where((prev > 0) & (c[:, 1:] > 0), mix64(prev * MIX + c[:, 1:] + np.uint64(k + 1)), 0)
    real = c > 0
    real[:, 0] = False
    return out, real


@dataclass
class Model:
    """Class-conditional Kneser-Ney models over the characters of a word; bounded by the rows it was fitted on."""

    find: Lookup
    top: np.ndarray  # (n + 1, 2): discounted part of an n-gram's last character in either class; last row: unseen
    after: Lookup
    back: np.ndarray  # (n + 1, 2): back-off weight after a context in either class; last row: unseen
    weights: np.ndarray

    def likelihoods(self, words: np.ndarray) -> np.ndarray:
        """(words, 2): log probability of each word in the ordinary and the toxic model."""
        out = np.zeros((len(words), 2))
        for part in _parts(words):
            grams, real = _grams(words[part])
            w, j = np.nonzero(real)
            p = np.full((len(w), 2), 1e-4)  # below single characters: the same for both classes
            for k in range(ORDER):
                ctx = grams[k - 1, w, j - 1] if k else np.ones(len(w), np.uint64)
                live = np.flatnonzero(ctx)
                weight = self.back[self.after(ctx[live])]
                p[live] = self.top[self.find(grams[k, w[live], j[live]])] + weight * p[live]
            for c in (0, 1):
                out[part, c] = np.bincount(w, np.log(p[:, c]), len(real))
        return out

    def features(self, texts) -> np.ndarray:
        words, ids, sizes = words_of(texts)
        doc, ids = _once(ids, sizes, len(words))
        return _features(self.likelihoods(words)[ids], doc, len(sizes))

    def score(self, texts) -> np.ndarray:
        x = self.features(texts) @ self.weights
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _once(ids: np.ndarray, sizes: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, word) pairs without repeats: a word said a thousand times in a text counts once."""
    once = np.unique(np.repeat(np.arange(len(sizes)), sizes) * max(n_words, 1) + ids)
    return once // max(n_words, 1), once % max(n_words, 1)


def _features(logs: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Per text: 1, and by how much its toxic log-likelihood is above its ordinary one, normalised by the length (its
    distinct words) and by the root of it. A toxic text is ordinary words but for a SHARE that the toxic model speaks, so
    a word has (1 - SHARE) of its ordinary and SHARE of its toxic probability."""
    n = np.maximum(np.bincount(doc, minlength=n_docs), 1)
    gain = np.logaddexp(np.log(1 - SHARE), np.log(SHARE) + logs[:, 1] - logs[:, 0])
    total = np.bincount(doc, gain, n_docs)
    return np.stack([np.ones(n_docs), total / n, total / np.sqrt(n)], 1)


def _distinct(*columns: np.ndarray) -> np.ndarray:
    """Places of the first of each distinct row of the columns."""
    order = np.lexsort(columns[::-1])
    new = np.ones(len(order), bool)
    if len(order) > 1:
        new[1:] = np.any([c[order[1:]] != c[order[:-1]] for c in columns], axis=0)
    return order[new]


def _counted(words: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n-grams, their contexts, counts (n-grams, 2) in the classes). n: of each word the texts of either class that hold
    it. N-grams of the highest order, and those that begin a word, count their occurrences; others the distinct
    characters that stand before them: the continuation counts of Kneser and Ney, by class."""
    raw: list[list] = [[] for _ in range(ORDER)]
    for part in _parts(words):
        grams, real = _grams(words[part])
        w, j = np.nonzero(real)
        for k in range(ORDER):
            g, c = grams[k, w, j], grams[k - 1, w, j - 1] if k else np.ones(len(w), np.uint64)
            ok = np.flatnonzero((g > 0) & (c > 0))
            left = grams[k + 1, w[ok], j[ok]] if k + 1 < ORDER else np.zeros(len(ok), np.uint64)  # 0: nothing before it
            raw[k].append(_summed(g[ok], c[ok], left, n[part[w[ok]]]))
            if len(raw[k]) > 20:
                raw[k] = [_summed(*(np.concatenate(x) for x in zip(*raw[k])))]
    out = []
    for k in range(ORDER):
        if raw[k]:
            g, c, left, m = _summed(*(np.concatenate(x) for x in zip(*raw[k])))
            m = np.where((left > 0)[:, None], (m > 0).astype(np.float64), m)
            g, c, _, m = _summed(g, c, np.zeros(len(g), np.uint64), m)
            out.append((g, c, m))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros((0, 2))
    return tuple(np.concatenate(x) for x in zip(*out))


def _summed(g: np.ndarray, ctx: np.ndarray, left: np.ndarray, m: np.ndarray):
    """The counts m summed by n-gram and what stands before it (an n-gram has one context)."""
    order = np.lexsort((left, g))
    g, ctx, left, m = g[order], ctx[order], left[order], m[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (left[1:] != left[:-1])
    at = np.cumsum(new) - 1
    return g[new], ctx[new], left[new], np.stack([np.bincount(at, m[:, c], int(new.sum())) for c in (0, 1)], 1)


def _fit(words, ids, sizes, toxic, weights=None) -> Model:
    """Counts a word once for each document that holds it, so copies within one don't count."""
    doc, ids = _once(ids, sizes, len(words))
    n = np.stack([np.bincount(ids, toxic[doc] == c, len(words)) for c in (0, 1)], 1)
    words, n = words[n.sum(1) > 0], n[n.sum(1) > 0]
    key, ctx, m = _counted(words, n)
    u, at = np.unique(ctx, return_inverse=True)
    total = np.stack([np.bincount(at, m[:, c], len(u)) for c in (0, 1)], 1)
    kinds = np.stack([np.bincount(at, m[:, c] > 0, len(u)) for c in (0, 1)], 1)
    # Rare expressions lean on back-off counts that the classes share: STRENGTH pseudo counts of either, dealt out (and
    # discounted) as both classes together count
    both, kinds_both, total_both = m.sum(1), np.bincount(at, minlength=len(u)), total.sum(1)
    shared = np.maximum(both - DISCOUNT, 0) / total_both[at]
    top = (np.maximum(m - DISCOUNT, 0) + STRENGTH * shared[:, None]) / (total[at] + STRENGTH)
    away = (DISCOUNT * kinds + (STRENGTH * DISCOUNT * kinds_both / np.maximum(total_both, 1e-300))[:, None]) / (total + STRENGTH)
    top, away = (np.vstack([x, [[last, last]]]).astype(np.float32) for x, last in ((top, 0.0), (away, 1.0)))
    return Model(Lookup(key), top, Lookup(u), away, np.array([0.0, 1.0, 0.0]) if weights is None else weights)


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 50) -> np.ndarray:
    """Newton steps with a small ridge on standardised columns."""
    mean, std = x.mean(0), x.std(0)
    mean[0], std = 0.0, np.where(std > 1e-9, std, 1.0)
    z, b = (x - mean) / std, np.zeros(x.shape[1])
    z[:, 0] = 1
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve((z * w[:, None]).T @ z + 0.5 * np.eye(len(b)), z.T @ (y - p) - 0.5 * b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    out = b / std
    out[0] = b[0] - ((b * mean) / std)[1:].sum()
    return out


def fold_features(texts, toxic) -> np.ndarray:
    """Features of each text under models that are fitted on the texts of the other folds."""
    words, ids, sizes = words_of(texts)
    fold, x = np.arange(len(sizes)) % FOLDS, np.zeros((len(sizes), 3))
    of = np.repeat(fold, sizes)
    for k in range(FOLDS):
        m = _fit(words, ids[of != k], sizes[fold != k], toxic[fold != k])
        own, back = np.unique(ids[of == k], return_inverse=True)
        doc, at = _once(back, sizes[fold == k], len(own))
        x[fold == k] = _features(m.likelihoods(words[own])[at], doc, int((fold == k).sum()))
    return x


def fit(texts, toxic) -> Model:
    """Counts from all given rows; the calibration from scores of each fold under the counts of the others."""
    toxic = np.asarray(toxic, np.int64)
    words, ids, sizes = words_of(texts)
    if len(sizes) < 10 or toxic.min() == toxic.max():
        prior = float(np.clip(toxic.mean() if len(toxic) else 0.0, 0.01, 0.5))
        return _fit(words, ids, sizes, toxic, np.array([np.log(prior / (1 - prior)), 1.0, 0.0]))
    return _fit(words, ids, sizes, toxic, _logistic(fold_features(texts, toxic), toxic))


def fit_on(docs: DataFrame, labels: DataFrame, keep, id_col="doc_id", text_col="text", label_col="toxic", max_rows: int = MAX_FIT_ROWS, max_bytes: int = MAX_FIT_BYTES) -> Model:
    """Fits on the labelled rows for which keep holds, a hash sample of about max_rows ids of them where there are more,
    and less where their texts are more than max_bytes.

    The sample is all that reaches the driver. Rows without a label, null labels and ids, and labels without a row don't
    count; an id with several labels takes the largest; without any row, or with one class only, the prior scores."""
    y = labels.where(named(label_col).isNotNull() & named(id_col).isNotNull() & keep).groupBy(named(id_col).alias("id")).agg(F.max(named(label_col)).alias("y"))
    n = y.count()
    if n > max_rows:
        y = y.where(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 30)) < int(max_rows / n * (1 << 30)))
    # max_rows ids of a number each, which is what may be broadcast
    rows = docs.select(named(id_col).alias("id"), named(text_col).alias("text")).join(F.broadcast(y), "id")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > max_bytes:
        rows = rows.where(F.pmod(F.xxhash64("id", "text", F.lit(6)), F.lit(1 << 30)) < int(max_bytes / size * (1 << 30)))
    rows = rows.toPandas().sort_values(["id", "text"], kind="stable", na_position="first")
    return fit(rows.text.tolist(), rows.y.tolist())


def score_texts(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "toxic_score") -> DataFrame:
    """docs with out_col (0 to 1; it takes the place of a column of that name), all other columns as they are.

    Null and empty texts and those without a word score as a text that says nothing for either class; whole texts are
    read; repeated rows score alike; an empty table stays empty."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        m, out = sent.value, np.empty(len(text))
        size = text.str.len().fillna(0).to_numpy().cumsum()
        for part in np.split(np.arange(len(text)), np.searchsorted(size, np.arange(4e6, size[-1] if len(size) else 0, 4e6))):
            if len(part):
                out[part] = m.score(text.iloc[part].tolist())
        return pd.Series(out)

    return docs.select(*[named(c) for c in docs.columns if c != out_col], score(named(text_col)).alias(out_col))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its score, from labels of the rows whose crc32 of the id is not 1 modulo 3 (a null id counts as
    the empty text). Null and empty texts score as ones that say nothing; an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = modulus("doc_id", 3) == 1
    out = score_texts(docs, fit_on(docs, table(spark, sf_dir, "labels"), ~held))
    return out.select("doc_id", held.alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= 0.7).cast("int").alias("predicted"))
