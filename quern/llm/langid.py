"""Language of words and documents by a linear-chain conditional random field (operator 7)."""

from __future__ import annotations

import re
import sys
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import MIX, mix64, modulus, named, packed, table

#: Labelled rows that the field is fitted on, at most (about: rows are chosen by a hash), and the bytes of their texts, at
#: most (the bound on rows is lowered where texts are long). All words of these rows are used, in chains of CHAIN words.
MAX_FIT_ROWS, MAX_FIT_BYTES, CHAIN = 1_000, 16_000_000, 24
BITS, EPOCHS, RATE, RIDGE = 17, 25, 0.3, 1e-6
#: Bytes of words, with marks and padding, that features are made of at a time (or one word).
CELLS = 400_000


def _letters() -> str:
    """The characters of Unicode's category L as ranges of a regular expression."""
    is_letter = np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    edges = np.flatnonzero(np.diff(is_letter.astype(np.int8), prepend=0, append=0))
    return "".join(f"{re.escape(chr(lo))}-{re.escape(chr(hi - 1))}" for lo, hi in zip(edges[::2], edges[1::2]))


_WORD = re.compile(f"[{_letters()}]+")
#: The same but for numerals such as ½ and Ⅷ, which it takes for letters, and four times as fast.
_NEARLY = re.compile(r"[^\W\d_]+")


def _words(text: str) -> list[str]:
    found = _NEARLY.findall(text)
    return found if not found or "".join(found).isalpha() else _WORD.findall(text)


def words_of(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct runs of letters (lower case), the number of the word at each place, words of each text."""
    found = [_words(t.lower()) if t else () for t in texts]
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
    """(places, bytes) of the words, in parts of words of much the same length and CELLS bytes at most (or one word)."""
    raw = np.empty(len(words), object)
    raw[:] = [w.encode("utf-8", "surrogatepass") for w in words]
    size = np.fromiter((len(b) + 2 for b in raw), np.int64, len(raw))
    order, lo = np.argsort(size, kind="stable"), 0
    size = size[order]
    while lo < len(order):
        hi = lo + 1 + int(np.searchsorted(size[lo + 1 :] * np.arange(2, len(order) - lo + 1), CELLS, "right"))
        yield order[lo:hi], raw[order[lo:hi]], int(size[hi - 1])
        lo = hi


def features(words: np.ndarray, raw: np.ndarray, width: int) -> list[np.ndarray]:
    """Slots in the weight table, a column at a time: the word itself (lexicon), affixes of 1 to 4 bytes and n-grams of 2
    to 4 bytes at every place of the word, whatever its length; 0 is none. width: bytes of the longest with its marks."""
    c = np.array([b"\x01" + b + b"\x02" for b in raw], f"S{width}").view(np.uint8).reshape(len(raw), width).astype(np.uint64)
    n = (c > 0).sum(1)
    out, mask = [], np.uint64((1 << BITS) - 1)

    def slot(h, kind, ok):
        with np.errstate(over="ignore"):
            out.append(np.where(ok, (mix64(h * MIX + np.uint64(kind)) & mask) | np.uint64(1), 0).astype(np.int32))

    with np.errstate(over="ignore"):
        grams, prefix = c, c[:, 0]
        for k in range(1, min(5, width)):  # prefixes
            prefix = prefix * np.uint64(257) + c[:, k]
            slot(prefix, 100 + k, n > k)
        suffix = np.zeros(len(raw), np.uint64)
        rows = np.arange(len(raw))
        for k in range(5):  # suffixes, end mark first
            at = np.maximum(n - 1 - k, 0)
            suffix = suffix * np.uint64(257) + c[rows, at]
            if k:
                slot(suffix, 200 + k, n > k)
        for k in (2, 3, 4):
            grams = grams[:, :-1] * np.uint64(257) + c[:, k - 1 :]
            for j in range(width - k + 1):
                slot(grams[:, j], 300 + k, n >= j + k)
    slot(pd.util.hash_array(words, categorize=False) if len(words) else np.zeros(0, np.uint64), 400, np.ones(len(raw), bool))
    return out


def slots(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, slot) of all features of the words."""
    rows, found = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    for at, raw, width in _parts(words):
        for column in features(words[at], raw, width):
            ok = column > 0
            rows.append(at[ok].astype(np.int32)), found.append(column[ok])
    return np.concatenate(rows), np.concatenate(found)


def _spread(e: np.ndarray, go: np.ndarray, sizes: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over chains laid end to end. e: (words, labels) potentials, scaled. Returns each word's
    marginals and the summed expected transitions."""
    k = e.shape[1]
    order = np.argsort(-sizes, kind="stable")
    sizes, first = sizes[order], (np.cumsum(sizes) - sizes)[order]
    live = np.searchsorted(-sizes, -np.arange(sizes[0] if len(sizes) else 0), side="left")  # chains longer than t
    alpha, beta, pairs = np.empty_like(e), np.empty_like(e), np.zeros((k, k))
    a = np.tile(start, (len(sizes), 1))
    for t, m in enumerate(live):
        at = first[:m] + t
        a = (a[:m] if t == 0 else a[:m] @ go) * e[at]
        a /= a.sum(1, keepdims=True)
        alpha[at] = a
    b = np.ones((len(sizes), k))
    for t in range(len(live) - 1, -1, -1):
        at = first[: live[t]] + t
        beta[at] = b[: live[t]]
        if t:
            x = e[at] * b[: live[t]]
            w = alpha[at - 1][:, :, None] * go[None] * x[:, None, :]
            pairs += (w / w.sum((1, 2), keepdims=True)).sum(0)
            x = x @ go.T
            b[: live[t]] = x / x.sum(1, keepdims=True)
    p = alpha * beta
    return p / p.sum(1, keepdims=True), pairs


@dataclass
class Field:
    labels: list[str]
    weights: np.ndarray  # (2 ** BITS, labels), row 0 is 0
    go: np.ndarray  # (labels, labels) transition scores

    def emissions(self, words: np.ndarray) -> np.ndarray:
        out = np.zeros((len(words), len(self.labels)))
        for at, raw, width in _parts(words):
            e = np.zeros((len(at), len(self.labels)))
            for column in features(words[at], raw, width):
                e += self.weights[column]
            out[at] = e
        return out

    def marginals(self, texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each word's distribution over the labels (a text is one chain), its length, and words of each text."""
        words, ids, sizes = words_of(texts)
        if not len(ids):
            return np.zeros((0, len(self.labels))), np.zeros(0), sizes
        e = self.emissions(words)
        e = np.exp(np.maximum(e - e.max(1, keepdims=True), -30))
        k = len(self.labels)
        p, _ = _spread(e[ids], np.exp(self.go - self.go.max()), sizes[sizes > 0], np.full(k, 1 / k))
        return p, np.array([len(w) for w in words], float)[ids], sizes

    def predict(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """Label (und without a letter) and the share of letters that stand in words of that label."""
        p, letters, sizes = self.marginals(texts)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        share = np.stack([np.bincount(doc, p[:, c] * letters, len(sizes)) for c in range(len(self.labels))], 1)
        whole = share.sum(1)
        best = share.argmax(1)
        score = np.where(whole > 0, share[np.arange(len(sizes)), best] / np.maximum(whole, 1e-300), 0.0)
        label = np.array([*self.labels, "und"], object)[np.where(whole > 0, best, len(self.labels))]
        return label, np.clip(score, 0, 1)


def fit(texts, labels) -> Field:
    """Conditional likelihood by AdaGrad over all words. Chains are runs of CHAIN words of one text; half of them go on
    with a run of another text, so that transitions between languages are learned and code-switched text can be labelled."""
    names = sorted(set(labels))
    y_doc = np.array([names.index(x) for x in labels], np.int64)
    words, ids, sizes = words_of(texts)
    k = len(names)
    w, t = np.zeros((1 << BITS, max(k, 1))), np.zeros((max(k, 1), max(k, 1)))
    if k < 2 or not len(ids):
        return Field(names or ["und"], w, t)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    chain = np.unique(np.stack([doc, place // CHAIN], 1), axis=0, return_inverse=True)[1].ravel()
    rng = np.random.default_rng(7)
    keep = rng.permutation(chain.max() + 1)
    starts, ends = np.searchsorted(chain, keep, "left"), np.searchsorted(chain, keep, "right")
    at = np.concatenate([np.arange(a, b) for a, b in zip(starts, ends)])
    length = ends - starts
    joined = np.arange(len(length)) // 2 * 2 if len(length) > 1 else np.zeros(1, np.int64)
    joined = np.where(np.arange(len(length)) % 4 < 2, joined, np.arange(len(length)))  # every second pair is one chain
    length = np.bincount(np.unique(joined, return_inverse=True)[1].ravel(), length).astype(np.int64)
    used, ids = np.unique(ids[at], return_inverse=True)
    y, (row, slot) = y_doc[doc[at]], slots(words[used])
    prev_ok = np.ones(len(at), bool)
    prev_ok[np.cumsum(length) - length] = False
    gold_pairs = np.zeros((k, k))
    np.add.at(gold_pairs, (y[np.flatnonzero(prev_ok) - 1], y[prev_ok]), 1)
    gold = np.stack([np.bincount(ids, y == c, len(used)) for c in range(k)], 1)
    gw, gt = np.full_like(w, 1e-8), np.full_like(t, 1e-8)
    for _ in range(EPOCHS):
        e = np.stack([np.bincount(row, w[slot, c], len(used)) for c in range(k)], 1)
        e = np.exp(np.maximum(e - e.max(1, keepdims=True), -30))
        p, pairs = _spread(e[ids], np.exp(t - t.max()), length, np.full(k, 1 / k))
        d = gold - np.stack([np.bincount(ids, p[:, c], len(used)) for c in range(k)], 1)
        g = np.stack([np.bincount(slot, d[row, c], 1 << BITS) for c in range(k)], 1) - RIDGE * w
        gw += g * g
        w += RATE * g / np.sqrt(gw)
        g = gold_pairs - pairs
        gt += g * g
        t += RATE * g / np.sqrt(gt)
    return Field(names, w.astype(np.float32), t)


def fit_on(docs: DataFrame, keep, id_col="doc_id", text_col="text", lang_col="lang", max_rows: int = MAX_FIT_ROWS, max_bytes: int = MAX_FIT_BYTES) -> Field:
    """Fits on rows with a text and a language for which keep holds, a hash sample of about max_rows of them where there
    are more, and less where their texts are more than max_bytes.

    The sample is all that reaches the driver. It goes by id and text, so null and shared ids are sampled as others are;
    wholly repeated rows come or stay out together. Without rows every text is und."""
    d = docs.where(named(lang_col).isNotNull() & named(text_col).isNotNull() & keep)
    n, size = d.agg(F.count(F.lit(1)), F.sum(F.octet_length(named(text_col)))).first()
    share = min(1.0, max_rows / max(n, 1), max_bytes / max(size or 0, 1))
    if share < 1:
        d = d.where(F.pmod(F.xxhash64(named(id_col), named(text_col), F.lit(7)), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = d.select(named(id_col).alias("id"), named(text_col).alias("text"), named(lang_col).alias("lang")).toPandas()
    rows = rows.sort_values(["id", "text"], kind="stable", na_position="first")
    return fit(rows.text.tolist(), rows.lang.tolist())


def language(docs: DataFrame, field: Field, text: Column, chars: float = 4e6) -> Column:
    """A struct of label and score (0 to 1) of a column of texts of docs.

    Whole texts are read, in parts of some MB of them or one text; null texts and those without a letter (Unicode's
    category L) are und with score 0."""
    sent = docs.sparkSession.sparkContext.broadcast(field)

    @F.pandas_udf("label string, score double")
    def found(text: pd.Series) -> pd.DataFrame:
        label, score = np.empty(len(text), object), np.zeros(len(text))
        size = text.str.len().fillna(0).to_numpy().cumsum()
        for part in np.split(np.arange(len(text)), np.searchsorted(size, np.arange(chars, size[-1] if len(size) else 0, chars))):
            if len(part):
                label[part], score[part] = sent.value.predict(text.iloc[part].tolist())
        return pd.DataFrame({"label": label, "score": score})

    return found(text)


def label_texts(docs: DataFrame, field: Field, text_col: str = "text", out_col: str = "lang_found") -> DataFrame:
    """docs with out_col as language() gives it (it takes the place of a column of that name); all other columns as they
    are; repeated rows are labelled alike; an empty table stays empty."""
    return docs.select(*[named(c) for c in docs.columns if c != out_col], language(docs, field, named(text_col)).alias(out_col))


def in_one_language(docs: DataFrame, field: Field, least_share: float, text_col: str = "text") -> DataFrame:
    """The rows of docs with a letter of whose letters at least least_share stand in words of one language; all columns as
    they are, whatever their names."""
    d = docs.select(packed(docs)).select("row", language(docs, field, F.col("row").getField(text_col)).alias("found"))
    return d.where((F.col("found.label") != "und") & (F.col("found.score") >= least_share)).select("row.*")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its language, learned from rows whose crc32 of the id is not 2 modulo 4 (a null id counts as the
    empty text). Null texts and texts without a letter are und with score 0; an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = modulus("doc_id", 4) == 2
    out = label_texts(docs.select("doc_id", "text"), fit_on(docs, ~held))
    return out.select("doc_id", held.alias("held_out"), F.col("lang_found.label").alias("lang_pred"), F.col("lang_found.score").alias("score"))
