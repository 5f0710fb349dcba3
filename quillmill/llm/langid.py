"""Language identification with error-correcting output codes.

Each language has a codeword of +1 / -1 bits.  One binary classifier a bit (log
odds of hashed character 1- to 3-grams) predicts that bit; the margins are
decoded with weights that reflect how well each bit did on held-out rows, and the
codeword of least weighted logistic loss names the language.  Where the runner-up
is nearly as good, the text is flagged as ambiguous.

A margin is the mean log odds of all grams of the whole text, times a sixth of their
number (overlapping grams are not independent) and at most 30: from 180 grams on, a
longer text has no more certain a decision, only a better mean.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit as tk

#: Labelled rows a language that training uses at most (the only bounded sample; scoring covers all rows).
SAMPLE_PER_LANG = 300
#: Loss by which the best codeword must beat the second, else the text is ambiguous.
MIN_GAP = 0.5
#: Languages at most: each has a codeword and a sample in the driver.
MAX_LANGS = 1_000
UNKNOWN = "und"

# Letters have codes 1..26, everything else in ASCII is a space (0), bytes of other characters 27..63.
_CODE = np.zeros(256, np.uint32)
_CODE[97:123] = np.arange(1, 27)
_CODE[65:91] = np.arange(1, 27)
_CODE[128:] = 27 + np.arange(128) % 37
_GRAMS = (1 << 18) + (1 << 12) + (1 << 6)


def features(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of 1-, 2- and 3-grams that begin at each byte (a row each), and each text's letters.

    Runs of non-letters count as one space, also before and after the text.
    """
    code = _CODE[buf]
    n = len(code)
    gap = code == 0
    same = np.zeros(n, bool)
    same[1:] = gap[1:] & gap[:-1]
    inner = offs[1:-1][(offs[1:-1] > 0) & (offs[1:-1] < n)]
    same[inner] = False
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(offs))[~same]
    code = code[~same]
    n = len(code)
    cut = np.searchsorted(doc, np.arange(len(offs)))
    nxt, after = np.zeros(n, np.uint32), np.zeros(n, np.uint32)
    nxt[:-1], after[:-2] = code[1:], code[2:]
    ends = cut[1:][np.diff(cut) > 0]
    nxt[ends - 1] = 0
    after[ends - 1] = 0
    two = ends[np.diff(cut)[np.diff(cut) > 0] > 1]
    after[two - 2] = 0
    grams = np.stack((code, 64 + code * 64 + nxt, 64 + 4096 + (code * 64 + nxt) * 64 + after)).astype(np.int32)
    letters = np.zeros(len(offs), np.int64)
    np.cumsum(np.bincount(doc[code > 0], minlength=len(offs) - 1)[: len(offs) - 1], out=letters[1:])
    return np.vstack((grams, doc.astype(np.int32)[None])), np.diff(letters)


def codewords(k: int, seed: int = 7) -> np.ndarray:
    """k codewords: all 2**(k - 1) - 1 distinct splits up to five languages, else random dense ones."""
    if k < 2:
        return np.ones((k, 1))
    if k <= 5:
        cols = [[1 if i == 0 or (m >> (i - 1)) & 1 else -1 for i in range(k)] for m in range(2 ** (k - 1) - 1)]
        return np.array(cols, float).T
    rng, bits = np.random.default_rng(seed), int(np.ceil(10 * np.log2(k)))
    best, far = None, -1.0
    for _ in range(200):
        c = rng.choice([-1.0, 1.0], size=(k, bits))
        near = min(np.count_nonzero(c[i] != c[j]) for i in range(k) for j in range(i))
        if near > far and np.all(np.abs(c.sum(0)) < k):
            best, far = c, near
    return best


@dataclass(frozen=True)
class Model:
    """Trained classifiers: languages, their codewords, a weight row a bit and the bits' decoding weights."""

    langs: tuple[str, ...]
    codes: np.ndarray
    weights: np.ndarray
    alphas: np.ndarray

    def _long_margins(self, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """margins() of one long text, part by part: the sums over its grams add up."""
        code = _CODE[buf].astype(np.uint8)
        keep = np.append(True, (code[1:] != 0) | (code[:-1] != 0))
        code = code[keep]
        n, total = len(code), np.zeros(len(self.weights))
        for a in range(0, n, tk.BLOCK):
            c = np.zeros(min(tk.BLOCK, n - a) + 2, np.int32)
            part = code[a : a + len(c)]
            c[: len(part)] = part
            one, two = c[:-2], c[:-2] * 64 + c[1:-1]
            three = two * 64 + c[2:] + (64 + 4096)
            two += 64
            total += [float((w[one].astype(np.float64) + w[two] + w[three]).sum()) for w in self.weights]
        return (total / n * (min(n, 180) / 6.0))[None], np.array([np.count_nonzero(code)])

    def margins(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(offs) == 2 and len(buf) > tk.BLOCK:
            return self._long_margins(buf)
        grams, letters = features(buf, offs)
        doc, n = grams[3], len(offs) - 1
        count = np.maximum(np.bincount(doc, minlength=n), 1)
        out = np.empty((n, len(self.weights)))
        for b, w in enumerate(self.weights):
            out[:, b] = np.bincount(doc, w[grams[0]] + w[grams[1]] + w[grams[2]], n)
        return out / count[:, None] * (np.minimum(count, 180) / 6.0)[:, None], letters

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best language's number and the gap to the second (0 where there is none to choose)."""
        if len(self.langs) < 2:
            return np.zeros(len(margins), np.int64), np.full(len(margins), np.inf)
        loss = np.logaddexp(0, -margins[:, None, :] * self.codes[None]) @ self.alphas
        order = np.argsort(loss, axis=1, kind="stable")
        rows = np.arange(len(loss))
        return order[:, 0], loss[rows, order[:, 1]] - loss[rows, order[:, 0]]

    def predict(self, col: pa.Array, min_gap: float) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, gap and ambiguity of each text; without a letter: und, 0, ambiguous."""
        buf, offs = tk.string_parts(col)
        langs, gaps, flags = [], [], []
        for i, j in tk.chunks_of(offs):
            m, letters = self.margins(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            best, gap = self.decode(m)
            none = (letters == 0) | (not self.langs)
            langs += [UNKNOWN if z else self.langs[k] for k, z in zip(best, none)]
            gap = np.where(none, 0.0, gap)
            gaps.append(gap)
            flags.append(gap < min_gap)
        cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        return langs, cat(gaps, float), cat(flags, bool)


def fit(texts: list[str], labels: list[str], smoothing: float = 0.5) -> Model:
    """Train on texts (whole ones); a fifth of each language's rows weighs the bits."""
    langs = tuple(sorted(set(labels)))
    codes = codewords(len(langs))
    if not langs:
        return Model((), codes, np.zeros((1, _GRAMS), np.float32), np.ones(1))
    y = np.array([langs.index(x) for x in labels])
    held = np.zeros(len(y), bool)
    for k in range(len(langs)):
        own = np.flatnonzero(y == k)
        held[own[4::5]] = True
    counts = np.zeros((len(langs), _GRAMS))
    buf, offs = tk.string_parts(pa.array(texts, pa.large_string()))
    for i in np.flatnonzero(~held):
        grams, _ = features(buf[offs[i] : offs[i + 1]], np.array([0, offs[i + 1] - offs[i]]))
        counts[y[i]] += np.bincount(grams[:3].ravel(), minlength=_GRAMS)
    # Each language counts the same; each order of grams is a distribution of its own.
    p = np.empty_like(counts)
    for a, b in ((0, 64), (64, 64 + 4096), (64 + 4096, _GRAMS)):
        c = counts[:, a:b] + smoothing
        p[:, a:b] = c / c.sum(1, keepdims=True)
    weights = np.zeros((codes.shape[1], _GRAMS), np.float32)
    for b in range(codes.shape[1]):
        pos, neg = codes[:, b] > 0, codes[:, b] < 0
        if pos.any() and neg.any():
            weights[b] = np.log(p[pos].mean(0)) - np.log(p[neg].mean(0))
    model, alphas = Model(langs, codes, weights, np.ones(codes.shape[1])), np.ones(codes.shape[1])
    if held.any() and len(langs) > 1:
        rows = np.flatnonzero(held)
        m = np.vstack([model.margins(buf[offs[i] : offs[i + 1]], np.array([0, offs[i + 1] - offs[i]]))[0] for i in rows])
        right = ((m > 0) == (codes[y[rows]] > 0)).mean(0).clip(0.5, 0.999)
        alphas = np.log(right / (1 - right)) + 1e-3
        alphas /= alphas.mean()
    return Model(langs, codes, weights, alphas)


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample_per_lang: int = SAMPLE_PER_LANG) -> Model:
    """Fit on about ``sample_per_lang`` distinct rows of each label, those of smallest hash of id, label and text.

    Rows that repeat id, label and text are one, so that neither copies nor null ids
    change how many are drawn: the sample is what the driver collects.  Rows without
    text or label are not used; without any labelled row the model has no language.
    """
    rows = docs.select(F.col(text_col).alias("__t"), F.col(lang_col).cast("string").alias("__l"), F.xxhash64(F.col(id_col), F.col(lang_col), F.col(text_col)).alias("__h")).where("__t IS NOT NULL AND __l IS NOT NULL")
    counts = {r[0]: r[1] for r in rows.groupBy("__l").agg(F.approx_count_distinct("__h")).limit(MAX_LANGS + 1).collect()}
    if len(counts) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    if not counts:
        return fit([], [])
    rate: Column = F.lit(0.0)
    for lang, n in counts.items():
        rate = F.when(F.col("__l") == lang, min(1.0, 1.3 * sample_per_lang / max(n, 1))).otherwise(rate)
    found = rows.where(F.pmod("__h", F.lit(1 << 30)) < rate * (1 << 30)).groupBy("__l", "__h").agg(F.min("__t").alias("__t")).collect()
    texts, labels, had = [], [], dict.fromkeys(counts, 0)
    for r in sorted(found, key=lambda r: (r["__h"], r["__l"], r["__t"])):
        if had[r["__l"]] < sample_per_lang:
            had[r["__l"]] += 1
            texts.append(r["__t"])
            labels.append(r["__l"])
    return fit(texts, labels)


def identify(docs: DataFrame, model: Model, text_col: str = "text", id_col: str = "doc_id", min_gap: float = MIN_GAP) -> DataFrame:
    """(doc_id, lang_pred, gap, ambiguous) for every row.

    Defined cases: a null, empty or letterless text is 'und', gap 0, ambiguous;
    null ids stay null; repeated rows give repeated results; texts are scored
    whole; ties go to the first language in alphabetical order; no row is dropped
    and other columns are not read.  With a single trained language every text
    with letters is that language.
    """

    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        for batch in batches:
            langs, gap, flag = shared.value.predict(batch.column(1), min_gap)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(np.round(gap, 4)), pa.array(flag)], ["doc_id", "lang_pred", "gap", "ambiguous"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), tk.lowered(text_col).alias("__text")).mapInArrow(score, "doc_id long, lang_pred string, gap double, ambiguous boolean")


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text", min_gap: float = MIN_GAP) -> DataFrame:
    """docs without the rows that identify() finds ambiguous; the columns stay, nothing is shuffled.

    Defined cases: rows with a null, empty or letterless text go, as no language is
    found; a model without languages can judge nothing and drops nothing; null ids do
    not matter; of repeated rows all stay or all go; an empty table stays empty;
    texts are scored whole; other columns, whatever their names, are not read.
    """
    if not model.langs:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("boolean")
    def sure(text: pa.Array) -> pa.Array:
        return pa.array(~shared.value.predict(text, min_gap)[2])

    return docs.where(sure(tk.lowered(text_col)))
