"""Quality classifier: a linear SVM on n-gram indicators scaled by naive Bayes log-count ratios.

Indicators are hashed byte trigrams of the raw text, and bigrams of word shapes (case, digits,
symbols around and inside, length, whether the word stood a little earlier already), so that a
text's build is seen whatever its words and language. The model is fitted on a bounded sample of
labelled rows by dual coordinate descent; scores come from its margin by a logistic fit on rows
that the weights have not seen.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, small_batches, table
from .fit import bounded, give_back, inverse_rates
from .textscan import chunks, mix, word_hashes

#: Hash buckets of trigrams, and of shape bigrams behind them.
TRIGRAMS, SHAPES = 1 << 16, 1 << 13
DIM = TRIGRAMS + SHAPES
#: Labelled rows fitted on, for each label (a documented bound; rows are chosen by hash of the id).
FIT_ROWS = 2_000
SMOOTH, C, EPOCHS = 1.0, 0.1, 12

_KIND = np.zeros(256, np.uint8)  # upper, lower or beyond ASCII, digit, symbol as bits
_KIND[65:91] = 1
_KIND[97:123] = 2
_KIND[128:] = 2
_KIND[48:58] = 4
_KIND[[x for x in range(33, 127) if not chr(x).isalnum()]] = 8


def indicators(raw: np.ndarray, off: np.ndarray) -> Iterator[np.ndarray]:
    """Sorted distinct feature numbers of each text."""
    wide = raw.astype(np.uint32)
    tri = np.zeros(len(raw), np.uint32)
    if len(raw) > 2:
        tri[:-2] = ((wide[:-2] << 16 | wide[1:-1] << 8 | wide[2:]) * np.uint32(2654435761)) >> np.uint32(16)
    words, start, end, first = word_hashes(raw, off)
    kinds = _KIND[raw]
    shape = np.zeros(len(words), np.int64)
    if len(words):
        shape = np.bitwise_or.reduceat(kinds, start).astype(np.int64)  # what stands between words has no kind
        shape |= (kinds[start] == 8).astype(np.int64) << 4 | (kinds[end - 1] == 8).astype(np.int64) << 5
        shape |= np.minimum(np.log2(end - start).astype(np.int64), 5) << 6
        shape |= _repeats(words, first).astype(np.int64) << 9
    pair = mix((shape[:-1] << 12 | shape[1:]).astype(np.uint64)) % np.uint64(SHAPES) + np.uint64(TRIGRAMS) if len(words) > 1 else np.zeros(0, np.uint64)
    flags = np.zeros(DIM, bool)
    for d in range(len(off) - 1):
        flags[:] = False
        flags[tri[off[d] : max(off[d], off[d + 1] - 2)]] = True
        flags[pair[first[d] : max(first[d], first[d + 1] - 1)]] = True
        yield np.flatnonzero(flags)


def _repeats(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether a word's run of four (with the three before it) stood in the same text before: 1; the word is the last one again: 2 more."""
    n = len(words)
    text = np.repeat(np.arange(len(first) - 1, dtype=np.uint64), np.diff(first))
    run = words.copy()
    for k in (1, 2, 3):
        run[k:] += words[:-k] * np.uint64(0x9E3779B97F4A7C15 * (2 * k + 1) & (1 << 64) - 1)
    run = mix(run + text * np.uint64(0xBF58476D1CE4E5B9))
    _, at = np.unique(run, return_index=True)
    out = np.ones(n, np.uint8)
    out[at] = 0
    again = np.zeros(n, bool)
    again[1:] = (words[1:] == words[:-1]) & (text[1:] == text[:-1])
    return out | again << 1


class Packed(Sequence):
    """Feature numbers of rows that are kept as bitmaps, so that a row takes DIM / 8 bytes whatever its text."""

    def __init__(self, bits: Sequence[bytes]):
        self.bits = bits

    def __len__(self) -> int:
        return len(self.bits)

    def __getitem__(self, i: int) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(np.frombuffer(self.bits[i], np.uint8), count=DIM))


def packed(col: pa.Array) -> Iterator[bytes]:
    """Bitmap of the indicators of each text."""
    flags = np.zeros(DIM, bool)
    for _, _, raw, off in chunks(col, 1 << 19):
        for r in indicators(raw, off):
            flags[:] = False
            flags[r] = True
            yield np.packbits(flags).tobytes()


def descend(rows: Sequence[np.ndarray], y: np.ndarray, weight: np.ndarray, scale: np.ndarray, epochs: int = EPOCHS, c: float = C) -> np.ndarray:
    """Dual coordinate descent for the L1 hinge loss (Hsieh et al. 2008) on unit-length rows scaled by ``scale``; the last weight is the bias."""
    w = np.zeros(DIM + 1)
    sizes = np.array([max(np.linalg.norm(scale[rows[i]]), 1e-12) for i in range(len(rows))])
    norms = np.array([float(np.sum((scale[rows[i]] / sizes[i]) ** 2)) + 1.0 for i in range(len(rows))])
    alpha = np.zeros(len(rows))
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            r = rows[i]
            v = scale[r] / sizes[i]
            step = alpha[i] - (y[i] * (w[r] @ v + w[-1]) - 1) / norms[i]
            new = min(max(step, 0.0), c * weight[i])
            if new != alpha[i]:
                w[r] += (new - alpha[i]) * y[i] * v
                w[-1] += (new - alpha[i]) * y[i]
                alpha[i] = new
    return w


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, turns: int = 60) -> np.ndarray:
    """Intercept and slopes by ridge Newton steps; ``x`` has a row per example, ``weight`` how many rows it stands for."""
    a = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(a.shape[1])
    ridge = np.diag([1e-6] + [1e-2] * (a.shape[1] - 1))
    for _ in range(turns):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        grad = a.T @ (weight * (p - y)) + ridge @ b
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + ridge + 1e-9 * np.eye(len(b)), grad)
        b -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return b


class Model:
    """Weight of each feature with its naive Bayes scale folded in, squares of the scale, bias, and the logistic map."""

    def __init__(self, bits: Sequence[bytes], labels: list[int], stands_for: dict[int, float] | None = None):
        """``bits``: a bitmap of each row's indicators; ``stands_for``: rows of the table for each drawn row of a label, 1 where missing."""
        rows = Packed(bits)
        y = np.where(np.array(labels, np.int64) == 1, 1.0, -1.0)
        fold = np.random.default_rng(11).random(len(rows)) < 0.25  # these calibrate only
        if len(set(y[~fold])) < 2 or len(set(y[fold])) < 2:  # nothing to tell apart
            self.weight, self.square = np.zeros(DIM, np.float32), np.zeros(DIM, np.float32)
            self.bias, self.map = 0.0, np.array([20.0 if len(y) and y.mean() > 0 else -20.0 if len(y) else 0.0, 0.0])
            return
        count = {s: SMOOTH + sum((np.bincount(r, minlength=DIM) for r, t, f in zip(rows, y, fold, strict=True) if t == s and not f), np.zeros(DIM)) for s in (1.0, -1.0)}
        scale = np.log(count[1.0] / count[1.0].sum()) - np.log(count[-1.0] / count[-1.0].sum())
        fit = np.flatnonzero(~fold)
        share = (y[fit] == 1).mean()
        w = descend(Packed([bits[i] for i in fit]), y[fit], np.where(y[fit] == 1, 0.5 / share, 0.5 / (1 - share)), scale)
        self.weight, self.square, self.bias = (w[:-1] * scale).astype(np.float32), (scale**2).astype(np.float32), float(w[-1])
        margins = np.array([self.margin(r) for r in rows])
        self.map = logistic(margins[fold][:, None], (y[fold] > 0).astype(float), inverse_rates(labels, stands_for)[fold])

    def margin(self, row: np.ndarray) -> float:
        return float(self.weight[row].sum(dtype=np.float64)) / max(float(self.square[row].sum(dtype=np.float64)) ** 0.5, 1e-12) + self.bias

    def scores(self, col: pa.Array) -> np.ndarray:
        margins = np.array([self.margin(r) for _, _, raw, off in chunks(col, 1 << 19) for r in indicators(raw, off)])
        return 1 / (1 + np.exp(-np.clip(self.map[0] + self.map[1] * margins, -30, 30)))


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, score) for each row; null and empty texts have no indicators and are scored by the bias.

    A null id is kept, repeated rows give repeated rows, other columns are not read, an empty table gives an empty one.
    """
    small_batches(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.scores(b.column(1)), pa.float64())], names=["id", "score"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)


def labelled(docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, per_label: int) -> tuple[DataFrame, dict[int, float]]:
    """(id, label, text) of a bounded sample of rows that may be learned from: labelled 0 or 1, not held out; rows that one of a label stands for.

    The sample is drawn from the labels alone; its ids, bounded in number, are broadcast, so that no text is shuffled.
    """
    known = labels.select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("label")).filter("label IN (0, 1) AND id IS NOT NULL")
    picked, stands_for = bounded(known.filter(~held_out(F.col("id"), folds, fold)), "label", per_label, F.col("id"))
    ids = docs.sparkSession.createDataFrame(picked.collect(), known.schema)
    rows = docs.select(F.col("doc_id").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.join(F.broadcast(ids), "id").select("id", "label", "text"), stands_for


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Fitted in the driver, on a bitmap of each drawn row: its size is bounded by the number of rows alone. Whole texts are read."""
    sample, stands_for = labelled(docs, labels, "quality", 3, 1, FIT_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(packed(b.column(2))), pa.binary())], names=["id", "label", "bits"])

    kind = sample.schema["id"].dataType.simpleString()
    rows = sorted((r["id"], r["label"], bytes(r["bits"])) for r in sample.mapInArrow(run, f"id {kind}, label int, bits binary").collect())
    model = Model([r[2] for r in rows], [r[1] for r in rows], stands_for)
    del rows
    give_back()
    return model


def op3_nbsvm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every document.

    Null and empty texts get the score of a text without indicators, very long ones are read whole, equal texts
    get equal scores, a null id is not held out; an empty table gives an empty one. A score of 0.5 predicts 1.
    """
    docs = table(spark, sf_dir, "documents")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
