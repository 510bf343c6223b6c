"""Toxicity by maximum-scoring segments of token log-odds.

Tokens are lower-cased words without symbols at their ends. A token's score is the log-odds
ratio of toxic against clean texts under an informative Dirichlet prior (Monroe et al. 2008),
less a drift that makes the mean on clean text negative. All maximal segments (Ruzzo and Tompa
1999) of a text are found in one pass over its positive tokens. Under random clean text the best
segment follows an extreme-value law, 1 - exp(-K n exp(-lambda s)) for n tokens (Karlin and
Altschul 1990); lambda solves the renewal equation, K is fitted on clean texts. Segments below
``SIGNIFICANT`` are passages; a text's best p-value and its passages' sum of normalised scores
give the final score by a logistic fit on rows that the odds have not seen.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, held_out, small_batches, table
from .fit import give_back, inverse_rates
from .quality import labelled, logistic
from .textscan import LOWER, SPACE, chunks, prefix_hash, slice_hash, spans

#: Labelled rows fitted on, for each label (a documented bound; rows are chosen by hash of the id).
FIT_ROWS = 4_000
#: Weight of the prior, in tokens; what a token costs; largest score.
PRIOR, DRIFT, CEILING = 500.0, 0.25, 6.0
#: -log of a chance beyond which a passage is no surer; it bounds the logistic map's feature, as CEILING bounds what one token can say.
MOST = 30.0
SIGNIFICANT = 0.01

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[x for x in range(128) if not chr(x).isalnum()]] = True
_SYMBOL |= SPACE


def tokens(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of each token, and the first of each text: runs of ASCII letters, digits and bytes beyond ASCII."""
    start, end = spans(~_SYMBOL[raw], off)
    return slice_hash(prefix_hash(LOWER[raw]), start, end), start, end, np.searchsorted(start, off)


def maximal_segments(at: np.ndarray, score: np.ndarray, drift: float, n: int) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, last, score) of n tokens that cost ``drift`` each but for those at ``at``, which score ``score`` > 0.

    Ruzzo and Tompa's scan: cumulative sums left and right of each candidate; a candidate is joined
    with the latest one of lower left sum and lower right sum. Linear in the positive tokens.
    """
    out: list[list] = []  # first, last, left, right, and the latest earlier candidate of lower left sum
    total, then = 0.0, 0
    for p, s in zip(at.tolist(), score.tolist(), strict=True):
        total -= drift * (p - then)
        left, right, first = total, total + s, p
        total, then = right, p + 1
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][2] >= left:
                j = out[j][4]
            if j < 0 or out[j][3] >= right:
                out.append([first, p, left, right, j])
                break
            first, left = out[j][0], out[j][2]
            del out[j:]
    return [(a, b, r - lo) for a, b, lo, r, _ in out]


def _some(texts: Iterable[str], size: int = 1 << 22) -> Iterator[pa.Array]:
    """Texts as arrays of about ``size`` characters."""
    rows, held = [], 0
    for t in texts:
        rows.append(t)
        held += len(t)
        if held >= size:
            yield pa.array(rows, pa.string())
            rows, held = [], 0
    if rows:
        yield pa.array(rows, pa.string())


class Stored:
    """The texts of a written table in order of their ids, brought to the driver a partition at a time."""

    def __init__(self, rows: DataFrame):
        self.rows = rows

    def __iter__(self) -> Iterator[str]:
        for r in self.rows.toLocalIterator():
            yield r["text"]


def _xlog(x: np.ndarray, expected: np.ndarray) -> np.ndarray:
    return x * np.log(np.where(x > 0, x, 1) / np.where(x > 0, expected, 1))


class Model:
    """Scores of the tokens that tell, the extreme-value law's rate and K, and the logistic map."""

    def __init__(self, texts: Iterable[str], labels: list[int], stands_for: dict[int, float] | None = None):
        """``texts`` are gone through twice, some at a time; ``stands_for``: rows of the table for each drawn row of a label, 1 where missing."""
        y = np.array(labels, np.int64)
        fold = np.random.default_rng(11).random(len(y)) < 1 / 3  # these calibrate only
        self.word, self.score = np.zeros(0, np.uint64), np.zeros(0)
        self.rate, self.k, self.map = 1.0, 1.0, np.array([-4.0, 0.0, 0.0])
        if not ((y == 1) & ~fold).any() or not ((y == 0) & ~fold).any():
            self.map[0] = 4.0 if len(y) and (y == 1).all() else -4.0
            return
        word, times = np.zeros(0, np.uint64), np.zeros((0, 2))  # in how many clean and toxic texts a word stands
        at = 0
        for part in _some(texts):
            found: list[list[np.ndarray]] = [[], []]
            for lo, hi, raw, off in chunks(part):
                h, _, _, first = tokens(raw, off)
                for d in range(lo, hi):
                    if not fold[at + d]:
                        found[y[at + d]].append(np.unique(h[first[d - lo] : first[d - lo + 1]]))  # once a text: a repeated word is one witness
            at += len(part)
            new = np.concatenate([word, *found[0], *found[1]])
            old, (n, m) = len(word), (sum(map(len, x)) for x in found)
            word, place = np.unique(new, return_inverse=True)
            total = np.zeros((len(word), 2))
            total[place[:old]] = times
            total[:, 0] += np.bincount(place[old : old + n], minlength=len(word))
            total[:, 1] += np.bincount(place[old + n : old + n + m], minlength=len(word))
            times = total
        clean, toxic = times.T
        prior = PRIOR * (clean + toxic) / (clean.sum() + toxic.sum())
        odds = [np.log((c + prior) / (c.sum() + PRIOR - c - prior)) for c in (clean, toxic)]
        delta = odds[1] - odds[0]
        # of very many rare words some fall to one side by chance: a word counts if its likelihood ratio
        # against equal shares would not be met by one word in the sample
        share = toxic.sum() / (toxic.sum() + clean.sum())
        ratio = 2 * (_xlog(toxic, share * (toxic + clean)) + _xlog(clean, (1 - share) * (toxic + clean)))
        counts = (ratio > 2 * np.log(len(word) + 1.0)) & (delta > 2 * DRIFT)
        self.word, self.score = word[counts], np.minimum(delta[counts], CEILING) - DRIFT
        self._calibrate(texts, y, fold, inverse_rates(y, stands_for))

    def _calibrate(self, texts: Iterable[str], y: np.ndarray, fold: np.ndarray, weight: np.ndarray) -> None:
        seen = [(n, own, hits) for part in _some(texts) for n, own, hits, _ in self._segments(part)]
        clean = [s for s, t in zip(seen, y, strict=True) if t == 0]
        n = sum(s[0] for s in clean)
        hits = np.concatenate([s[2] for s in clean] or [np.zeros(0)])
        # scores of clean text's tokens; half a hit of the ceiling keeps the equation solvable
        value = np.append(hits, [CEILING, -DRIFT])
        share = np.append(np.ones(len(hits)), [0.5, max(1.0, n - len(hits))]) / (n + 1)
        low, high = 1e-6, 20.0
        for _ in range(80):
            mid = (low + high) / 2
            low, high = (low, mid) if (share * np.exp(mid * value)).sum() > 1 else (mid, high)
        self.rate = low
        best = np.array([max([x[2] for x in s[1]], default=0.0) for s in clean])
        self.k = 1 / max(np.mean([s[0] * np.exp(-self.rate * b) for s, b in zip(clean, best, strict=True)]), 1e-12)
        x = np.array([self.features(s) for s in seen])
        if len(set(y[fold])) == 2:
            self.map = logistic(x[fold], (y[fold] == 1).astype(float), weight[fold])

    def _segments(self, col: pa.Array) -> Iterator[tuple[int, list[tuple[int, int, float]], np.ndarray, np.ndarray]]:
        """(tokens, maximal segments, positive scores, token spans' bytes) of each text."""
        for lo, hi, raw, off in chunks(col, 1 << 20):
            h, start, end, first = tokens(raw, off)
            if len(self.word):
                at = np.minimum(np.searchsorted(self.word, h), len(self.word) - 1)
                hit = np.flatnonzero(self.word[at] == h)
                value = self.score[at[hit]]
            else:
                hit, value = np.zeros(0, np.int64), np.zeros(0)
            cut = np.searchsorted(hit, first)
            for d in range(hi - lo):
                a, b, n = cut[d], cut[d + 1], int(first[d + 1] - first[d])
                own = maximal_segments(hit[a:b] - first[d], value[a:b], DRIFT, n) if b > a else []
                yield n, own, value[a:b], np.stack([start[first[d] : first[d + 1]], end[first[d] : first[d + 1]]]) - off[d] if own else np.zeros((2, 0), np.int64)

    def log_p(self, n: int, score: float) -> float:
        """-log of the chance that n clean tokens hold a segment of this score; the tail is taken in logs."""
        e = np.log(self.k * max(n, 1)) - self.rate * score
        return float(-e if e < -20 else -np.log(-np.expm1(-np.exp(min(e, 20.0)))))

    def features(self, seen: tuple) -> tuple[float, float]:
        n, segments = seen[0], seen[1]
        best = max((self.log_p(n, s) for _, _, s in segments), default=0.0)
        passages = sum(max(0.0, self.rate * s - np.log(max(self.k * n, 1e-12))) for _, _, s in segments if self.log_p(n, s) >= -np.log(SIGNIFICANT))
        return min(best, MOST), float(np.log1p(passages))

    def of(self, col: pa.Array) -> Iterator[tuple[float, list[dict]]]:
        """(score, significant passages as byte spans) of each text."""
        for seen in self._segments(col):
            x = self.features(seen)
            p = 1 / (1 + np.exp(-np.clip(self.map[0] + self.map[1] * x[0] + self.map[2] * x[1], -30, 30)))
            n, segments, _, where = seen
            yield float(p), [{"start": int(where[0, a]), "end": int(where[1, b]), "log_p": v} for a, b, s in segments if (v := self.log_p(n, s)) >= -np.log(SIGNIFICANT)]


_PASSAGE = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("log_p", pa.float64())])


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, score, passages) for each row: passages are byte spans of the UTF-8 text with -log p.

    Null and empty texts have no tokens, no passages and the score of a text without any. A null id is
    kept, repeated rows give repeated rows, other columns are not read, an empty table gives an empty one.
    """
    small_batches(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = list(model.of(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in got], pa.float64()), pa.array([x[1] for x in got], pa.list_(_PASSAGE))], names=["id", "score", "passages"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, score double, passages array<struct<start:long,end:long,log_p:double>>").withColumnRenamed("id", id_col)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Fitted in the driver on a bounded number of whole texts, which are read some at a time; it keeps counts of words and each text's segments."""
    sample, stands_for = labelled(docs, labels, "toxic", 4, 2, FIT_ROWS)
    rows = Scratch(docs.sparkSession, "toxic").cut(sample)
    known = sorted(map(tuple, rows.select("id", "label").collect()))
    model = Model(Stored(rows.orderBy("id", "label", "text").select("text")), [k for _, k in known], stands_for)
    give_back()
    return model


def op8_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted and the number of significant passages of every document.

    Null and empty texts get the score of a text without passages, very long ones are scanned whole, equal texts get
    equal scores, a null id is not held out; an empty table gives an empty one. A score of 0.3 predicts 1.
    """
    docs = table(spark, sf_dir, "documents")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))
