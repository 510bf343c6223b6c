"""Language identification by unigram pieces, marginalised over all segmentations.

Each language has a probability for every piece of one fixed public vocabulary. A word (what
white space parts, A-Z in lower case, with a space before it) has the summed probability of all its segmentations,
which a forward pass over the matching pieces gives; a text's is the product over its words.
Piece probabilities are fitted by expectation-maximisation over the same forward and backward
passes, on a bounded sample of texts of each language.

All pieces are used; any byte also stands alone as a piece, so that every word has a segmentation. White space
is one space before a word, so the few pieces that hold more than one space match nowhere. A word is never cut:
sums over long words are rescaled as they go, and words beyond ``LATTICE_BYTES`` go on from slice to slice
with the sums of the places that a piece can still begin at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, small_batches, table
from .fit import bounded, give_back
from .textscan import LOWER, SPACE, chunks, prefix_hash, slice_hash, spans

VOCABULARY = "piece_bpe_32k.model"
#: Texts of each language fitted on (a documented bound; rows are chosen by hash of the id).
FIT_ROWS = 400
ROUNDS, ADD = 4, 0.1
#: Places after which sums are scaled anew.
STRIDE = 24
#: Keeps products of piece probabilities near 1; taken back in logs.
GAIN = 12.0
#: Bytes of different words that one lattice holds, so that memory does not grow with a text.
LATTICE_BYTES = 1 << 16
#: Rows that are filtered, and so copied, at a time.
SLICE_ROWS = 1000
_TABLE_BITS = 18


class Pieces:
    """Hashes of the vocabulary's pieces in an open-addressing table; numbers 0-255 are the single bytes."""

    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        found = {bytes([i]): i for i in range(256)}
        for i in range(sp.get_piece_size()):
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)):
                piece = sp.id_to_piece(i).replace("▁", " ").encode()
                if len(piece) > 1 and b" " not in piece[1:]:
                    found.setdefault(piece, len(found))
        self.size = len(found)
        self.width = np.array([len(p) for p in found])
        self.sizes = sorted({len(p) for p in found} - {1})
        self.longest = self.sizes[-1]
        raw = np.frombuffer(b"".join(found), np.uint8)
        end = np.cumsum([len(p) for p in found])
        h = slice_hash(prefix_hash(raw), end - [len(p) for p in found], end)
        self.key, self.number = np.zeros(1 << _TABLE_BITS, np.uint64), np.full(1 << _TABLE_BITS, -1, np.int32)
        self.probes = 0
        for x, n in zip(h.tolist(), found.values(), strict=True):
            at, step = x & ((1 << _TABLE_BITS) - 1), 0
            while self.number[at] >= 0:
                at, step = (at + 1) & ((1 << _TABLE_BITS) - 1), step + 1
            self.key[at], self.number[at], self.probes = x, n, max(self.probes, step)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        at = (h & np.uint64((1 << _TABLE_BITS) - 1)).astype(np.int64)
        out = np.where(self.key[at] == h, self.number[at], -1)
        rest = np.flatnonzero((out < 0) & (self.number[at] >= 0))
        for _ in range(self.probes):
            if not len(rest):
                break
            at[rest] = (at[rest] + 1) & ((1 << _TABLE_BITS) - 1)
            out[rest] = np.where(self.key[at[rest]] == h[rest], self.number[at[rest]], -1)
            rest = rest[(out[rest] < 0) & (self.number[at[rest]] >= 0)]
        return out


@lru_cache(1)
def pieces(name: str = VOCABULARY) -> Pieces:
    return Pieces(name if "/" in name else public_tokenizers.path(name))


class Lattice:
    """All pieces that match inside of words, as edges between byte places, in order of their end."""

    def __init__(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray, vocabulary: Pieces):
        self.start, self.end, self.n = start, end, len(raw)
        left = np.repeat(end, end - start) - np.arange(self.n)  # bytes from a place to its word's end
        prefix = prefix_hash(raw)
        a, b, p = [np.arange(self.n)], [np.arange(self.n) + 1], [raw.astype(np.int32)]
        for size in vocabulary.sizes:
            at = np.flatnonzero(left >= size)
            number = vocabulary(slice_hash(prefix, at, at + size))
            hit = number >= 0
            a.append(at[hit])
            b.append(at[hit] + size)
            p.append(number[hit])
        a, b, p = np.concatenate(a), np.concatenate(b), np.concatenate(p)
        word = np.repeat(np.arange(len(start)), end - start)
        place = b - start[word[a]]  # end within the word, from 1
        order = np.lexsort((b, place))
        # an edge runs between nodes; a word of k bytes has k + 1 nodes of its own
        self.a, self.b, self.p = ((x[order]).astype(np.int32) for x in (a + word[a], b + word[a], p))
        place = place[order]
        self.steps = np.searchsorted(place, np.arange(1, int(place[-1]) + 2)) if len(p) else np.zeros(1, np.int64)
        self.first, self.last = start + np.arange(len(start)), end + np.arange(len(start))

        self.reach = vocabulary.longest

    def forward(self, prob: np.ndarray, given: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Sums of all segmentations up to each node, and the logs of what they are to be multiplied with; ``prob`` is
        (pieces, languages), scaled by GAIN a byte. ``given``: the sums of the first nodes of a single word."""
        out = np.zeros((self.n + len(self.start), prob.shape[1]))
        log, total = np.zeros_like(out), np.zeros((len(self.start), prob.shape[1]))
        out[self.first] = 1
        known = 0
        if given is not None:
            out[: len(given)] = given
            known = len(given) - 1
        for t, (i, j) in enumerate(zip(self.steps, self.steps[1:], strict=False), 1):
            if t <= known:
                continue
            if i < j:
                to = self.b[i:j]
                head = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
                out[to[head]] = np.add.reduceat(out[self.a[i:j]] * prob[self.p[i:j]], head, axis=0)
            if t % STRIDE == 0:  # nodes that a piece can still begin at get a common scale, which holds for those to come
                self._rescale(out, log, total, t, (t - self.reach + 1, t), (t - self.reach + 1, t + STRIDE))
        return out, log

    def backward(self, prob: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same from each node to its word's end."""
        out = np.zeros((self.n + len(self.start), prob.shape[1]))
        log, total = np.zeros_like(out), np.zeros((len(self.start), prob.shape[1]))
        out[self.last] = 1
        for t in range(len(self.steps) - 1, 0, -1):
            if t % STRIDE == 0:  # node t is whole; those a piece's length before it are being summed up
                self._rescale(out, log, total, t, (t - self.reach, t), (t - self.reach - STRIDE, t))
            i, j = self.steps[t - 1], self.steps[t]
            np.add.at(out, self.a[i:j], out[self.b[i:j]] * prob[self.p[i:j]])
        return out, log

    def _rescale(self, out: np.ndarray, log: np.ndarray, total: np.ndarray, t: int, summed: tuple[int, int], scaled: tuple[int, int]) -> None:
        """Divides the sums at places ``summed`` of each word that is so long by their greatest; ``total`` is the log of a word's scale, which places ``scaled`` get."""
        word = np.flatnonzero(self.last - self.first >= t)
        if not len(word):
            return
        places = lambda span: np.minimum(self.first[word][:, None] + np.maximum(np.arange(span[0], span[1] + 1), 0), self.last[word][:, None])
        near = places(summed)
        top = out[near].max(1)
        top = np.where(top > 0, top, 1.0)
        out[near] /= top[:, None]
        total[word] += np.log(top)
        log[places(scaled)] = total[word][:, None]


def _words(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first of each text) of words."""
    start, end = spans(~SPACE[raw], off)
    return start, end, np.searchsorted(start, off)


def _spelled(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, start, end) of the words one behind the other, each with a space before it."""
    size = end - start + 1
    stop = np.cumsum(size)
    at = np.arange(int(stop[-1])) - np.repeat(stop - size, size) + np.repeat(start - 1, size)
    out = raw[np.maximum(at, 0)]
    out[stop - size] = 32
    return out, stop - size, stop


def _slices(start: np.ndarray, end: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of words of about LATTICE_BYTES bytes; a word beyond that is a range of its own."""
    stop = np.cumsum(end - start + 1)
    long = np.flatnonzero(end - start >= LATTICE_BYTES)
    cuts = np.unique(np.concatenate([np.searchsorted(stop, np.arange(0, stop[-1], LATTICE_BYTES)), long, long + 1, [0, len(stop)]])).tolist()
    yield from zip(cuts, cuts[1:], strict=False)


def _long_word(raw: np.ndarray, prob: np.ndarray, vocabulary: Pieces) -> np.ndarray:
    """Log of the sum over all segmentations of one word, LATTICE_BYTES at a time."""
    given, log, at = None, np.zeros(prob.shape[1]), 0
    while at < len(raw):
        back = 0 if given is None else len(given) - 1
        part = raw[at - back : at + LATTICE_BYTES]
        lattice = Lattice(part, np.array([0]), np.array([len(part)]), vocabulary)
        out, logs = lattice.forward(prob, given)
        given = out[-min(len(out), vocabulary.longest) :]
        log += logs[-1]
        at += LATTICE_BYTES
    with np.errstate(divide="ignore"):
        return np.log(given[-1]) + log


def count_words(texts: pa.Array, langs: list[str]) -> dict[tuple[str, bytes], int]:
    """How often each word, A-Z in lower case, stands in the texts of each language. Words beyond LATTICE_BYTES, which the fit has no use for, are left out."""
    counts: dict[tuple[str, bytes], int] = {}
    for lo, hi, raw, off in chunks(texts):
        start, end, first = _words(raw, off)
        data = LOWER[raw].tobytes()
        for d in range(lo, hi):
            for i, j in zip(start[first[d - lo] : first[d - lo + 1]].tolist(), end[first[d - lo] : first[d - lo + 1]].tolist(), strict=True):
                if j - i < LATTICE_BYTES:
                    counts[key] = counts.get(key := (langs[d], data[i:j]), 0) + 1
    return counts


class Model:
    """Scaled piece probabilities of each language."""

    def __init__(self, counts: dict[tuple[str, bytes], int]):
        """``counts``: how often a word stands in texts of a language, as ``count_words`` gives them."""
        self.langs = sorted({lang for lang, _ in counts})
        vocabulary = pieces()
        gain = GAIN**vocabulary.width
        spelled = np.zeros((vocabulary.size, max(1, len(self.langs))))
        by_lang: dict[str, dict[bytes, int]] = {lang: {} for lang in self.langs}
        for (lang, word), n in counts.items():
            by_lang[lang][word] = n
        for g, lang in enumerate(self.langs):
            own = dict(sorted(by_lang[lang].items()))
            raw = np.frombuffer(b"".join(own), np.uint8)
            stop = np.cumsum([len(w) for w in own])
            start, n = stop - [len(w) for w in own], np.array(list(own.values()), float)
            lattices = [(Lattice(*_spelled(raw, start[i:j], stop[i:j]), vocabulary), n[i:j]) for i, j in _slices(start, stop)]
            prob = sum(np.bincount(lattice.p, minlength=vocabulary.size) for lattice, _ in lattices) + ADD
            for _ in range(ROUNDS):
                prob = (prob / prob.sum())[:, None]
                scaled = prob.copy()
                scaled[:, 0] *= gain
                prob = np.full(vocabulary.size, ADD)
                for lattice, times in lattices:
                    (ahead, ahead_log), (back, back_log) = lattice.forward(scaled), lattice.backward(scaled)
                    word = np.searchsorted(lattice.first, lattice.a, "right") - 1
                    scale = np.exp(ahead_log[lattice.a, 0] + back_log[lattice.b, 0] - ahead_log[lattice.last, 0][word])
                    expected = (times / ahead[lattice.last, 0])[word] * ahead[lattice.a, 0] * scaled[lattice.p, 0] * back[lattice.b, 0] * scale
                    prob += np.bincount(lattice.p, expected, vocabulary.size)
            spelled[:, g] = prob / prob.sum()
        self.scaled = spelled * gain[:, None]

    def _scores(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray, vocabulary: Pieces) -> np.ndarray:
        """Log probability of each word in each language, over lattices of bounded size."""
        out = np.empty((len(start), self.scaled.shape[1]))
        for i, j in _slices(start, end):
            spelled = _spelled(raw, start[i:j], end[i:j])
            if len(spelled[0]) > LATTICE_BYTES and j == i + 1:
                found = _long_word(spelled[0], self.scaled, vocabulary)
            else:
                lattice = Lattice(*spelled, vocabulary)
                sums, log = lattice.forward(self.scaled)
                found = np.log(sums[lattice.last]) + log[lattice.last]
            out[i:j] = found - ((spelled[2] - spelled[1]) * np.log(GAIN))[:, None]
        return out

    def of(self, col: pa.Array) -> Iterator[tuple[str, float]]:
        """(language, its posterior under equal priors) of each text; ``und`` and 0 without a letter or a language."""
        vocabulary = pieces()
        for lo, hi, raw, off in chunks(col, 1 << 19):
            start, end, first = _words(raw, off)
            small = LOWER[raw]
            total = np.zeros((hi - lo, max(1, len(self.langs))))
            if len(start) and self.langs:
                _, one, back = np.unique(slice_hash(prefix_hash(small), start, end), return_index=True, return_inverse=True)
                score = self._scores(small, start[one], end[one], vocabulary)
                text = np.repeat(np.arange(hi - lo), np.diff(first))
                for g in range(total.shape[1]):
                    total[:, g] = np.bincount(text, score[back, g], hi - lo)
            letter = ((raw | 32) >= 97) & ((raw | 32) <= 122) & (raw < 128)
            seen = np.concatenate([[0], np.cumsum(letter)])
            plain = seen[off[1:]] > seen[off[:-1]]
            for d in range(hi - lo):
                if not self.langs or not (plain[d] or _LETTER.search(raw[off[d] : off[d + 1]].tobytes().decode())):
                    yield "und", 0.0
                    continue
                best = int(total[d].argmax())  # ties: the first language by name
                yield self.langs[best], float(1 / np.exp(total[d] - total[d, best]).sum())


_LETTER = regex.compile(r"\p{L}")


def identify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, lang_pred, score) for each row: ``und`` with score 0 where the text is null or has no letter.

    A null id is kept, repeated rows give repeated rows, other columns are not read, an empty table gives an empty one.
    """
    small_batches(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = list(model.of(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())], names=["id", "lang_pred", "score"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def keep_identified(df: DataFrame, model: Model, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``df``, all columns, whose language is known with a posterior of ``least`` at least; no shuffle."""
    small_batches(df.sparkSession)
    where = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(i, SLICE_ROWS) for whole in batches for i in range(0, whole.num_rows, SLICE_ROWS)):
            yield b.filter(pa.array([lang != "und" and p >= least for lang, p in model.of(b.column(where))], pa.bool_()))
        give_back()

    return df.mapInArrow(run, df.schema)


def fit(docs: DataFrame) -> Model:
    """Learns from text and lang of documents outside of the held-out fold alone.

    At most about FIT_ROWS whole texts of each language are drawn. Words are counted where the texts are, so that
    the driver gets the distinct words of the sample and no text.
    """
    known = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    known = known.filter(~held_out(F.col("id"), 3, 1) & F.col("id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull())
    # the number of rows by language is counted without reading a text
    sample, _ = bounded(known, "lang", FIT_ROWS, F.col("id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = count_words(b.column(1), b.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["lang", "word", "n"])

    counted = sample.select("lang", "text").mapInArrow(run, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    model = Model({(r["lang"], bytes(r["word"])): r["n"] for r in counted.toLocalIterator()})
    give_back()
    return model


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document: ``identify`` says what becomes of odd rows.

    Ties go to the first language by name; a text is read whole, however long, and whatever its longest word.
    """
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs)).select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "lang_pred", "score")
