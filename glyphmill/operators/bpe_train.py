"""BPE training: a distributed histogram of pre-tokens, and merges learned from it.

The pair of most occurrences is merged; among equals the one whose bytes are greatest, left side
first. Two loops give the same merges. Histograms of at most ``DRIVER_TYPES`` distinct pre-tokens go
to the driver, where pair counts are kept up to date merge by merge. Larger ones stay
distributed: blocks of token numbers, of which each pass gives the changes of pair counts, written anew every few passes.
"""

from __future__ import annotations

import heapq
from collections.abc import Collection, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.scratch import written

#: Distinct pre-tokens, about 100 bytes each in the driver, up to which its loop is taken.
DRIVER_TYPES = 2_000_000
#: Passes over a written table, before it is written again; pairs looked at for merges of one pass.
ROUNDS, TOP = 4, 256
#: Tokens of a block of types.
BLOCK = 1 << 18


def histogram(docs: DataFrame, text_col: str = "text", specials: Sequence[str] = ()) -> DataFrame:
    """(pretoken, n) over all documents; special tokens part them and are not counted."""
    pieces = docs.select(F.explode(T.without_specials(F.col(text_col), specials)).alias("piece"))
    return pieces.select(F.explode(T.pretokens(F.col("piece"))).alias("pretoken")).groupBy("pretoken").agg(F.count("*").alias("n"))


def hex_types(counts: DataFrame) -> DataFrame:
    """(tokens, n): pre-tokens as hex tokens, one a byte."""
    return counts.select(T.hex_tokens(F.col("pretoken")).alias("tokens"), "n")


def pair_counts(types: DataFrame) -> DataFrame:
    """(left_hex, right_hex, n) of adjacent tokens, weighted."""
    listed = types.select(T.token_list(F.col("tokens")).alias("t"), "n").filter(F.size("t") > 1)
    pairs = listed.select(F.explode(F.arrays_zip(F.expr("slice(t, 1, size(t) - 1)").alias("l"), F.expr("slice(t, 2, size(t) - 1)").alias("r"))).alias("p"), "n")
    return pairs.groupBy(F.col("p.l").alias("left_hex"), F.col("p.r").alias("right_hex")).agg(F.sum("n").alias("n"))


def best_pair(pairs: DataFrame) -> DataFrame:
    """One row at most: the pair to merge. Order of hex is order of bytes."""
    top = pairs.agg(F.max(F.struct("n", "left_hex", "right_hex")).alias("b")).filter("b IS NOT NULL")
    return top.select("b.left_hex", "b.right_hex", "b.n")


def merge_step(types: DataFrame, left: str, right: str) -> DataFrame:
    return types.withColumn("tokens", T.apply_merge(F.col("tokens"), left, right))


def settled(top: Sequence[tuple[int, bytes, bytes]], known: Collection[bytes] = ()) -> list[tuple[bytes, bytes, int]]:
    """The merges that are sure to come next, given the first pairs in order of (occurrences, left, right) from the greatest down.

    Pairs of which no two share a token leave each other's counts alone, and a pair that a merge makes occurs no oftener
    than a pair of one of its tokens that is not among them did. So those that occur oftener than the first pair left out
    come next, in order. A merge that makes a token there is already (``known``) adds to that token's pairs, and so is the last.
    """
    out: list[tuple[bytes, bytes, int]] = []
    used: set[bytes] = set()
    least = top[-1][0] if len(top) == TOP else 0
    for n, left, right in top:
        if left in used or right in used:
            least = n
            break
        out.append((left, right, n))
        used |= {left, right}
    out = [m for m in out if m[2] > least] or out[:1]
    there = set(known)
    for k, (left, right, _) in enumerate(out):
        if left + right in there:
            return out[: k + 1]
        there.add(left + right)
    return out


def _blocks(batches: Iterator[pa.RecordBatch], end: int) -> Iterator[pa.RecordBatch]:
    """(tokens, weights) of (pretoken, n): many types a row, as token numbers with ``end`` behind each type, and the types' occurrences."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def block() -> pa.RecordBatch:
        tokens, weights = (np.concatenate(x).tobytes() for x in zip(*held, strict=True))
        return pa.RecordBatch.from_arrays([pa.array([tokens], pa.binary()), pa.array([weights], pa.binary())], names=["tokens", "weights"])

    for batch in batches:
        words = [w.encode() for w in batch.column(0).to_pylist()]
        size = np.array([len(w) for w in words], np.int64)
        tokens = np.full(int(size.sum()) + len(words), end, _kind(end))
        tokens[np.arange(int(size.sum())) + np.repeat(np.arange(len(words)), size)] = np.frombuffer(b"".join(words), np.uint8)
        held.append((tokens, batch.column(1).to_numpy().astype(np.int64)))
        if sum(len(x) for x, _ in held) >= BLOCK:
            yield block()
            held.clear()
    if held:
        yield block()


def _kind(end: int) -> type:
    return np.uint16 if end < 1 << 16 else np.int32


def _places(tokens: np.ndarray, merges: Sequence[tuple[int, int, int]], end: int) -> np.ndarray:
    """Where merges (left, right, made) are made; no two of them share a token, so that all are made at once."""
    right = np.full(end + 1, end, tokens.dtype)
    right[[x for x, _, _ in merges]] = [y for _, y, _ in merges]
    at = np.flatnonzero(right[tokens[:-1]] == tokens[1:])
    at = at[tokens[at + 1] != end]
    if any(x == y for x, y, _ in merges) and len(at):  # of a run every other place, from its left
        begins = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1] + 1]))
        at = at[(at - np.repeat(at[begins], np.diff(np.append(begins, len(at))))) % 2 == 0]
    return at


def _made(tokens: np.ndarray, at: np.ndarray, merges: Sequence[tuple[int, int, int]], end: int) -> np.ndarray:
    made = np.zeros(end + 1, tokens.dtype)
    made[[x for x, _, _ in merges]] = [z for _, _, z in merges]
    tokens = tokens.copy()
    tokens[at] = made[tokens[at]]
    return np.delete(tokens, at + 1)


def _merged(tokens: np.ndarray, rounds: Sequence[Sequence[tuple[int, int, int]]], end: int) -> np.ndarray:
    for merges in rounds:
        tokens = _made(tokens, _places(tokens, merges, end), merges, end)
    return tokens


def _pairs_at(tokens: np.ndarray, weights: np.ndarray, at: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """(left * (end + 1) + right, occurrences) of the pairs that begin at places, as far as there are any."""
    at = at[(at >= 0) & (at + 1 < len(tokens))]
    at = at[(tokens[at] != end) & (tokens[at + 1] != end)]
    return tokens[at].astype(np.int64) * (end + 1) + tokens[at + 1], weights[np.searchsorted(np.flatnonzero(tokens == end), at)]


def _changes(tokens: np.ndarray, weights: np.ndarray, merges: Sequence[tuple[int, int, int]], end: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs that merges take away and add; of no merges, all pairs."""
    if not merges:
        return [_pairs_at(tokens, weights, np.arange(len(tokens)), end)]
    at = _places(tokens, merges, end)
    key, n = _pairs_at(tokens, weights, np.unique(np.concatenate([at - 1, at, at + 1])), end)
    now = at - np.arange(len(at))
    return [(key, -n), _pairs_at(_made(tokens, at, merges, end), weights, np.unique(np.concatenate([now - 1, now])), end)]


def train_distributed(counts: DataFrame, n_merges: int) -> list[tuple[bytes, bytes, int]]:
    """(left, right, occurrences) of each merge; fewer when no pair is left. Each pass over the types makes all merges that are ``settled``.

    Types stand in blocks of token numbers. A task makes the merges since the table was last written, and sums what the last
    of them change in the counts of pairs; Spark sums the tasks' changes. The driver holds the counts, 16 bytes a distinct pair.
    """
    names: list[bytes] = [bytes([b]) for b in range(256)]
    number = {t: i for i, t in enumerate(names)}
    end, schema = 256 + max(0, n_merges), "tokens binary, weights binary"  # ``end`` is no token
    tasks = max(1, counts.sparkSession.sparkContext.defaultParallelism)
    blocks = counts.select("pretoken", F.col("n").cast("long")).mapInArrow(lambda batches: _blocks(batches, end), schema)
    types = written(blocks.repartition(tasks))
    merges: list[tuple[bytes, bytes, int]] = []
    rounds: list[list[tuple[int, int, int]]] = [[]]

    def read(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for tokens, weights in zip(batch.column(0), batch.column(1), strict=True):
            yield np.frombuffer(tokens.as_buffer(), _kind(end)), np.frombuffer(weights.as_buffer(), np.int64)

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [_merged(tokens, rounds, end).tobytes() for tokens, _ in read(batch)]
            yield pa.RecordBatch.from_arrays([pa.array(done, pa.binary()), batch.column(1)], names=["tokens", "weights"])

    def changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [x for tokens, weights in read(batch) for x in _changes(_merged(tokens, rounds[:-1], end), weights, rounds[-1], end)]
            key, n = _totals(*(np.concatenate(x) for x in zip(*parts, strict=True))) if parts else (np.zeros(0, np.int64),) * 2
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["pair", "n"])

    pairs, n_pairs = np.zeros(0, np.int64), np.zeros(0, np.int64)
    while len(merges) < n_merges:
        got = types.mapInArrow(changes, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
        pairs, n_pairs = _totals(np.concatenate([pairs, got["pair"].to_numpy()]), np.concatenate([n_pairs, got["n"].to_numpy()]))
        pairs, n_pairs = pairs[n_pairs > 0], n_pairs[n_pairs > 0]
        if not len(pairs):
            break
        first = np.flatnonzero(n_pairs >= np.partition(n_pairs, -TOP)[-TOP]) if len(pairs) > TOP else np.arange(len(pairs))
        top = sorted(((int(n_pairs[i]), names[pairs[i] // (end + 1)], names[pairs[i] % (end + 1)]) for i in first), reverse=True)[:TOP]
        new = settled(top, [a + b for a, b, _ in merges])[: n_merges - len(merges)]
        merges += new
        for left, right, _ in new:
            if left + right not in number:
                number[left + right] = len(names)
                names.append(left + right)
        if len(rounds) >= ROUNDS:
            types = written(types.mapInArrow(forward, schema))
            rounds.clear()
        rounds.append([(number[a], number[b], number[a + b]) for a, b, _ in new])
    return merges


def _totals(keys: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys, each once, with their summed weights."""
    order = np.argsort(keys, kind="stable")
    keys, weight = keys[order], weight[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(weight, first) if len(first) else weight


class _Desc:
    """Orders pairs of byte strings from the greatest down, for a heap."""

    __slots__ = ("pair",)

    def __init__(self, pair: tuple[bytes, bytes]):
        self.pair = pair

    def __lt__(self, other: _Desc) -> bool:
        return self.pair > other.pair


def _sums(keys: np.ndarray, weight: np.ndarray) -> Iterator[tuple[int, int]]:
    """Keys with their summed weights."""
    keys, weight = _totals(keys, weight)
    yield from zip(keys.tolist(), weight.tolist(), strict=True)


def learn(counts: dict[bytes, int], n_merges: int) -> list[tuple[bytes, bytes, int]]:
    """The same in one process: all types stand in one array of token numbers, and a merge changes the counts of the pairs around its places."""
    token = np.frombuffer(b"".join(counts), np.uint8).astype(np.int32)
    size = np.array([len(w) for w in counts], np.int64)
    word = np.repeat(np.arange(len(counts), dtype=np.int32), size)
    weight = np.array(list(counts.values()), np.int64)
    names: list[bytes] = [bytes([b]) for b in range(256)]
    total: dict[int, int] = {}
    heap: list[tuple[int, _Desc, int]] = []

    def pairs(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys and weights of the pairs that begin at places, as far as there are any."""
        at = at[(at >= 0) & (at + 1 < len(token))]
        at = at[word[at] == word[at + 1]]
        return token[at].astype(np.int64) << 32 | token[at + 1], weight[word[at]]

    def push(key: int) -> None:
        if total[key] > 0:
            heapq.heappush(heap, (-total[key], _Desc((names[key >> 32], names[key & 0xFFFFFFFF])), key))

    for key, n in _sums(*pairs(np.arange(len(token)))):
        total[key] = n
        push(key)
    merges: list[tuple[bytes, bytes, int]] = []
    made: dict[bytes, int] = {}
    while heap and len(merges) < n_merges:
        n, _, key = heapq.heappop(heap)
        if total[key] != -n:
            continue  # counted anew since, and pushed again then
        a, b = key >> 32, key & 0xFFFFFFFF
        merges.append((names[a], names[b], -n))
        at = np.flatnonzero((token[:-1] == a) & (token[1:] == b) & (word[:-1] == word[1:]))
        if a == b:  # of a run every other place, from its left
            begins = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1] + 1]))
            at = at[(at - np.repeat(at[begins], np.diff(np.append(begins, len(at))))) % 2 == 0]
        changed: set[int] = set()
        for k, w in _sums(*pairs(np.unique(np.concatenate([at - 1, at, at + 1])))):
            total[k] -= w
            changed.add(k)
        joined = names[a] + names[b]
        if joined not in made:  # two merges can make one token
            made[joined] = len(names)
            names.append(joined)
        token[at] = made[joined]
        keep = np.ones(len(token), bool)
        keep[at + 1] = False
        token, word = token[keep], word[keep]
        now = at - np.arange(len(at))
        for k, w in _sums(*pairs(np.unique(np.concatenate([now - 1, now])))):
            total[k] = total.get(k, 0) + w
            changed.add(k)
        for k in changed:
            push(k)
    return merges


def train(docs: DataFrame, vocab_size: int, specials: Sequence[str] = (), text_col: str = "text") -> tuple[dict[int, bytes], list[tuple[bytes, bytes]]]:
    """(vocabulary, merges): 256 bytes, then special tokens, then merged tokens in order, up to ``vocab_size``."""
    counts = written(histogram(docs, text_col, specials))
    n = max(0, vocab_size - 256 - len(specials))
    if counts.count() <= DRIVER_TYPES:
        merges = learn({r["pretoken"].encode(): r["n"] for r in counts.toLocalIterator()}, n)
    else:
        merges = train_distributed(counts, n)
    vocab = dict(enumerate([*(bytes([i]) for i in range(256)), *(s.encode() for s in specials), *(a + b for a, b, _ in merges)]))
    return vocab, [(a, b) for a, b, _ in merges]


def train_by_group(docs: DataFrame, group_col: str, vocab_size: int, text_col: str = "text") -> DataFrame:
    """(group, rank, left, right, n): a tokenizer for each group, learned in one task from a histogram of at most ``DRIVER_TYPES``
    distinct pre-tokens; a group with more is learned by the distributed loop."""
    counts = written(docs.select(F.col(group_col).cast("string").alias("g"), F.explode(T.pretokens(F.col(text_col))).alias("pretoken")).groupBy("g", "pretoken").agg(F.count("*").alias("n")))
    n_merges = max(0, vocab_size - 256)
    schema = "g string, rank int, left binary, right binary, n long"
    large = [r["g"] for r in counts.groupBy("g").agg(F.count("*").alias("types")).filter(F.col("types") > DRIVER_TYPES).collect()]  # fewer than all types / DRIVER_TYPES

    def run(key, pdf):
        import pandas as pd

        got = learn({p.encode(): int(n) for p, n in zip(pdf.pretoken, pdf.n, strict=True)}, n_merges)
        return pd.DataFrame({"g": [key[0]] * len(got), "rank": range(len(got)), "left": [a for a, _, _ in got], "right": [b for _, b, _ in got], "n": [n for _, _, n in got]})

    is_large = F.lit(False)
    out = []
    for g in large:
        mine = F.col("g").eqNullSafe(F.lit(g))
        is_large |= mine
        got = train_distributed(counts.filter(mine).select("pretoken", "n"), n_merges)
        out.append(docs.sparkSession.createDataFrame([(g, i, bytearray(a), bytearray(b), n) for i, (a, b, n) in enumerate(got)], schema))
    out.append(counts.filter(~is_large).groupBy("g").applyInPandas(run, schema))
    done = out[0]
    for more in out[1:]:
        done = done.unionByName(more)
    return done.withColumnRenamed("g", group_col)


def merges_table(spark: SparkSession, merges: Sequence[tuple[bytes, bytes]]) -> DataFrame:
    return spark.createDataFrame([(i, bytearray(a), bytearray(b)) for i, (a, b) in enumerate(merges)], "rank int, left binary, right binary")


def vocab_table(spark: SparkSession, vocab: dict[int, bytes]) -> DataFrame:
    return spark.createDataFrame([(i, bytearray(t)) for i, t in vocab.items()], "token_id int, token binary")
