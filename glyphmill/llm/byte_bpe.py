"""Byte-level BPE encoding and decoding with array-scan pre-tokenisation.

Pre-tokens are those of the pattern ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``.
No regular expression runs over a text. Each code point gets a symbol: its class with what
one glance ahead decides (is the next one white space; does this apostrophe open a contraction).
A symbol stands for a transition function on eight scanner states. Composition of functions is
associative, and the functions that symbols generate are few, so a blocked prefix scan over
their numbers gives the state before every code point at once; state and symbol tell whether a
pre-token starts there.

Slices between starts feed a bounded memo of pair merging. Ids are stored as little-endian
unsigned 32-bit integers; decoding gathers each id's bytes by offset from one byte table.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, table
from .textscan import chunks

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Merged slices that a Python worker remembers before it starts afresh.
MEMO_ENTRIES = 150_000
#: Bytes of text scanned at a time, so that the arrays stay in a core's cache.
CHUNK = 1 << 18

# Scanner states: a pre-token must start here; inside letters, numbers, others; after a space
# that joins what follows; after other white space; one or two letters of a contraction to come.
START, LETTER, NUMBER, OTHER, JOINS, WHITE, ONE, TWO = range(8)
# Symbols: letter, number, other; apostrophe before s t m d; before re ve ll; white space with
# more white space or the text's end behind it; last space of a run; last other white space of a run.
L, N, O, Q1, Q2, INNER, SPACE, LAST = range(8)

_NEXT = np.zeros((8, 8), np.uint8)  # symbol, state
_STARTS = np.zeros((8, 8), bool)
for _symbol, _into in ((L, LETTER), (N, NUMBER), (O, OTHER), (Q1, ONE), (Q2, TWO), (INNER, WHITE), (SPACE, JOINS), (LAST, WHITE)):
    for _state in range(8):
        _goes_on = _state == _into and _symbol in (L, N, O, INNER) or _state == JOINS and _symbol in (L, N, O)
        _NEXT[_symbol, _state], _STARTS[_symbol, _state] = _into, not _goes_on
        if _symbol in (Q1, Q2) and _state in (OTHER, JOINS):  # inside a run of others, it is one of them
            _NEXT[_symbol, _state], _STARTS[_symbol, _state] = OTHER, False
        if _state in (ONE, TWO):
            _NEXT[_symbol, _state], _STARTS[_symbol, _state] = START if _state == ONE else ONE, False


def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All functions that symbols generate: (number of each symbol's, composition table, values).

    Symbols 8-15 are those of a text's first code point: they act as if the state were START.
    """
    symbols = [tuple(int(x) for x in _NEXT[s]) for s in range(8)] + [(int(_NEXT[s, START]),) * 8 for s in range(8)]
    number = {tuple(range(8)): 0}
    todo = [tuple(range(8))]
    while todo:
        f = todo.pop()
        for g in symbols:
            h = tuple(g[x] for x in f)
            if h not in number:
                number[h] = len(number)
                todo.append(h)
    value = np.array(list(number), np.uint8)
    compose = np.array([[number[tuple(int(g[x]) for x in f)] for g in value] for f in value], np.uint16)
    return np.array([number[s] for s in symbols], np.uint16), compose, value


_OF_SYMBOL, _COMPOSE, _VALUE = _monoid()


@lru_cache(1)
def _classes() -> np.ndarray:
    """Symbol of each code point, before looking ahead; white space is INNER.

    The classes are asked of tiktoken's own pattern engine once per process, so that both
    know the same version of Unicode: what a one-class pattern matches in the string of all
    code points comes back as bytes.
    """
    every = "".join(chr(x) for x in range(0x110000) if not 0xD800 <= x < 0xE000)
    out = np.full(0x110000, O, np.uint8)
    for pattern, symbol in ((r"\p{L}", L), (r"\p{N}", N), (r"\s", INNER)):
        probe = tiktoken.Encoding("classes", pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        out[np.frombuffer(bytes(probe.encode_ordinary(every)).decode().encode("utf-32-le"), np.uint32)] = symbol
    return out


def _states(functions: np.ndarray, block: int = 64) -> np.ndarray:
    """State before each position, when the first is START: a blocked scan of function composition."""
    n = len(functions)
    if n <= block:
        out, state = np.zeros(n, np.uint8), START
        for i, f in enumerate(functions):
            out[i] = state
            state = _VALUE[f, state]
        return out
    rows = -(-n // block)
    padded = np.zeros(rows * block, np.uint16)
    padded[:n] = functions
    columns = np.ascontiguousarray(padded.reshape(rows, block).T)
    before = np.empty_like(columns)
    so_far = np.zeros(rows, np.uint16)
    flat, width = _COMPOSE.ravel(), np.intp(_COMPOSE.shape[1])
    for j in range(block):
        before[j] = so_far
        so_far = flat[so_far * width + columns[j]]
    at_row = _states(so_far, block)
    state = _VALUE.ravel()[before.astype(np.intp) * 8 + at_row]
    return state.T.reshape(-1)[:n]


def boundaries(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Byte offsets of all pre-tokens' starts in texts that stand one behind the other."""
    if not len(raw):
        return np.zeros(0, np.int64)
    point = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    at_byte = np.flatnonzero((raw & 0xC0) != 0x80)
    n = len(point)
    symbol = _classes()[point]
    first = np.searchsorted(at_byte, off[:-1][off[:-1] < len(raw)])  # empty texts have none of their own
    ends = np.zeros(n + 1, bool)  # a text ends before this code point
    ends[first] = True
    ends[n] = True
    white = symbol == INNER
    last = white.copy()
    last[:-1] &= ~white[1:]
    last &= ~ends[1:]
    last[-1] = False
    symbol[last] = LAST
    symbol[last & (point == 32)] = SPACE
    quote = np.flatnonzero((point == 39) & ~ends[1:])
    if len(quote):
        follows = point[quote + 1]
        one = np.isin(follows, [ord(c) for c in "stmd"])
        symbol[quote[one]] = Q1
        two = quote[~one]
        two = two[(two + 2 < n) & ~ends[np.minimum(two + 2, n)]]
        a, b = point[two + 1], point[two + 2]
        two = two[((b == ord("e")) & ((a == ord("r")) | (a == ord("v")))) | ((a == ord("l")) & (b == ord("l")))]
        symbol[two] = Q2
    functions = _OF_SYMBOL[symbol]
    functions[first] = _OF_SYMBOL[symbol[first] + 8]
    starts = _STARTS.ravel()[symbol.astype(np.intp) * 8 + _states(functions)]
    starts[first] = True
    return at_byte[starts]


def load_ranks(path: str) -> dict[bytes, int]:
    """A .tiktoken file: one base64 token and its rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a slice: the adjacent pair of lowest rank, leftmost first, is joined until none has a rank."""
    if piece in ranks:
        return [ranks[piece]]
    if len(piece) > 100:
        return _merge_long(piece, ranks)
    parts, none = [piece[i : i + 1] for i in range(len(piece))], 1 << 60
    scores = [ranks.get(parts[i] + parts[i + 1], none) for i in range(len(parts) - 1)]
    while scores and (best := min(scores)) < none:
        i = scores.index(best)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del scores[i]
        if i < len(scores):
            scores[i] = ranks.get(parts[i] + parts[i + 1], none)
        if i:
            scores[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
    return [ranks[p] for p in parts]


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same by a heap over a linked list, for slices of any length."""
    n = len(piece)
    end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i] if end[i] else n
        if not end[i] or j >= n or end[j] != stop:  # one of the two has changed since
            continue
        end[i], end[j], after[i] = stop, 0, after[j]
        if after[j] < n:
            before[after[j]] = i
            if (r := ranks.get(piece[i : end[after[j]]])) is not None:
                heapq.heappush(heap, (r, i, end[after[j]]))
        if (k := before[i]) >= 0 and (r := ranks.get(piece[k:stop])) is not None:
            heapq.heappush(heap, (r, k, stop))
    return [ranks[piece[i : end[i]]] for i in range(n) if end[i]]


class Pairs:
    """Rank of each pair of ids whose bytes together are a token: every split of every token in two tokens."""

    def __init__(self, ranks: dict[bytes, int]):
        keys = [((a << 32) | b, r) for t, r in ranks.items() for i in range(1, len(t)) if (a := ranks.get(t[:i])) is not None and (b := ranks.get(t[i:])) is not None]
        keys.sort()
        self.key = np.array([k for k, _ in keys] or [-1], np.int64)
        self.rank = np.array([r for _, r in keys] or [NONE], np.int32)
        self.byte = np.array([ranks.get(bytes([i]), NONE) for i in range(256)], np.int32)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a.astype(np.int64) << 32) | b
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.rank[at], NONE)


NONE = np.iinfo(np.int32).max


def merge_many(pieces: list[bytes], pairs: Pairs) -> list[bytes]:
    """Packed ids of slices of similar length, all merged side by side: one pair of each a round."""
    size = np.array([len(p) for p in pieces])
    width = int(size.max())
    ids = np.full((len(pieces), width + 1), -1, np.int32)
    inside = np.arange(width + 1) < size[:, None]
    ids[inside] = pairs.byte[np.frombuffer(b"".join(pieces), np.uint8)]
    score = np.full((len(pieces), width), NONE, np.int32)
    both = inside[:, 1:]
    score[both] = pairs(ids[:, :-1][both], ids[:, 1:][both])
    out: list[bytes] = [b""] * len(pieces)
    row = np.arange(len(pieces))
    column = np.arange(width + 1)
    while len(row):
        at = score.argmin(1)
        best = score[np.arange(len(row)), at]
        done = best == NONE
        if done.any():
            for r, x in zip(row[done].tolist(), ids[done].astype("<u4"), strict=True):
                out[r] = x[x != 0xFFFFFFFF].tobytes()
            go = ~done
            row, ids, score, at, best = row[go], ids[go], score[go], at[go], best[go]
            if not len(row):
                break
        k = np.arange(len(row))
        ids[k, at] = best
        shifted = column[:-1] > at[:, None]  # what stands behind the pair moves up by one
        ids[:, :-1] = np.where(shifted, ids[:, 1:], ids[:, :-1])
        ids[:, -1] = -1
        score[:, :-1] = np.where(shifted[:, :-1], score[:, 1:], score[:, :-1])
        score[:, -1] = NONE
        right = ids[k, at + 1]
        score[k, at] = np.where(right >= 0, pairs(best, right), NONE)
        some = np.flatnonzero(at > 0)
        score[some, at[some] - 1] = pairs(ids[some, at[some] - 1], best[some])
    return out


class Memo(dict):
    """Slice to packed ids; starts afresh beyond a number of entries, so memory is bounded."""

    def __init__(self, ranks: dict[bytes, int], pairs: Pairs, entries: int = MEMO_ENTRIES):
        self.ranks, self.pairs, self.entries = ranks, pairs, entries

    def learn(self, pieces: list[bytes]) -> None:
        """Merge the slices not known yet: short ones side by side, blocks of similar length at a time."""
        new = set(pieces).difference(self)
        if len(self) + len(new) > self.entries:
            self.clear()
            new = set(pieces)
        ranks, rest = self.ranks, []
        for p in new:
            if (r := ranks.get(p)) is not None:
                self[p] = r.to_bytes(4, "little")
            elif len(p) > 48:
                self[p] = np.array(merge(p, ranks), "<u4").tobytes()
            else:
                rest.append(p)
        rest.sort(key=len)
        for i in range(0, len(rest), 4096):
            self.update(zip(block := rest[i : i + 4096], merge_many(block, self.pairs), strict=True))


@lru_cache(2)
def _ranks(path: str) -> dict[bytes, int]:
    return load_ranks(path)


@lru_cache(2)
def _pairs(path: str) -> Pairs:
    return Pairs(_ranks(path))


@lru_cache(2)
def _byte_table(path: str) -> tuple[np.ndarray, np.ndarray]:
    ranks = _ranks(path)
    by_id = {i: t for t, i in ranks.items()}
    size = max(by_id, default=-1) + 1
    tokens = [by_id.get(i, b"") for i in range(size)]
    off = np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype(np.int64)
    return np.frombuffer(b"".join(tokens), np.uint8), off


def decode_ids(ids: np.ndarray, path: str) -> bytes:
    """Bytes of the ids, gathered by each id's offset; ids without a token give nothing."""
    data, off = _byte_table(path)
    ids = ids[ids < len(off) - 1].astype(np.intp)
    size = off[ids + 1] - off[ids]
    ends = np.cumsum(size)
    if not len(ids):
        return b""
    return data[np.repeat(off[ids] - (ends - size), size) + np.arange(ends[-1])].tobytes()


def _place(name: str) -> str:
    return name if "/" in name else public_tokenizers.path(name)


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, decoded_col: str | None = None, slices_col: str | None = None) -> DataFrame:
    """(``id_col``, ids BINARY) for each row: packed little-endian unsigned 32-bit ids of the whole text.

    With ``slices_col`` a column of that name follows: for each slice of the pre-tokenisation the offset of its first
    byte in the text and of its first id, packed as pairs of unsigned 32-bit integers, so that ``decode_slices`` can
    decode any part without the rest.

    With ``decoded_col`` a column of that name follows, the bytes that the packed ids decode to, as ``decode``
    gives them, made in the same Python worker. Ties between pairs of one rank go to the leftmost. Texts of any length
    are encoded whole, scanned ``CHUNK`` bytes at a time but never cut. A null or empty text gives empty ids; a null id is kept; other
    columns, whatever their names, are not read; repeated rows give repeated rows; an empty table gives an empty one.
    ``vocabulary`` is a file of public_tokenizers or a path that every machine has.
    """
    small_batches(df.sparkSession)
    kind = df.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(_ranks(_place(vocabulary)), _pairs(_place(vocabulary)))
        take = memo.__getitem__
        for batch in batches:
            for lo, hi, raw, off in chunks(batch.column(1), CHUNK):
                start = boundaries(raw, off)
                text, cut = raw.tobytes(), np.append(start, len(raw))
                first = np.searchsorted(start, off).tolist()
                cut = cut.tolist()
                pieces = [text[i:j] for i, j in zip(cut, cut[1:], strict=False)]
                memo.learn(pieces)
                ids = [b"".join(map(take, pieces[a:b])) for a, b in zip(first, first[1:], strict=False)]
                out = {"id": batch.column(0).slice(lo, hi - lo), "ids": pa.array(ids, pa.binary())}
                if slices_col is not None:
                    count = np.array([len(take(p)) >> 2 for p in pieces], np.int64)
                    before = np.cumsum(count) - count
                    of_slice = [np.column_stack([start[a:b] - off[d], before[a:b] - before[a]]).astype("<u4").tobytes() if b > a else b"" for d, (a, b) in enumerate(zip(first, first[1:], strict=False))]
                    out["slices"] = pa.array(of_slice, pa.binary())
                if decoded_col is not None:
                    out["decoded"] = pa.array([decode_ids(np.frombuffer(x, "<u4"), _place(vocabulary)) for x in ids], pa.binary())
                yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    more = [(own, name) for own, name in (("slices", slices_col), ("decoded", decoded_col)) if name is not None]
    schema = f"id {kind.simpleString()}, ids binary" + "".join(f", {own} binary" for own, _ in more)
    return rows.mapInArrow(run, schema).toDF(id_col, "ids", *(name for _, name in more))


def decode_slices(ids: bytes, slices: bytes, first: int, last: int, vocabulary: str = VOCABULARY) -> tuple[int, bytes]:
    """(offset in the text, bytes) of the slices from ``first`` up to ``last``, not included, of one encoded text."""
    at = np.frombuffer(slices, "<u4").reshape(-1, 2)
    if not 0 <= first < last <= len(at):
        raise IndexError(f"slices {first} to {last} of {len(at)}")
    own = np.frombuffer(ids, "<u4")[at[first, 1] : at[last, 1] if last < len(at) else None]
    return int(at[first, 0]), decode_ids(own, _place(vocabulary))


def decode(df: DataFrame, ids_col: str = "ids", out_col: str = "decoded", vocabulary: str = VOCABULARY) -> DataFrame:
    """``df`` (any columns but ``out_col``) with the bytes that packed ids stand for; null ids give empty bytes."""
    where = df.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = _place(vocabulary)
        for batch in batches:
            out = [decode_ids(np.frombuffer(x.as_buffer(), "<u4"), path) if x.is_valid and len(x.as_buffer()) else b"" for x in batch.column(where)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, out_col])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out_col, T.BinaryType())]))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text of documents: ``encode`` says what becomes of odd rows."""
    done = encode(table(spark, sf_dir, "documents"), decoded_col="decoded")
    return done.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
