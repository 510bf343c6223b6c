"""Array passes over the UTF-8 buffer of an Arrow string column: no Python object per word.

Texts are taken in chunks of a few MB, so that memory does not grow with a batch. A text is
never cut: a chunk holds one whole text at least.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes 9-13 and 32 part words; every other byte belongs to one.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def chunks(col: pa.Array, max_bytes: int = 1 << 21) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets in them) of runs of rows; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    n = len(col)
    if not n:
        return
    _, at, data = col.buffers()
    off = np.frombuffer(at, kind)[col.offset : col.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(off, off[lo] + max_bytes, "right")) - 1))
        yield lo, hi, raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def spans(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True, which do not cross the offsets of texts."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.empty(n, bool)
    first[0] = True
    np.logical_not(inside[:-1], out=first[1:])
    at = off[:-1]
    first[at[at < n]] = True
    last = np.empty(n, bool)
    last[-1] = True
    np.logical_not(inside[1:], out=last[:-1])
    at = off[1:]
    last[at[at > 0] - 1] = True
    return np.flatnonzero(inside & first), np.flatnonzero(inside & last) + 1


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix_hash(raw: np.ndarray) -> np.ndarray:
    """Sums modulo 2**64 of byte times power of its position, from which any slice's hash follows."""
    up, _ = _power(len(raw) + 1)
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=out[1:])
    return out


def slice_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = _power(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start])


def word_hashes(raw: np.ndarray, off: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of each word, and the first word of each text with the number of words at the end."""
    start, end = spans(~SPACE[raw], off)
    return slice_hash(prefix_hash(LOWER[raw] if lower else raw), start, end), start, end, np.searchsorted(start, off)


def word_codes(data: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Number of each word among the distinct ones, and these: equal numbers are equal bytes. The words stand one behind the other in ``data``."""
    off = np.concatenate([[0], np.cumsum(size)])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(data))])
    coded = words.dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary


def wide_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """128 bits (two columns) of each word: up to 15 bytes the bytes themselves under a bijection, so that no two words
    share them; of longer words BLAKE2 of the bytes."""
    size = end - start
    out = np.zeros((len(start), 2), np.uint64)
    short = np.flatnonzero(size <= 15)
    begin, n = start[short], size[short]
    for j in range(min(15, int(n.max(initial=0)))):
        more = np.flatnonzero(n > j)
        out[short[more], j >> 3] |= raw[begin[more] + j].astype(np.uint64) << np.uint64(8 * (j & 7))
    out[short, 1] |= (n + 1).astype(np.uint64) << np.uint64(56)
    long = np.flatnonzero(size > 15)
    if len(long):
        inside = np.zeros(len(raw) + 1, np.int8)
        inside[start[long]] = 1
        np.subtract.at(inside, end[long], 1)
        code, distinct = word_codes(raw[np.cumsum(inside[:-1], dtype=np.int8).view(bool)], size[long])
        of_word = np.frombuffer(b"".join(blake2b(w, digest_size=16).digest() for w in distinct.to_pylist()), "<u8").reshape(-1, 2).copy()
        of_word[:, 1] |= np.uint64(0xFF << 56)  # no short word has this
        out[long] = of_word[code]
    a, b = out[:, 0], out[:, 1]
    for k in (0x243F6A8885A308D3, 0x13198A2E03707344):  # a Feistel network, which can be undone
        a = a + mix(b ^ np.uint64(k))
        b = b + mix(a ^ np.uint64(k))
    return np.column_stack([a, b])


def shingle_hashes(raw: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two 64-bit halves of a hash of each run of ``size`` words of a text (all its words if it has fewer), and each text's first.

    A run's hash is mixed in order from its words' ``wide_hashes``, A-Z in lower case.
    """
    small = LOWER[raw]
    start, end = spans(~SPACE[raw], off)
    first = np.searchsorted(start, off)
    words = wide_hashes(small, start, end)
    n, count = len(words), np.diff(first)
    out_first = np.concatenate([[0], np.cumsum(np.where(count >= size, count - size + 1, np.minimum(count, 1)))])
    high, low = np.zeros((2, int(out_first[-1])), np.uint64)

    def run(h: np.ndarray, g: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = mix((h + w[:, 0]) * np.uint64(0x9E3779B97F4A7C15))
        return h, mix((g ^ w[:, 1]) * np.uint64(0xD6E8FEB86659FD93) + h)

    if n >= size:
        h = g = np.full(n - size + 1, size, np.uint64)
        for k in range(size):
            h, g = run(h, g, words[k : n - size + 1 + k])
        long = np.flatnonzero(count >= size)
        lengths = count[long] - size + 1
        within = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        place, source = np.repeat(out_first[:-1][long], lengths) + within, np.repeat(first[:-1][long], lengths) + within
        high[place], low[place] = h[source], g[source]
    short = np.flatnonzero((count > 0) & (count < size))
    h = g = count[short].astype(np.uint64)
    for k in range(size - 1):
        more = np.flatnonzero(count[short] > k)
        h, g = h.copy(), g.copy()
        h[more], g[more] = run(h[more], g[more], words[first[short[more]] + k])
    high[out_first[short]], low[out_first[short]] = h, g
    return high, low, out_first


def shingle_codes(col: pa.Array, size: int) -> list[np.ndarray]:
    """Sorted distinct numbers of the runs of ``size`` words of each text: two runs have one number if and only if their words are equal.

    All texts are numbered together, so their bytes should be bounded. Fewer words than ``size`` have no run.
    """
    out: list[np.ndarray] = []
    for _, _, raw, off in chunks(col, 1 << 62):
        start, end = spans(~SPACE[raw], off)
        first = np.searchsorted(start, off)
        words, distinct = word_codes(LOWER[raw[~SPACE[raw]]], end - start)
        runs = words[: max(0, len(words) - size + 1)]
        for k in range(1, size):
            _, runs = np.unique(runs * (len(distinct) + 1) + words[k : k + len(runs)], return_inverse=True)
        out = [np.unique(runs[a : max(a, b - size + 1)]) for a, b in zip(first, first[1:], strict=False)]
    return out
