"""GIF media columns: an LZW codec, frames with palettes, disposal and transparency, and colour histograms.

``read_gif`` decodes any GIF87a or GIF89a stream: it follows the LZW code stream, applies local or
global palettes, transparency, interlacing and disposal, and gives timed frames with a histogram
of their canvas. ``write_gif`` stores bytes losslessly as palette indices of a grey palette, so
that sample, index and grey level are one number.

A payload is cut into frames of ``WIDTH`` columns and ``ROWS`` rows at most, so that the work and
memory of a frame are bounded however long a text is.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

WIDTH, ROWS = 192, 256
#: Bytes of texts or stored forms taken at a time, one row at least.
PART_BYTES = 1 << 22
#: Pixels of a canvas or an image beyond which a foreign file is not decoded: its few bytes could ask for any memory.
MOST_PIXELS = 1 << 26
#: Hundredths of a second that a written frame shows.
DELAY = 10
GREY = bytes(x for i in range(256) for x in (i, i, i))
BINS = 8

# LZW: 12 bits a code at most. What the j-th code after a clear code takes (the table grows by one
# entry with each code from the second on), and the bits before it.
_FREE = 4096


def _code_widths(clear: int, count: int) -> np.ndarray:
    size = clear + 2 + np.maximum(np.arange(count) - 1, 0)
    least = int(clear).bit_length()
    return np.clip(np.floor(np.log2(size)).astype(np.int64) + 1, least, 12)


def lzw_encode(samples: bytes) -> bytes:
    """Code stream of 8-bit samples: a clear code first, and again whenever all codes are in use."""
    codes: list[int] = [256]
    clears = [0]
    add = codes.append
    rest = iter(samples)
    code = next(rest, None)
    known: dict[int, int] = {}
    enter, free = known.setdefault, 258
    for byte in rest:
        hit = enter(code << 8 | byte, free)
        if hit != free:
            code = hit
            continue
        add(code)
        code = byte
        free += 1
        if free > _FREE:  # the entry made last has no code any more: start afresh
            clears.append(len(codes))
            add(256)
            known.clear()
            free = 258
    if code is not None:
        add(code)
    add(257)
    first = np.array(clears)
    count = np.diff(np.append(first, len(codes))) - 1  # codes under each table; the clear code behind is the next's
    widths = np.full(len(codes), 9, np.int64)
    rule = _code_widths(256, int(count.max()) + 2)
    for a, c in zip(first.tolist(), count.tolist(), strict=True):
        widths[a + 1 : a + c + 2] = rule[: len(widths[a + 1 : a + c + 2])]
    return _pack(np.array(codes, np.int64), widths)


def _pack(codes: np.ndarray, widths: np.ndarray) -> bytes:
    """Least significant bit first. Bits of different codes do not overlap, so that adding is or-ing."""
    at = np.cumsum(widths) - widths
    word, value = at >> 4, codes << (at & 15)
    size = int(word[-1]) + 2
    out = np.bincount(word, weights=value & 0xFFFF, minlength=size) + np.bincount(word + 1, weights=value >> 16, minlength=size)
    return out.astype("<u2").tobytes()[: -(-int(at[-1] + widths[-1]) // 8)]


def lzw_decode(data: bytes, least: int) -> bytes:
    """Samples of a code stream of ``least`` bits a sample; stops at the end code or where the data end."""
    clear, end = 1 << least, (1 << least) + 1
    bits = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.int64)
    total, bit, ended = len(data) * 8, 0, False
    rule = _code_widths(clear, 4096)
    behind = np.concatenate([[0], np.cumsum(rule)])
    out: list[bytes] = []
    while not ended:
        # all codes up to the next clear code stand at known places
        under: list[np.ndarray] = []
        at = 0
        while True:
            if at < len(rule):
                place, width = bit + behind[at:-1] - behind[at], rule[at:]
            else:
                place, width = bit + 12 * np.arange(4096), np.full(4096, 12)
            inside = int(np.searchsorted(place + width, total, "right"))
            place, width = place[:inside], width[:inside]
            byte = place >> 3
            codes = (bits[byte] | bits[byte + 1] << 8 | bits[byte + 2] << 16) >> (place & 7) & ((1 << width) - 1)
            stop = np.flatnonzero((codes == clear) | (codes == end))
            m = int(stop[0]) if len(stop) else len(codes)
            under.append(codes[:m])
            if len(stop) or not inside:
                ended = not len(stop) or codes[m] == end
                bit = int(place[m] + width[m]) if len(stop) else bit
                break
            bit, at = int(place[-1] + width[-1]), at + m
        out.append(_expand(np.concatenate(under), clear))
    return b"".join(out)


def _expand(codes: np.ndarray, clear: int) -> bytes:
    """Samples of the codes under one table.

    The entry made at the k-th code is what the code before it wrote plus the next sample, so a code
    copies from where that one wrote. Copies are followed to literals by pointer doubling.
    """
    if not len(codes):
        return b""
    k = np.arange(len(codes))
    literal = codes < clear
    source = np.where(literal, k, codes - clear - 2)
    if (source[~literal] >= k[~literal]).any():
        raise ValueError("a code before its table entry")
    size, to = (~literal).astype(np.int64), source
    while (more := size[to]).any():
        size, to = size + more, to[to]
    size = size + 1
    start = np.cumsum(size) - size
    n = int(size.sum())
    back = np.arange(n, dtype=np.int32) - np.repeat((start - start[source]).astype(np.int32), size)
    while not np.array_equal(further := back[back], back):
        back = further
    value = np.zeros(n, np.uint8)
    value[start[literal]] = codes[literal]
    return value[back].tobytes()


class Frame(NamedTuple):
    """A frame as stored (samples in rows) and as shown: when, how long, the canvas's colour histogram."""

    left: int
    top: int
    width: int
    height: int
    at_ms: int
    delay_ms: int
    samples: bytes
    histogram: list[int]


class Gif(NamedTuple):
    width: int
    height: int
    frames: list[Frame]


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(b)]) + b for i in range(0, len(data), 255) if (b := data[i : i + 255])) + b"\0"


def write_gif(payload: bytes) -> bytes:
    """Bytes as frames of a grey GIF89a, ``WIDTH`` samples a row; the length must be a positive multiple of it."""
    if not payload or len(payload) % WIDTH:
        raise ValueError("the payload is not a whole number of rows")
    step = WIDTH * ROWS
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, min(ROWS, len(payload) // WIDTH), 0xF7, 0, 0), GREY]
    for i in range(0, len(payload), step):
        samples = payload[i : i + step]
        out.append(struct.pack("<BBBBHBB", 0x21, 0xF9, 4, 1 << 2, DELAY, 0, 0))
        out.append(struct.pack("<BHHHHB", 0x2C, 0, 0, WIDTH, len(samples) // WIDTH, 0))
        out += [b"\x08", _blocks(lzw_encode(samples))]
    return b"".join([*out, b"\x3b"])


def _palette(raw: bytes) -> np.ndarray:
    rgb = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
    out = np.zeros(256, np.int32)
    out[: len(rgb)] = rgb[:, 0] << 16 | rgb[:, 1] << 8 | rgb[:, 2]
    return out


def histogram(canvas: np.ndarray) -> list[int]:
    """Counts of ``BINS`` levels of red, then green, then blue."""
    return [int(x) for shift in (21, 13, 5) for x in np.bincount((canvas.ravel() >> shift) & (BINS - 1), minlength=BINS)]


def read_gif(data: bytes) -> Gif:
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags, background, _ = struct.unpack_from("<HHBBB", data, 6)
    if width * height > MOST_PIXELS:
        raise ValueError("the canvas is too large")
    at, shared = 13, np.zeros(256, np.int32)
    if flags & 0x80:
        size = 3 << ((flags & 7) + 1)
        shared, at = _palette(data[at : at + size]), at + size
    ground = int(shared[background]) if flags & 0x80 else 0
    canvas = np.full((height, width), ground, np.int32)
    frames: list[Frame] = []
    delay, disposal, clear_index, clock = 0, 0, None, 0

    def blocks(at: int) -> tuple[bytes, int]:
        parts = []
        while at < len(data) and data[at]:
            parts.append(data[at + 1 : at + 1 + data[at]])
            at += 1 + data[at]
        return b"".join(parts), at + 1

    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21:
            kind = data[at + 1]
            body, at = blocks(at + 2)
            if kind == 0xF9 and len(body) >= 4:
                disposal, delay = body[0] >> 2 & 7, struct.unpack_from("<H", body, 1)[0]
                clear_index = body[3] if body[0] & 1 else None
            continue
        if data[at] != 0x2C:
            raise ValueError(f"unknown block {data[at]:#x}")
        left, top, w, h, local = struct.unpack_from("<HHHHB", data, at + 1)
        if w * h > MOST_PIXELS:
            raise ValueError("an image is too large")
        at, palette = at + 10, shared
        if local & 0x80:
            size = 3 << ((local & 7) + 1)
            palette, at = _palette(data[at : at + size]), at + size
        least = data[at]
        body, at = blocks(at + 1)
        samples = lzw_decode(body, least)[: w * h].ljust(w * h, b"\0")
        image = np.frombuffer(samples, np.uint8).reshape(h, w)
        if local & 0x40:
            order = [*range(0, h, 8), *range(4, h, 8), *range(2, h, 4), *range(1, h, 2)]
            straight = np.empty_like(image)
            straight[order] = image
            image, samples = straight, straight.tobytes()
        before = canvas.copy() if disposal == 3 else None
        part = canvas[top : top + h, left : left + w]
        image = image[: part.shape[0], : part.shape[1]]
        if clear_index is None:
            part[:] = palette[image]
        else:
            np.copyto(part, palette[image], where=image != clear_index)
        frames.append(Frame(left, top, w, h, clock * 10, delay * 10, samples, histogram(canvas)))
        clock += delay
        if disposal == 2:
            part[:] = ground
        elif before is not None:
            canvas = before
        delay, disposal, clear_index = 0, 0, None
    return Gif(width, height, frames)


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about PART_BYTES in the second column."""
    size = np.cumsum(pa.compute.binary_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + PART_BYTES, "right")))
        yield batch.slice(i, j - i)
        i = j


def to_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, n_bytes, media) for each row: the text's UTF-8 bytes, padded with spaces to whole rows, as a GIF.

    A null or empty text is one row of spaces. Equal texts give equal bytes (there are no ties to settle). Very long texts
    are stored whole, in as many frames as they need. A null id is kept,
    repeated rows give repeated rows, other columns are not read, an empty table gives an empty one.
    """
    small_batches(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch):
                raw = [x.encode() if x is not None else b"" for x in part.column(1).to_pylist()]
                media = [write_gif(x.ljust(max(1, -(-len(x) // WIDTH)) * WIDTH, b" ")) for x in raw]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array(media, pa.binary())], names=["id", "n_bytes", "media"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n_bytes long, media binary").withColumnRenamed("id", id_col)


_FRAME = pa.struct([("at_ms", pa.int64()), ("delay_ms", pa.int64()), ("left", pa.int32()), ("top", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("histogram", pa.list_(pa.int32()))])


def media_columns(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """(``id_col``, width, height, frames, payload) of stored GIFs; all but the id are null where the media are null or no GIF.

    ``frames`` are timed, with the histogram of the canvas shown; ``payload`` holds all frames' samples as stored.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch):
                got: list[Gif | None] = []
                for x in part.column(1).to_pylist():
                    try:
                        got.append(read_gif(x) if x is not None else None)
                    except (ValueError, IndexError, struct.error):
                        got.append(None)
                frames = [g and [{"at_ms": f.at_ms, "delay_ms": f.delay_ms, "left": f.left, "top": f.top, "width": f.width, "height": f.height, "histogram": f.histogram} for f in g.frames] for g in got]
                columns = [pa.array([g and g.width for g in got], pa.int32()), pa.array([g and g.height for g in got], pa.int32()), pa.array(frames, pa.list_(_FRAME)), pa.array([g and b"".join(f.samples for f in g.frames) for g in got], pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["id", "width", "height", "frames", "payload"])

    frame = "struct<at_ms:long,delay_ms:long,left:int,top:int,width:int,height:int,histogram:array<int>>"
    rows = df.select(F.col(id_col).alias("id"), F.col(media_col).alias("media"))
    return rows.mapInArrow(run, f"id {kind}, width int, height int, frames array<{frame}>, payload binary").withColumnRenamed("id", id_col)


def op6_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest columns of the stored form and of what is read back from it, in one pass over documents: ``to_media`` says what becomes of odd rows."""
    stored = to_media(table(spark, sf_dir, "documents"))
    # the id travels with the stored bytes through the reader, so that no join is needed
    both = stored.select(F.struct("doc_id", "n_bytes", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256")).alias("key"), "media")
    read = media_columns(both, "key")
    total = F.aggregate("frames", F.array_repeat(F.lit(0).cast("long"), 3 * BINS), lambda a, f: F.zip_with(a, f["histogram"], lambda x, y: x + y))
    feature = F.concat_ws(";", F.concat_ws("x", "width", "height"), F.size("frames").cast("string"), F.array_join(total.cast("array<string>"), ","))
    return read.select(
        "key.doc_id", "key.n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -16)")).alias("tail_crc32"), "key.media_bytes", "key.media_sha256", feature.alias("feature"), F.size("frames").alias("n_frames"),
    )
