"""Training steps over tables: batches, gradient clipping, AdamW, and models run inside Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import nn
from ..functions import tensors as X
from .bpe_codec import Encoder, Tokenizer

#: Places that go through a model at once; places of texts whose tiles are scored together; rows of a batch that is given back.
PLACES, HELD, ROWS = 1024, 1 << 22, 1 << 16


def get_batch(tokens: np.ndarray, batch: int, context: int, seed: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(x, y) of shape (batch, context): starts are uniform over the ``len - context`` places that leave y whole."""
    if len(tokens) <= context:
        raise ValueError("the data are no longer than the context")
    at = np.random.default_rng(seed).integers(0, len(tokens) - context, batch)[:, None] + np.arange(context)
    return tokens[at], tokens[at + 1]


def sample_windows(sequences: DataFrame, n: int, context: int, seed: int = 0, tokens_col: str = "tokens") -> DataFrame:
    """About ``n`` random windows (x, y) of token arrays, each place as likely as any other; lazy and distributed."""
    every = sequences.select(F.explode(X.windows(F.col(tokens_col), context)).alias("w")).select("w.x", "w.y")
    total = sequences.agg(F.sum(F.greatest(F.size(tokens_col) - context, F.lit(0)).cast("long")).alias("n")).first()["n"] or 0
    return every.sample(False, min(1.0, n / total), seed) if total else every


def start_counts(windows: DataFrame, starts: int, start_col: str = "start") -> DataFrame:
    """(start, n, expected, is_fair) of windows drawn from ``starts`` places: how often each was drawn, how often it would be
    if all were as likely, and whether that is within five standard deviations. Places never drawn have 0."""
    total = windows.agg(F.count("*").alias("total"))
    every = windows.sparkSession.range(starts).select(F.col("id").alias("start"))
    n = windows.groupBy(F.col(start_col).cast("long").alias("start")).agg(F.count("*").alias("n"))
    out = every.join(n, "start", "left").join(F.broadcast(total)).withColumn("n", F.coalesce("n", F.lit(0)))  # one row is broadcast
    out = out.withColumn("expected", F.col("total") / starts)
    return out.select("start", "n", "expected", (F.abs(F.col("n") - F.col("expected")) <= 5 * F.sqrt(F.col("expected") * (1 - 1 / starts))).alias("is_fair"))


def clip_gradients(grads: DataFrame, limit: float, key: str = "name", col: str = "grad") -> DataFrame:
    """Gradients scaled so that their common L2 norm is ``limit`` at most; a null gradient stays null and does not count."""
    norm = grads.agg(F.sqrt(F.sum(F.coalesce(X.dot(F.col(col), F.col(col)), F.lit(0.0)))).alias("_norm"))
    scale = F.least(F.lit(1.0), limit / (F.col("_norm") + 1e-6))
    return grads.join(F.broadcast(norm)).select(key, F.transform(col, lambda g: g * scale).alias(col))  # one row is broadcast


def adamw_step(state: DataFrame, lr: float = 1e-3, decay: float = 0.01) -> DataFrame:
    """One step over rows (key columns, p, g, m, v, t): t counts from 0 before the step."""
    t = F.col("t") + 1
    p, m, v = X.adamw(F.col("p"), F.col("g"), F.col("m"), F.col("v"), t, lr=lr, decay=decay)
    return state.select(*(c for c in state.columns if c not in ("p", "g", "m", "v", "t")), p.alias("p"), m.alias("m"), v.alias("v"), t.alias("t"))


def embedding_gradient(ids: DataFrame, vocabulary: int) -> DataFrame:
    """(token_id, grad) for the sum of all gathered rows: how often each row was gathered; rows never gathered have 0."""
    spark = ids.sparkSession
    n = ids.groupBy("token_id").agg(F.count("*").cast("double").alias("grad"))
    every = spark.range(vocabulary).select(F.col("id").cast("int").alias("token_id"))
    return every.join(n, "token_id", "left").select("token_id", F.coalesce("grad", F.lit(0.0)).alias("grad"))


def self_attention(sequences: DataFrame, weights: dict[str, np.ndarray], heads: int, rotate: bool, theta: float = 10000.0) -> DataFrame:
    """(seq, x) with x ARRAY<ARRAY<DOUBLE>>, one row a sequence, through causal multi-head attention."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column(1)
            flat = col.flatten().flatten().to_numpy()
            places = pc.list_value_length(col).fill_null(0).to_numpy()
            d = len(weights["q"][0])
            at = np.cumsum(places) - places
            out = np.empty((int(places.sum()), len(weights["o"])))
            for n in np.unique(places[places > 0]).tolist():  # sequences of a length go through together
                same = np.flatnonzero(places == n)
                rows = at[same][:, None] + np.arange(n)
                x = flat.reshape(-1, d)[rows]
                out[rows] = nn.multihead(x, *(weights[k] for k in ("q", "k", "v", "o")), heads, np.arange(n) if rotate else None, theta)
            inner = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * out.shape[1], pa.int32()), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(np.append(at, len(out)), pa.int32()), inner)], names=["seq", "x"])

    return sequences.select("seq", "x").mapInArrow(run, "seq long, x array<array<double>>")


def _scored(model: nn.LanguageModel, of: pa.Array, tokens: np.ndarray, start: np.ndarray, size: np.ndarray, context: int | None, name: str) -> Iterator[pa.RecordBatch]:
    """(``name``, pos, best_id, best_logit, loss) of sequences ``tokens[start : start + size]``, one for each row of ``of``; those of a length go through the model together."""
    for n in np.unique(size[size > 0]).tolist():
        same = np.flatnonzero(size == n)
        places = min(n, context or n)
        step, known = max(1, PLACES // places), min(places, n - 1)  # places with a next token
        for some in (same[i : i + step] for i in range(0, len(same), step)):
            ids = tokens[start[some][:, None] + np.arange(n)]
            targets = np.zeros((len(some), places), ids.dtype)
            targets[:, :known] = ids[:, 1 : known + 1]
            best, top, loss = model(ids[:, :places], targets)
            unknown = np.tile(np.arange(places) >= known, len(some))
            cols = (np.tile(np.arange(places, dtype=np.int32), len(some)), best, top)
            yield pa.RecordBatch.from_arrays([of.take(pa.array(np.repeat(some, places))), *map(pa.array, cols), pa.array(loss, pa.float64(), mask=unknown)], names=[name, "pos", "best_id", "best_logit", "loss"])


def logits(sequences: DataFrame, weights: dict[str, np.ndarray], layers: int, heads: int, theta: float = 10000.0, context: int | None = None) -> DataFrame:
    """(seq, tokens) to (seq, pos, best_id, best_logit, loss): the model's choice and next-token loss at each place. ``seq`` has any type.

    With ``context``, tokens beyond so many are not places: the first of them is only the target of the last place.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = nn.LanguageModel(weights, layers, heads, theta)
        for b in batches:
            flat = b.column(1).flatten().to_numpy()
            size = pc.list_value_length(b.column(1)).fill_null(0).to_numpy()
            yield from _scored(model, b.column(0), flat, np.cumsum(size) - size, size, context, "seq")

    kind = sequences.schema["seq"].dataType.simpleString()
    return sequences.select("seq", "tokens").mapInArrow(run, f"seq {kind}, pos int, best_id int, best_logit double, loss double")


def _held(encode: Encoder, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    """Ids of texts and their tokens, of about HELD places."""
    of, held, places = [], [], 0
    for b in batches:
        for i, ids in encode.some(b.column(1)):
            of.append(b.column(0).slice(i, len(ids)))
            held += (np.zeros(0, np.int32) if x is None else x for x in ids)
            places += sum(len(x) for x in ids if x is not None)
            if places >= HELD:
                yield pa.concat_arrays(of), held
                of, held, places = [], [], 0
    if places:
        yield pa.concat_arrays(of), held


def _tiled(model: nn.LanguageModel, texts: list[np.ndarray], context: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Lengths of texts, and what the model gives for each place of the tiles of all of them."""
    length = np.array([len(x) for x in texts], np.int64)
    rest = np.zeros(context, np.int32)  # a text's last tile is filled up; what stands behind a place does not change it
    tiles = np.concatenate([x for ids in texts for x in (ids, rest[: -len(ids) % context])]).reshape(-1, context)
    return length, [x.ravel() for x in model.tiles(tiles, np.append(tiles[1:, 0], 0))]


def _placed(of: pa.Array, length: np.ndarray, found: list[np.ndarray], context: int) -> Iterator[pa.RecordBatch]:
    """(id, at, pos, best_id, best_logit, loss) of the tiles of texts, in their order; ``of`` has the texts' ids."""
    begin, first = (np.cumsum(x) - x for x in (length, length + -length % context))
    text = np.repeat(np.arange(len(of), dtype=np.int32), length)
    for i in range(0, len(text), ROWS):
        row = text[i : i + ROWS]
        place = np.arange(i, i + len(row)) - begin[row]
        pos = (place % context).astype(np.int32)
        best, top, loss = (x[first[row] + place] for x in found)
        cols = (place.astype(np.int32) - pos, pos, best, top)
        yield pa.RecordBatch.from_arrays([of.take(pa.array(row)), *map(pa.array, cols), pa.array(loss, mask=place == length[row] - 1)], names=["id", "at", "pos", "best_id", "best_logit", "loss"])


def tiled_logits(docs: DataFrame, tok: Tokenizer, weights: dict[str, np.ndarray], layers: int, heads: int, context: int, id_col: str = "doc_id", text_col: str = "text", theta: float = 10000.0) -> DataFrame:
    """(``id_col``, at, pos, best_id, best_logit, loss): ``logits`` of the sequences of ``context`` tokens, beginning at ``at``, that tile each text.

    Texts are encoded, cut and scored inside of Arrow batches, so that no token goes to the JVM and back. A null or empty text has no places.
    Of about HELD places at a time, what tiles begin with alike is computed once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = nn.LanguageModel(weights, layers, heads, theta)
        for of, texts in _held(Encoder(tok), batches):
            yield from _placed(of, *_tiled(model, texts, context), context)

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, at int, pos int, best_id int, best_logit double, loss double").withColumnRenamed("id", id_col)
