"""Column functions over ARRAY<DOUBLE> rows: the numeric parts of language-model training."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(x: Column) -> Column:
    return x.cast("array<double>")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, also where a lambda of ``use`` reads it for every element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def dot(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: a * b))


def matrix(rows: Sequence[Sequence[float]]) -> Column:
    """A literal ARRAY<ARRAY<DOUBLE>>; weights of any size come as a broadcast row instead."""
    return F.array(*(F.array(*(F.lit(float(v)) for v in r)) for r in rows))


def linear(x: Column, weights: Column) -> Column:
    """y = x W^T; ``weights`` has a row for each output."""
    return F.transform(weights, lambda w: dot(w, x))


def silu(x: Column) -> Column:
    return F.transform(x, lambda v: v / (F.lit(1.0) + F.exp(-v)))


def swiglu(x: Column, w1: Column, w2: Column, w3: Column) -> Column:
    """W2(SiLU(W1 x) * W3 x)"""
    return linear(F.zip_with(silu(linear(x, w1)), linear(x, w3), lambda a, b: a * b), w2)


def rmsnorm(x: Column, gain: Column, eps: float = 1e-5) -> Column:
    return let(F.sqrt(dot(x, x) / F.size(x) + eps), lambda root: F.zip_with(x, gain, lambda v, g: v / root * g))


def softmax(x: Column) -> Column:
    e = let(F.array_max(x), lambda top: F.transform(x, lambda v: F.exp(v - top)))
    return let(e, lambda e: let(total(e), lambda norm: F.transform(e, lambda v: v / norm)))


def logsumexp(x: Column) -> Column:
    return let(F.array_max(x), lambda top: top + F.log(total(F.transform(x, lambda v: F.exp(v - top)))))


def cross_entropy(logits: Column, target: Column) -> Column:
    """-log softmax(logits)[target], target from 0; the loss of a batch is its mean."""
    return logsumexp(logits) - F.element_at(logits, target.cast("int") + 1)


def attention(q: Column, keys: Column, values: Column, mask: Column | None = None) -> Column:
    """softmax(q K^T / sqrt(d)) V for one query; ``mask`` holds True where a key may be seen.

    A query that may see no key gives zeros.
    """
    scaled = F.transform(keys, lambda k: dot(q, k) / F.sqrt(F.size(q)))
    if mask is not None:
        scaled = F.zip_with(scaled, mask, lambda s, m: F.when(m, s).otherwise(F.lit(float("-inf"))))
    unseen = F.lit(float("-inf"))
    e = let(scaled, lambda scaled: let(F.array_max(scaled), lambda top: F.transform(scaled, lambda s: F.when(s == unseen, 0.0).otherwise(F.exp(s - top)))))
    weights = let(e, lambda e: let(total(e), lambda norm: F.transform(e, lambda w: F.when(norm > 0, w / norm).otherwise(0.0))))
    zero = F.transform(F.element_at(values, 1), lambda _: F.lit(0.0))
    return F.aggregate(F.zip_with(weights, values, lambda w, v: F.transform(v, lambda c: c * w)), zero, lambda a, v: F.zip_with(a, v, lambda x, y: x + y))


def rope(x: Column, position: Column, theta: float = 10000.0) -> Column:
    """Rotates each pair (2i, 2i+1) by position / theta^(2i/d). Interleaved pairs, as in the paper."""

    def turn(v: Column, i: Column) -> Column:
        pair = F.floor(i / 2)
        angle = position / F.pow(F.lit(theta), 2 * pair / F.size(x))
        other = F.get(x, F.when(i % 2 == 0, i + 1).otherwise(i - 1))
        return F.when(i % 2 == 0, v * F.cos(angle) - other * F.sin(angle)).otherwise(other * F.sin(angle) + v * F.cos(angle))

    return F.transform(x, turn)


def windows(tokens: Column, context: int) -> Column:
    """ARRAY<STRUCT<x, y>> of all training windows of a token sequence: y is x one place further."""
    n = F.size(tokens) - context
    every = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.struct(F.slice(tokens, i, context).alias("x"), F.slice(tokens, i + 1, context).alias("y")))
    return F.slice(every, F.lit(1), F.greatest(n, F.lit(0)))


def split_heads(x: Column, heads: int) -> Column:
    """ARRAY<ARRAY<DOUBLE>>: consecutive slices of a row, one for each head."""
    size = F.floor(F.size(x) / heads).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(heads - 1)), lambda h: F.slice(x, h * size + 1, size))


def cosine_schedule(t: Column, top: float, low: float, warmup: int, cycle: int) -> Column:
    """Linear warm-up to ``top``, a cosine down to ``low``, then ``low``."""
    down = low + 0.5 * (1 + F.cos((t - warmup) / float(cycle - warmup) * math.pi)) * (top - low) if cycle > warmup else F.lit(low)
    return F.when(t < warmup, t * (top / warmup) if warmup else F.lit(top)).when(t <= cycle, down).otherwise(F.lit(low))


def adamw(p: Column, g: Column, m: Column, v: Column, t: Column, lr: float = 1e-3, beta1: float = 0.9, beta2: float = 0.999, eps: float = 1e-8, decay: float = 0.01) -> tuple[Column, Column, Column]:
    """(parameter, m, v) after step t, counted from 1."""
    m1, v1 = beta1 * m + (1 - beta1) * g, beta2 * v + (1 - beta2) * g * g
    step = lr * (m1 / (1 - F.pow(F.lit(beta1), t))) / (F.sqrt(v1 / (1 - F.pow(F.lit(beta2), t))) + eps)
    return p * (1 - lr * decay) - step, m1, v1
