"""Bounded samples of labelled rows, on which classifiers are fitted in the driver."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values of the hash that rows are drawn by.
SPOTS = 1 << 62


def share(rows: int, per_label: int) -> int:
    """Spots below which a row of a label of so many rows is drawn: about ``per_label`` rows, at any number of rows."""
    return SPOTS if rows <= per_label else SPOTS * per_label // rows


def bounded(df: DataFrame, label: str, per_label: int, order: Column) -> tuple[DataFrame, dict]:
    """About ``per_label`` rows (all, of a rarer label) of each value of ``label``, chosen by a hash of ``order``: the same rows on every run.

    Beside them, how many rows of the table one drawn row of each label stands for. The number of rows drawn is
    binomial around ``per_label``, and so bounded whatever the table's size; nothing else decides on a row.
    """
    n = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count("*").alias("n")).collect()}
    if not n:
        return df.limit(0), {}
    spot = F.pmod(F.xxhash64(order, F.lit("fit")), F.lit(SPOTS))
    shares = F.create_map(*(x for k, c in n.items() for x in (F.lit(k), F.lit(share(c, per_label)).cast("long"))))
    drawn = df.filter(spot < shares[F.col(label)])
    got = {r[label]: r["n"] for r in drawn.groupBy(label).agg(F.count("*").alias("n")).collect()}
    return drawn, {k: n[k] / c for k, c in got.items()}


def give_back() -> None:
    """Hands memory that a fit has freed back to the system, which the driver's process would keep otherwise."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library has no such call
        pass


def inverse_rates(labels: Iterable[int], stands_for: dict[int, float] | None) -> np.ndarray:
    """For each drawn row, how many rows it stands for: a sample drawn by label is weighted back to the table's ratio."""
    return np.array([(stands_for or {}).get(int(k), 1.0) for k in labels], float)
