"""Integer vectors for exact distances: which rows count, floors, squared distances, sums by group, bounds that err to the safe side."""

from __future__ import annotations

import math
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Relative room for rounding: conversions, roots, sums and products of doubles are off by 2**-53 of their value each.
ROOM = 2.0**-50


def above(x):
    """Not below the true value of what was computed as x >= 0."""
    return x + np.abs(x) * ROOM


def below(x):
    """Not above the true value of what was computed as x."""
    return x - np.abs(x) * ROOM


def usable(vec: str, length: int | None = None) -> Column:
    """The vector is there, has ``length`` components if given, and none is null or not finite."""
    ok = F.forall(F.col(vec).cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    full = F.col(vec).isNotNull() & ok
    return full if length is None else full & (F.size(vec) == length)


def floors(column: pa.Array, scale: int, dims: int) -> np.ndarray:
    """A row of floor(scale * x) for each vector. Components whose squared distances would not fit a long raise."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    with np.errstate(over="ignore"):
        x = np.floor(np.asarray(column.flatten(), np.float64) * scale).reshape(len(column), dims)
    if x.size and np.abs(x).max() > 2.0 ** ((62 - math.log2(dims)) / 2 - 1):
        raise ValueError(f"a component times {scale} is too large: squared distances of {dims} components would not fit a long")
    return x.astype(np.int64)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances as longs, a row for each vector of x and a column for each of c."""
    if not x.size or not c.size:
        return np.zeros((len(x), len(c)), np.int64)
    most = max(int(np.abs(x).max()), int(np.abs(c).max()))
    if 4 * x.shape[1] * most * most < 1 << 53:  # whole numbers that doubles hold exactly
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return np.stack([((x - y) ** 2).sum(1) for y in c], axis=1)


def summed(group: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(groups, rows of each, componentwise sums)."""
    order = np.argsort(group, kind="stable")
    found, starts, n = np.unique(group[order], return_index=True, return_counts=True)
    return found, n, np.add.reduceat(x[order], starts, axis=0) if len(x) else np.zeros((0, *x.shape[1:]), np.int64)


def total_sums(df: DataFrame, key: str, width: int) -> dict[int, tuple[int, list[int]]]:
    """{key: (rows, sums)} of partial sums in columns ``n`` and ``sums``, in exact whole numbers; as many entries as keys."""
    whole = lambda c: F.sum(c.cast("decimal(38,0)"))
    got = df.groupBy(key).agg(whole(F.col("n")).alias("n"), F.array(*[whole(F.get("sums", F.lit(i))) for i in range(width)]).alias("sums"))
    return {r[key]: (int(r["n"]), [int(s) for s in r["sums"] if s is not None]) for r in got.collect()}
