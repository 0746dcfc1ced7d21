"""Keys of space-filling curves, for sorted layouts by two columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

BITS = 16


def scaled(c: Column, low: float, high: float, bits: int = BITS) -> Column:
    """``c`` from [low, high] onto whole numbers below 2**bits; what lies outside goes to the nearer end, null to 0."""
    top = (1 << bits) - 1
    x = F.floor((c - F.lit(float(low))) / F.lit(float(high - low)) * F.lit(top))
    return F.coalesce(F.greatest(F.least(x, F.lit(top)), F.lit(0)), F.lit(0)).cast("long")


def zorder_key(x: Column, y: Column, bits: int = BITS) -> Column:
    """Interleaved bits of two whole numbers below 2**bits; stays in generated code."""
    out = F.lit(0).cast("long")
    for i in range(bits):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(x, i).bitwiseAND(F.lit(1)).cast("long"), 2 * i))
        out = out.bitwiseOR(F.shiftleft(F.shiftright(y, i).bitwiseAND(F.lit(1)).cast("long"), 2 * i + 1))
    return out


def hilbert_index(x: np.ndarray, y: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position along the Hilbert curve of order ``bits`` of points with whole coordinates below 2**bits."""
    x, y = x.astype(np.int64).copy(), y.astype(np.int64).copy()
    d = np.zeros(len(x), np.int64)
    for level in range(bits - 1, -1, -1):
        half = np.int64(1) << level
        right, up = (x & half) > 0, (y & half) > 0
        d += half * half * np.where(right, np.where(up, 2, 3), np.where(up, 1, 0))
        flip = ~up & right  # the lower quadrants are turned, the right one also mirrored
        x, y = np.where(flip, half - 1 - (x & (half - 1)), x & (half - 1)), np.where(flip, half - 1 - (y & (half - 1)), y & (half - 1))
        x, y = np.where(~up, y, x), np.where(~up, x, y)
    return d


@F.pandas_udf(T.LongType())
def hilbert_key(x: pd.Series, y: pd.Series) -> pd.Series:
    """Arrow-batched :func:`hilbert_index` of 16 bits; null counts as 0."""
    return pd.Series(hilbert_index(x.fillna(0).to_numpy(), y.fillna(0).to_numpy()))
