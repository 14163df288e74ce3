"""Student's t tail probabilities, as an Arrow-batched function over our own incomplete beta."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..shipping import ship

_LGAMMA = np.vectorize(math.lgamma, otypes=[float])


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Regularised incomplete beta I_x(a, b), by Lentz's continued fraction."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.asarray(x, float))
    flip = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(_LGAMMA(p + q) - _LGAMMA(p) - _LGAMMA(q) + p * np.log(z) + q * np.log1p(-z)) / p
    tiny = 1e-300
    c, d = np.ones_like(z), 1 - (p + q) * z / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    total = d.copy()
    for m in range(1, rounds):
        for step in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + step * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + step / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            total = total * d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    found = np.where((z <= 0), 0.0, front * total)
    return np.where(flip, 1 - found, found)


def two_sided_p(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(|T| >= |t|) under df degrees of freedom; NaN where t or df is undefined or df <= 0; 0 for infinite t."""
    t, df = np.broadcast_arrays(np.asarray(t, float), np.asarray(df, float))
    found = np.full(t.shape, np.nan)
    fine = ~np.isnan(t) & (df > 0)
    finite = fine & np.isfinite(t)
    found[fine & ~np.isfinite(t)] = 0.0
    if finite.any():
        own_t, own_df = t[finite], df[finite]
        found[finite] = incomplete_beta(own_df / 2, np.full_like(own_df, 0.5), own_df / (own_df + own_t * own_t))
    return found


def p_value(t: Column, df: Column) -> Column:
    """Two-sided p of Student's t; null where undefined."""
    if session := SparkSession.getActiveSession():
        ship(session)

    @F.pandas_udf(DoubleType())
    def tail(own_t: pd.Series, own_df: pd.Series) -> pd.Series:
        p = two_sided_p(own_t.to_numpy(float, na_value=np.nan), own_df.to_numpy(float, na_value=np.nan))
        return pd.Series([None if np.isnan(x) else x for x in p], dtype="object")

    return tail(t.cast("double"), df.cast("double"))
