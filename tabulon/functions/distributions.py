"""Tail probabilities of the t and F distributions, for result tables with one row per tested column."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta integral, by the modified Lentz rule."""
    tiny = 1e-300
    floor = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    c = np.ones_like(x)
    d = 1.0 / floor(1.0 - (a + b) * x / (a + 1.0))
    h = d.copy()
    for m in range(1, 500):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d = 1.0 / floor(1.0 + even * d)
        c = floor(1.0 + even / c)
        h = h * d * c
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 / floor(1.0 + odd * d)
        c = floor(1.0 + odd / c)
        step = d * c
        h = h * step
        if np.all(np.abs(step - 1.0) < 1e-15):
            break
    return h


def beta_cdf(a, b, x) -> np.ndarray:
    """Regularised incomplete beta function, element by element."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.clip(np.asarray(x, float), 0.0, 1.0))
    lgamma = np.vectorize(math.lgamma, otypes=[float])
    with np.errstate(all="ignore"):
        log_front = lgamma(a + b) - lgamma(a) - lgamma(b) + a * np.log(x) + b * np.log1p(-x)
        front = np.exp(log_front)
        low = x < (a + 1.0) / (a + b + 2.0)
        near = front * _beta_fraction(a, b, x) / a
        far = 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b
    out = np.where(low, near, far)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, out))


def f_tail(f, d1, d2) -> np.ndarray:
    """P(F > f)."""
    f, d1, d2 = np.asarray(f, float), np.asarray(d1, float), np.asarray(d2, float)
    ok = np.isfinite(f) & (d1 > 0) & (d2 > 0)
    f_, a, b = np.where(ok, np.maximum(f, 0.0), 1.0), np.where(ok, d1, 1.0), np.where(ok, d2, 1.0)
    p = beta_cdf(b / 2.0, a / 2.0, b / (b + a * f_))
    return np.where(ok, p, np.where(np.isposinf(f), 0.0, np.nan))


@F.pandas_udf(T.DoubleType())
def _f_tail_udf(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    p = f_tail(f.astype(float).to_numpy(), d1.astype(float).to_numpy(), d2.astype(float).to_numpy())
    return pd.Series(p).where(~np.isnan(p), None)


def f_p_value(f: Column, d1: Column, d2: Column) -> Column:
    return _f_tail_udf(f.cast("double"), d1.cast("double"), d2.cast("double"))


def t_p_value(t: Column, dof: Column) -> Column:
    """Two-sided p of a t statistic; t squared is an F with one numerator degree of freedom."""
    return f_p_value(t * t, F.lit(1.0), dof)
