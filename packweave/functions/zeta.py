"""Riemann zeta and the maximum-likelihood exponent of a zeta distribution."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOWEST, HIGHEST = 1.01, 10.0


def log_zeta(s: np.ndarray, terms: int = 30) -> np.ndarray:
    """ln zeta(s) for s > 1 by Euler-Maclaurin summation."""
    s = np.asarray(s, float)
    n = np.arange(1, terms)[:, None]
    head = (n ** -s.reshape(1, -1)).sum(axis=0).reshape(s.shape)
    tail = terms ** (1 - s) / (s - 1) + 0.5 * terms**-s + s * terms ** (-s - 1) / 12
    tail -= s * (s + 1) * (s + 2) * terms ** (-s - 3) / 720
    return np.log(head + tail)


def fit_exponent(n: np.ndarray, log_sum: np.ndarray, steps: int = 60) -> np.ndarray:
    """The s in [LOWEST, HIGHEST] that minimises n * ln zeta(s) + s * log_sum, by golden sections; all rows at once."""
    n, log_sum = np.asarray(n, float), np.asarray(log_sum, float)
    lo, hi = np.full(n.shape, LOWEST), np.full(n.shape, HIGHEST)
    g = (5**0.5 - 1) / 2
    cost = lambda s: n * log_zeta(s) + s * log_sum
    for _ in range(steps):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        left = cost(a) < cost(b)
        hi, lo = np.where(left, b, hi), np.where(left, lo, a)
    return (lo + hi) / 2


@F.pandas_udf(T.DoubleType())
def zipf_exponent(n: pd.Series, log_sum: pd.Series) -> pd.Series:
    return pd.Series(fit_exponent(n.to_numpy(), log_sum.to_numpy()))


def grid(points: int = 900, step: float = 0.01) -> tuple[np.ndarray, np.ndarray]:
    """Grid exponents and the values of log_sum / n between which each is the best: the cost of neighbours is equal
    at the slope of ln zeta between them, which falls with s."""
    s = np.round(LOWEST + step * np.arange(points), 6)
    z = log_zeta(s)
    return s, -np.diff(z) / np.diff(s)


@F.pandas_udf(T.DoubleType())
def zipf_grid_exponent(n: pd.Series, log_sum: pd.Series) -> pd.Series:
    """The best exponent on the grid, by binary search among the slopes."""
    s, slopes = grid()
    return pd.Series(s[np.searchsorted(-slopes, -(log_sum / n).to_numpy(), side="left")])
