"""Normal and Student-t probabilities for the handful of rows an experiment produces.

Spark SQL has no error function or t distribution.  The aggregation that feeds these is done by
Spark; only its result, one row per group and metric, passes through here.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_NORMAL = NormalDist()
# The series of log gamma(a + 1/2) - log gamma(a) - log(a) / 2 in 1 / a, and the
# argument from which on its last term is below the precision of a double.
_HALF_STEP = ((1, -1 / 8), (3, 1 / 192), (5, -1 / 640), (7, 17 / 14336), (9, -31 / 18432))
_SERIES_FROM = 40.0
# Nodes of the trapezoidal sum; beyond them the terms vanish.
_STEP = 1 / 32
_NODES = [k * _STEP for k in range(-140, 141)]


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def log_gamma_half_step(a: float) -> float:
    """log gamma(a + 1/2) - log gamma(a), without the difference of two large numbers.

    The recurrence takes the argument to where the series holds.
    """
    total = 0.0
    while a < _SERIES_FROM:
        total -= math.log1p(0.5 / a)
        a += 1
    return total + 0.5 * math.log(a) + sum(c / a ** k for k, c in _HALF_STEP)


def t_two_sided(t: float, df: float) -> float:
    """Twice the tail of the density beyond ``|t|``, by one formula for all degrees of freedom.

    With v the distance from t, the density falls as ``(1 + v (2 t + v) / (df + t * t))`` to the
    power ``-(df + 1) / 2``: no difference of close numbers.  The substitution
    ``v = scale * exp(pi / 2 * sinh(u))`` makes the trapezoidal sum converge to double precision
    for tails that fall like a power as for those that fall like a Gaussian.
    """
    t = abs(t)
    base = df + t * t
    scale = 1 / math.hypot(1.0, (df + 1) * t / base)  # over which the density falls by about e
    parts = []
    for u in _NODES:
        v = scale * math.exp(math.pi / 2 * math.sinh(u))
        fall = math.exp(-(df + 1) / 2 * math.log1p(v * (2 * t + v) / base))
        parts.append(fall * v * math.cosh(u))
    area = math.fsum(parts) * math.pi / 2 * _STEP
    return min(1.0, 2 * math.exp(_log_density(t, df)) * area)


def _log_density(t: float, df: float) -> float:
    return (log_gamma_half_step(df / 2) - 0.5 * math.log(math.pi * df)
            - (df + 1) / 2 * math.log1p(t * t / df))


def t_critical(alpha: float, df: float) -> float:
    """The t with two-sided probability ``alpha``: Newton's method on the log probability."""
    t = normal_critical(alpha)
    for _ in range(200):
        p = t_two_sided(t, df)
        step = (math.log(p) - math.log(alpha)) * p / (2 * math.exp(_log_density(t, df)))
        t = max(t + step, t / 2)
        if abs(step) <= 1e-14 * t:
            return t
    return t


def normal_critical(alpha: float) -> float:
    return _NORMAL.inv_cdf(1 - alpha / 2)


def _rows(function, *columns: pd.Series) -> pd.Series:
    return pd.Series([None if any(pd.isna(v) for v in row) else function(*row)
                      for row in zip(*columns)], dtype="float64")


@F.pandas_udf(DoubleType())
def normal_p_value(z: pd.Series) -> pd.Series:
    return _rows(normal_two_sided, z)


@F.pandas_udf(DoubleType())
def t_p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    return _rows(t_two_sided, t, df)


@F.pandas_udf(DoubleType())
def t_critical_value(alpha: pd.Series, df: pd.Series) -> pd.Series:
    return _rows(t_critical, alpha, df)
