"""Quantiles, rounding, regression limits."""

from __future__ import annotations

import math
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Column name -> probability.
LIMITS = {"Median": 0.5, "LI": 0.025, "LS": 0.975, "LIb": 0.25, "LSb": 0.75}
REPORT_LIMITS = {
    "Median": 0.5, "Q1": 0.25, "Q3": 0.75, "IC80I": 0.1, "IC80S": 0.9,
    "IC90I": 0.05, "IC90S": 0.95, "LI": 0.025, "LS": 0.975,
}
TREND_LIMITS = {"LI": 0.05, "Q1": 0.25, "Q3": 0.75, "LS": 0.95}

T_TABLE_SIZE = 120


def quantiles(value: Column, probabilities: dict[str, float]) -> Column:
    """One array aggregate for all probabilities: exact, linear between order statistics."""
    return F.percentile(value, [float(p) for p in probabilities.values()])


def named(array: Column, probabilities: dict[str, float]) -> list[Column]:
    return [array[i].alias(name) for i, name in enumerate(probabilities)]


def half_even(value: Column) -> Column:
    return F.bround(value)


def _t_cdf_two_sided(t: float, df: int) -> float:
    """P(|T| <= t), by the finite trigonometric sums that hold for whole degrees of freedom."""
    angle = math.atan(t / math.sqrt(df))
    sin, cos = math.sin(angle), math.cos(angle)
    term = total = cos if df % 2 else 1.0
    for k in range(2 if df % 2 else 1, df - 1, 2):
        term *= cos * cos * k / (k + 1)
        total += term
    if df == 1:
        return 2 * angle / math.pi
    if df % 2:
        return 2 / math.pi * (angle + sin * total)
    return sin * total


def t_quantile(level: float, df: int) -> float:
    """Half width, in standard errors, of the central ``level`` interval."""
    low, high = 0.0, 1.0
    while _t_cdf_two_sided(high, df) < level:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        if _t_cdf_two_sided(mid, df) < level:
            low = mid
        else:
            high = mid
    return (low + high) / 2


@lru_cache
def _t_table(level: float) -> str:
    widths = (f"{t_quantile(level, k)!r}D" for k in range(1, T_TABLE_SIZE + 1))
    return f"array({', '.join(widths)})"


def t_half_width(level: float, df: Column) -> Column:
    """Student t half width; beyond the table the usual expansion about the normal value."""
    table = F.expr(_t_table(level))
    z = _normal_half_width(level)
    large = F.greatest(df, F.lit(T_TABLE_SIZE))
    expanded = (
        z
        + (z**3 + z) / 4 / large
        + (5 * z**5 + 16 * z**3 + 3 * z) / 96 / large**2
        + (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384 / large**3
    )
    return F.when((df >= 1) & (df <= T_TABLE_SIZE), F.get(table, (df - 1).cast("int"))).when(
        df > T_TABLE_SIZE, expanded
    )


@lru_cache
def _normal_half_width(level: float) -> float:
    low, high = 0.0, 10.0
    for _ in range(200):
        mid = (low + high) / 2
        if math.erf(mid / math.sqrt(2)) < level:
            low = mid
        else:
            high = mid
    return (low + high) / 2


def trend_score(lower: Column, q1: Column, q3: Column, upper: Column) -> Column:
    """Five-level score from the 90 % and 50 % limits of a slope; NULL when a limit is just 0."""
    return (
        F.when(lower > 0, 1.0)
        .when((lower < 0) & (q1 >= 0), 0.5)
        .when((q1 < 0) & (q3 > 0), 0.0)
        .when((q3 <= 0) & (upper > 0), -0.5)
        .when(upper < 0, -1.0)
    )
