"""Age classes and other stratum expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Class limits of the named presets, lower limit inclusive.
AGE_PRESETS = {
    "SI-PNI": (0, 5, 12, 18, 30, 40, 50, 60, 70, 80, 90, 130),
    "10 years": (*range(0, 91, 10), 130),
    "5 years": (*range(0, 91, 5), 130),
}

# Limits and labels of the bracket column of the prepared extract.
EXTRACT_LIMITS = (0, 5, 12, 18, 30, 50, 60, 70, 80, 200)
EXTRACT_LABELS = (
    "0 - 4", "5 - 11", "12 - 17", "18 - 29", "30 - 49", "50 - 59", "60 - 69", "70 - 79", "80 +",
)

# Labels of the totals table, class 99 first.
TOTAL_LABELS = {
    99: "Total", 1: "0 - 9", 2: "10 - 19", 3: "20 - 29", 4: "30 - 39", 5: "40 - 49",
    6: "50 - 59", 7: "60 - 69", 8: "70 - 79", 9: "80+",
}

# Fixed value: unit code saying that an age is given in years; larger codes are unusable.
AGE_UNIT_YEARS = 3


def age_limits(bins: str | Sequence[float] | None) -> tuple[float, ...]:
    if bins is None:
        return AGE_PRESETS["SI-PNI"]
    if isinstance(bins, str):
        if bins not in AGE_PRESETS:
            raise ValueError(f"unknown age bins {bins!r}; use {sorted(AGE_PRESETS)} or numbers")
        return AGE_PRESETS[bins]
    limits = tuple(sorted(bins))
    if len(limits) < 2:
        raise ValueError("age bins need at least two limits")
    return limits


def interval_code(value: Column, limits: Sequence[float]) -> Column:
    """1-based index of the half-open interval holding ``value``; NULL outside all of them."""
    code = F.when(value < limits[0], F.lit(None).cast("int"))
    for i, upper in enumerate(limits[1:], start=1):
        code = code.when(value < upper, F.lit(i))
    return code


def interval_label(value: Column, limits: Sequence[float], labels: Sequence[str]) -> Column:
    code = interval_code(value, limits)
    return F.element_at(F.array(*[F.lit(x) for x in labels]), code)


def age_label(code: Column, bins: str | Sequence[float] | None) -> Column:
    """``0 - 4`` style label of an age class; the last class is open."""
    limits = age_limits(bins)
    names = [f"{lo:g} - {hi - 1:g}" for lo, hi in zip(limits, limits[1:-1])]
    names.append(f"{limits[-2]:g}+")
    return F.element_at(F.array(*[F.lit(x) for x in names]), code)


def age_in_years(number: Column, unit: Column) -> Column:
    return F.when(unit == AGE_UNIT_YEARS, number).otherwise(0)


def age_class_digit(age_class: Column) -> Column:
    """``age_3`` -> ``3``."""
    return F.substring(age_class, 5, 1)


def total_label(code: Column) -> Column:
    label = None
    for value, name in TOTAL_LABELS.items():
        test = code == value
        label = F.when(test, name) if label is None else label.when(test, name)
    return label
