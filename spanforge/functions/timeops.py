"""Column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR = 3_600_000_000
DAY = 24 * HOUR


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp with or without a zone (the session's zone is UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def floordiv(x: Column, by: int) -> Column:
    """Whole division rounded down, for negative times too."""
    return ((x - F.pmod(x, F.lit(by))) / by).cast("long")


def clean(x: Column) -> Column:
    """NaN as null, so that SQL aggregates skip it."""
    return F.when(F.isnan(x), None).otherwise(x)


def gaussian_weights(sigma: float, truncate: float = 4.0) -> list[float]:
    """Normalised kernel of radius int(truncate * sigma + 0.5) in samples."""
    from math import exp

    r = int(truncate * sigma + 0.5)
    w = [exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]
    return [x / sum(w) for x in w]
