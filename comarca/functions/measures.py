"""Rates and logarithmic axis values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def per_thousand(n: Column, population: Column) -> Column:
    """``n`` per 1000 inhabitants; NULL where nobody lives."""
    return F.when(population > 0, n.cast("double") * 1000 / population)


def log10_safe(x: Column) -> Column:
    """Base-10 logarithm; NULL for zero and below, which a log axis cannot show."""
    return F.log10(F.when(x > 0, x))
