"""Box plot data: the spread of a count over the departments of each province.

Quartiles are exact. They are taken from a histogram (province, value, number of
departments), not from the departments: equal values are merged before they meet,
so a province with a third of all departments costs as many rows as it has
different values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUARTILES = (0.25, 0.5, 0.75)


def _histogram(counts: DataFrame, by: str, value: str) -> DataFrame:
    return counts.groupBy(by, value).agg(F.count(F.lit(1)).alias("n"))


def _quartile_array(value: str) -> Column:
    return F.percentile(value, F.array(*[F.lit(q) for q in QUARTILES]), F.col("n"))


def _fences(k: float) -> tuple[Column, Column]:
    reach = (F.col("q")[2] - F.col("q")[0]) * k
    return F.col("q")[0] - reach, F.col("q")[2] + reach


def quartiles(counts: DataFrame, by: str, value: str) -> DataFrame:
    """(by, q1, median, q3) with linear interpolation between neighbours."""
    return (
        _histogram(counts, by, value)
        .groupBy(by)
        .agg(_quartile_array(value).alias("q"))
        .select(
            by, F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3")
        )
    )


def whiskers(counts: DataFrame, by: str, value: str, k: float = 1.5) -> DataFrame:
    """(by, low, high): the extreme values not beyond ``k`` box lengths from the box."""
    low, high = _fences(k)
    return (
        _histogram(counts, by, value)
        .withColumn("q", _quartile_array(value).over(Window.partitionBy(by)))
        .where(F.col(value).between(low, high))
        .groupBy(by)
        .agg(F.min(value).alias("low"), F.max(value).alias("high"))
    )


def outliers(counts: DataFrame, by: str, value: str, k: float = 1.5) -> DataFrame:
    """Rows of ``counts`` beyond the whiskers.

    The values beyond are taken from the histogram, so the rows meet one row per
    (``by``, ``value``); a pair with many rows is split by the skew join.
    """
    low, high = _fences(k)
    beyond = (
        _histogram(counts, by, value)
        .withColumn("q", _quartile_array(value).over(Window.partitionBy(by)))
        .where((F.col(value) < low) | (F.col(value) > high))
    )
    return counts.join(beyond.select(by, value), [by, value], "left_semi").select(*counts.columns)
