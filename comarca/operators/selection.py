"""Exact quantiles of real values, where a group is too large for one task and hardly any value repeats.

``distribution`` takes quartiles from a histogram, which is small for counts. Rates have about as many values as
departments. Here the values are range partitioned, the ranks at which each range begins come from the
ranges' sizes, and only ranges that hold a wanted rank are looked into. No task sees more of a
group than one range of it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from comarca.operators.distribution import QUARTILES
from comarca.sources import store, work_folder


def _wanted(quantiles: Sequence[float], total: Column) -> Column:
    """For each quantile the one or two ranks (from 0) it lies between, and their shares."""
    ranks = []
    for i, q in enumerate(quantiles):
        place = F.lit(float(q)) * (total - 1)
        low, share = F.floor(place), place - F.floor(place)
        ranks.append(F.struct(F.lit(i).alias("i"), low.alias("rank"), (1 - share).alias("share")))
        ranks.append(F.struct(F.lit(i).alias("i"), (low + 1).alias("rank"), share.alias("share")))
    return F.filter(F.array(*ranks), lambda r: r["share"] > 0)


def group_quantiles(df: DataFrame, by: str, value: str, quantiles: Sequence[float] = QUARTILES) -> DataFrame:
    """(by, q): for every group an array of its quantiles, with linear interpolation between neighbours.

    NULL values count for nothing; a group that has no other does not come back. A NULL group is
    a group. NaN is greater than all numbers. The ranges are written to the work folder, so that
    their numbers and what they hold cannot part ways when a task is repeated.
    """
    spark = df.sparkSession
    group, x = F.col(by).alias("_by"), F.col(value).cast("double").alias("_x")
    merged = df.select(group, x).where("_x is not null").groupBy("_by", "_x").agg(F.count(F.lit(1)).alias("_n"))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = merged.repartitionByRange(ranges, "_by", "_x").withColumn("_range", F.spark_partition_id())
    placed = store(ranged, work_folder(spark), "ranges")

    # One row per group and range it reaches into.
    sizes = placed.groupBy("_by", "_range").agg(F.sum("_n").alias("_held"))
    whole = Window.partitionBy("_by")
    before = F.sum("_held").over(whole.orderBy("_range")) - F.col("_held")
    sizes = sizes.withColumns({"_before": before, "_total": F.sum("_held").over(whole)})
    held_here = F.filter(
        _wanted(quantiles, F.col("_total")),
        lambda r: (r["rank"] >= F.col("_before")) & (r["rank"] < F.col("_before") + F.col("_held")),
    )
    wanted = sizes.select(F.col("_by").alias("_g"), F.col("_range").alias("_r"), "_before", held_here.alias("_wanted"))
    wanted = wanted.where(F.size("_wanted") > 0)

    looked = placed.join(wanted, F.col("_by").eqNullSafe(F.col("_g")) & (F.col("_range") == F.col("_r")))
    upto = F.col("_before") + F.sum("_n").over(Window.partitionBy("_by", "_range").orderBy("_x"))
    hit = F.filter("_wanted", lambda r: (r["rank"] < F.col("_upto")) & (r["rank"] >= F.col("_upto") - F.col("_n")))
    found = looked.withColumn("_upto", upto).select("_by", "_x", F.explode(hit).alias("_hit"))
    parts = [
        F.sum(F.when(F.col("_hit.i") == i, F.col("_x") * F.col("_hit.share"))) for i in range(len(quantiles))
    ]
    return found.groupBy(F.col("_by").alias(by)).agg(F.array(*parts).alias("q"))


def value_quartiles(df: DataFrame, by: str, value: str) -> DataFrame:
    """(by, q1, median, q3) of real values."""
    q = group_quantiles(df, by, value)
    return q.select(by, *[F.col("q")[i].alias(name) for i, name in enumerate(("q1", "median", "q3"))])


def _with_fences(df: DataFrame, by: str, value: str, k: float) -> DataFrame:
    """Rows with a value, next to the limits of their group. Ends are named so as not to meet the rows' own."""
    q1, q3 = F.col("q")[0], F.col("q")[2]
    fences = group_quantiles(df, by, value).select(
        F.col(by).alias("_g"), (q1 - (q3 - q1) * k).alias("_low"), (q3 + (q3 - q1) * k).alias("_high")
    )
    return df.where(F.col(value).isNotNull()).join(fences, F.col(by).eqNullSafe(F.col("_g")))


def value_whiskers(df: DataFrame, by: str, value: str, k: float = 1.5) -> DataFrame:
    """(by, low, high): the extreme values not beyond ``k`` box lengths from the box."""
    inside = _with_fences(df, by, value, k).where(F.col(value).between(F.col("_low"), F.col("_high")))
    return inside.groupBy(by).agg(F.min(value).alias("low"), F.max(value).alias("high"))


def value_outliers(df: DataFrame, by: str, value: str, k: float = 1.5) -> DataFrame:
    """Rows of ``df`` beyond the whiskers; one row per group meets them, a large group is split by the skew join."""
    beyond = (F.col(value) < F.col("_low")) | (F.col(value) > F.col("_high"))
    return _with_fences(df, by, value, k).where(beyond).select(*df.columns)
