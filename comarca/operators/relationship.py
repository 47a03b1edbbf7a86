"""Do schools and libraries go together? Rates, log-log points and correlation."""

from __future__ import annotations

from math import e, factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from comarca.functions import log10_safe, per_thousand


def rates(integrated: DataFrame) -> DataFrame:
    """Schools and libraries per 1000 inhabitants of each department."""
    people = F.col("persons")
    return integrated.select(
        "dep_id",
        per_thousand(F.col("schools"), people).alias("schools_per_1000"),
        per_thousand(F.col("libraries"), people).alias("libraries_per_1000"),
    )


def log_rates(integrated: DataFrame) -> DataFrame:
    """Both rates on logarithmic axes, NULL where an axis cannot show the rate."""
    return rates(integrated).select(
        "dep_id",
        log10_safe(F.col("schools_per_1000")).alias("log_schools"),
        log10_safe(F.col("libraries_per_1000")).alias("log_libraries"),
    )


def loglog_points(integrated: DataFrame) -> DataFrame:
    """Departments that have a place on both logarithmic axes."""
    return log_rates(integrated).dropna(subset=["log_schools", "log_libraries"])


def loglog_excluded(integrated: DataFrame) -> DataFrame:
    """One row: how many departments the log-log chart shows and leaves out."""
    placed = F.col("log_schools").isNotNull() & F.col("log_libraries").isNotNull()
    return log_rates(integrated).agg(
        F.count_if(placed).alias("n_shown"), F.count_if(~placed).alias("n_excluded")
    )


def loglog_fit(points: DataFrame) -> DataFrame:
    """The straight line through the log-log points: one row (n, slope, intercept, r2).

    NULL where the points do not determine it: fewer than two rates of schools, or
    for ``r2`` of libraries.
    """
    x, y = F.col("log_schools"), F.col("log_libraries")
    varies_x, varies_y = F.min(x) < F.max(x), F.min(y) < F.max(y)
    slope = F.when(varies_x, F.covar_pop(x, y) / F.nullif(F.var_pop(x), F.lit(0.0)))
    spread = F.nullif(F.var_pop(x) * F.var_pop(y), F.lit(0.0))
    r2 = F.when(varies_x & varies_y, F.pow(F.covar_pop(x, y), 2) / spread)
    return points.agg(
        F.count(F.lit(1)).alias("n"),
        slope.alias("slope"),
        (F.avg(y) - slope * F.avg(x)).alias("intercept"),
        r2.alias("r2"),
    )


def _ranks(df: DataFrame, col: str) -> DataFrame:
    """(value, rank): mean ranks out of a histogram, so the window orders distinct values only."""
    before = Window.orderBy(col).rowsBetween(Window.unboundedPreceding, -1)
    n_before = F.coalesce(F.sum("n").over(before), F.lit(0))
    return (
        df.groupBy(col)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col(col), (n_before + (F.col("n") + 1) / 2).alias(f"rank_{col}"))
    )


def relationship_spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation of two counts, equal counts at their mean rank: one row (n, rho).

    Counts repeat, so N rows have about the square root of twice their total distinct values,
    and pairs of counts are merged before they are given their ranks.
    """
    rows = df.dropna(subset=[x, y])
    pairs = rows.groupBy(x, y).agg(F.count(F.lit(1)).alias("weight"))
    ranked = pairs.join(_ranks(rows, x), x).join(_ranks(rows, y), y)
    w, a, b = F.col("weight"), F.col(f"rank_{x}"), F.col(f"rank_{y}")
    n = F.sum(w)

    def cov(p: Column, q: Column) -> Column:
        return F.sum(w * p * q) / n - F.sum(w * p) / n * (F.sum(w * q) / n)

    varies = (F.min(a) < F.max(a)) & (F.min(b) < F.max(b))
    rho = cov(a, b) / F.nullif(F.sqrt(cov(a, a) * cov(b, b)), F.lit(0.0))
    return ranked.agg(F.coalesce(n, F.lit(0)).alias("n"), F.when(varies, rho).alias("rho"))


def relationship_corr(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson correlation over the rows that have both values: one row (n, r).

    NULL when a column is constant. ``corr`` would divide by zero there, which
    fails under ANSI; and rounding can leave a constant column with a deviation
    just above zero, so its range is what decides.
    """
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    varies = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    return df.dropna(subset=[x, y]).agg(
        F.count(F.lit(1)).alias("n"),
        F.when(varies, F.covar_pop(x, y) / F.nullif(spread, F.lit(0.0))).alias("r"),
    )


def _places(values: DataFrame, col: str) -> DataFrame:
    """(value, place from 0, number of values, rows): distinct values only are brought into order."""
    order, everything = Window.orderBy(col), Window.partitionBy()
    return (
        values.groupBy(col)
        .agg(F.sum("weight").alias(f"rows_{col}"))
        .select(
            col,
            f"rows_{col}",
            (F.row_number().over(order) - 1).cast("bigint").alias(f"at_{col}"),
            F.count(F.lit(1)).over(everything).alias(f"n_{col}"),
        )
    )


def relationship_kendall(df: DataFrame, x: str, y: str) -> DataFrame:
    """Kendall's tau-b of two counts: one row (n, tau), over the rows that have both values.

    NULL when a column is constant or there are fewer than two rows.

    Pairs that agree are counted as a merge sort would count them. Two places in x differ first in one bit, so
    they meet in one run of places that agree above this bit; there, in the order of y, each row with the bit
    set agrees with all rows below it that do not have it. Sums per stretch of y come first and give each
    stretch its offset, so that the run of the highest bit, which holds all values, is no single task.
    """
    rows = df.select(F.col(x).alias("x"), F.col(y).alias("y")).dropna()
    cells = rows.groupBy("x", "y").agg(F.count(F.lit(1)).alias("weight"))
    of_x, of_y = _places(cells, "x"), _places(cells, "y")
    stretch = F.floor(F.col("at_y") / F.ceil(F.sqrt("n_y")))
    bits = F.explode(F.sequence(F.lit(0), F.length(F.bin("n_x")) - 1))
    met = (
        cells.join(of_x, "x")
        .join(of_y, "y")
        .select("at_x", "at_y", "weight", stretch.alias("stretch"), bits.alias("bit"))
        .withColumn("run", F.expr("shiftright(at_x, bit + 1)"))
        .withColumn("is_set", F.expr("shiftright(at_x, bit) & 1") == 1)
    )
    run = ["bit", "run", "stretch"]
    sums = met.groupBy(*run, "at_y").agg(
        F.sum(F.when(~F.col("is_set"), F.col("weight")).otherwise(0)).alias("low"),
        F.sum(F.when(F.col("is_set"), F.col("weight")).otherwise(0)).alias("high"),
    )
    earlier = Window.unboundedPreceding, -1
    inside = Window.partitionBy(*run).orderBy("at_y").rowsBetween(*earlier)
    before = Window.partitionBy("bit", "run").orderBy("stretch").rowsBetween(*earlier)
    offsets = (
        sums.groupBy(*run)
        .agg(F.sum("low").alias("low"))
        .select(*run, F.coalesce(F.sum("low").over(before), F.lit(0)).alias("offset"))
    )
    below = F.coalesce(F.sum("low").over(inside), F.lit(0))
    agreeing = sums.withColumn("below", below).join(offsets, run)

    def exact(c: Column) -> Column:
        return c.cast("decimal(19,0)")

    def pairs(c: Column) -> Column:
        return F.sum(exact(c) * exact(c - 1)) / 2

    # Numbers of pairs: all, those that are equal in x, in y, in both, and those that agree.
    names = ["agree", "both", "in_x", "in_y"]
    zero = {name: F.lit(0).cast("decimal(38,0)") for name in names} | {"n": F.lit(0).cast("bigint")}

    def part(sums_of: DataFrame, **found: Column) -> DataFrame:
        one = sums_of.agg(*[c.alias(name) for name, c in found.items()])
        return one.select(*[(F.col(c) if c in found else zero[c]).cast("decimal(38,0)").alias(c) for c in ["n", *names]])

    product = F.sum(exact(F.col("high")) * exact(F.col("below") + F.col("offset")))
    totals = (
        part(agreeing, agree=product)
        .unionByName(part(cells, n=F.sum("weight"), both=pairs(F.col("weight"))))
        .unionByName(part(of_x, in_x=pairs(F.col("rows_x"))))
        .unionByName(part(of_y, in_y=pairs(F.col("rows_y"))))
        .agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ["n", *names]])
    )
    n, agree, both, in_x, in_y = (F.col(c).cast("double") for c in ["n", *names])
    everything = n * (n - 1) / 2
    # Agreeing less disagreeing pairs; no pair that is equal in x or y is either.
    surplus = 2 * agree - (everything - in_x - in_y + both)
    span = F.sqrt(everything - in_x) * F.sqrt(everything - in_y)
    return totals.select(F.col("n").cast("bigint").alias("n"), (surplus / F.nullif(span, F.lit(0.0))).alias("tau"))


# The Poisson distribution of mean 1 up to 0, 1, 2 ... events, in parts of 2 to the 32.
POISSON_UPTO = tuple(int(2**32 * sum(1 / factorial(i) for i in range(k + 1)) / e) for k in range(12))


def relationship_interval(
    points: DataFrame, key: str, x: str, y: str, replicates: int = 200, level: float = 0.95, seed: int = 7
) -> DataFrame:
    """Bootstrap intervals of the correlation and of the slope of y on x: (statistic, n_replicates, low, high).

    Every row is drawn a Poisson number of times in each replicate, by a hash of seed, key and replicate:
    reruns agree, whatever the partitions, and rows need not meet. All replicates are sums of one pass,
    added up before the shuffle. ``n_replicates`` counts those that determine the statistic; the interval
    is NULL without any. Rows without a key or a value are left out.
    """
    # A digest has the draws of four replicates.
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("key").cast("string"), F.col("four").cast("string")).cast("binary"))
    drawn = [F.conv(F.substring("digest", 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(4)]
    times = [sum((F.when(u >= upto, 1).otherwise(0) for upto in POISSON_UPTO), F.lit(0)) for u in drawn]
    rows = points.select(F.col(key).alias("key"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    fours = F.explode(F.sequence(F.lit(0), F.lit((replicates - 1) // 4)))
    weighted = (
        rows.withColumn("four", fours)
        .withColumn("digest", digest)
        .select("x", "y", "four", F.posexplode(F.array(*times)).alias("nth", "w"))
        .withColumn("replicate", F.col("four") * 4 + F.col("nth"))
        .filter((F.col("w") > 0) & (F.col("replicate") < replicates))
    )
    w, a, b = F.col("w"), F.col("x"), F.col("y")
    sums = weighted.groupBy("replicate").agg(
        F.sum(w).cast("double").alias("n"), F.sum(w * a).alias("a"), F.sum(w * b).alias("b"),
        F.sum(w * a * a).alias("aa"), F.sum(w * b * b).alias("bb"), F.sum(w * a * b).alias("ab"),
        (F.min(a) < F.max(a)).alias("varies_x"), (F.min(b) < F.max(b)).alias("varies_y"),
    )
    xx, yy, xy = F.expr("n * aa - a * a"), F.expr("n * bb - b * b"), F.expr("n * ab - a * b")
    spread = F.nullif(F.sqrt(F.greatest(xx * yy, F.lit(0.0))), F.lit(0.0))
    r = F.when(F.col("varies_x") & F.col("varies_y"), xy / spread)
    slope = F.when(F.col("varies_x"), xy / F.nullif(xx, F.lit(0.0)))
    found = sums.select(F.explode(F.array(
        F.struct(F.lit("r").alias("statistic"), r.alias("value")), F.struct(F.lit("slope").alias("statistic"), slope.alias("value"))
    )).alias("one")).select("one.*")
    tail = (1 - level) / 2
    return found.groupBy("statistic").agg(
        F.count("value").alias("n_replicates"),
        F.percentile("value", F.lit(tail)).alias("low"),
        F.percentile("value", F.lit(1 - tail)).alias("high"),
    )
