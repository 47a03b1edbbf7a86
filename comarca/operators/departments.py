"""Questions per department and per province.

Facts are frames with ``dep_id`` and some of the measures ``persons``,
``schools`` and ``libraries``, at any grain: raw register rows carry a 1, rows
already summed carry their sum. Several such frames are stacked and summed in
one aggregation, never joined to each other, so counts cannot multiply and the
only shuffle is the one on ``dep_id``, after partial sums.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MEASURES = ("persons", "schools", "libraries")


def as_facts(register: DataFrame, measure: str, *keep: str) -> DataFrame:
    """A register with one row per school or library, as facts counting 1 each."""
    return register.select("dep_id", *keep, F.lit(1).cast("bigint").alias(measure))


def stack(*facts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), facts)


def _zero_filled(dep: DataFrame, per_department: DataFrame) -> DataFrame:
    """Every department once, with 0 where it has no facts."""
    counts = [c for c in per_department.columns if c != "dep_id"]
    joined = dep.join(per_department, "dep_id", "left")
    return joined.select(*dep.columns, *[F.coalesce(c, F.lit(0)).alias(c) for c in counts])


def population(pop: DataFrame) -> DataFrame:
    return pop.groupBy("dep_id").agg(F.sum("persons").alias("persons"))


def _level_counts(levels: Mapping[str, str]) -> list[Column]:
    return [
        F.coalesce(F.sum(F.when(F.col("level_id") == value, F.col("schools"))), F.lit(0)).alias(name)
        for name, value in levels.items()
    ]


def schools_by_level(schools: DataFrame, levels: Mapping[str, str]) -> DataFrame:
    """Schools per department, one column per level (column name -> level value)."""
    return schools.groupBy("dep_id").agg(*_level_counts(levels))


def summary(
    dep: DataFrame,
    pop: DataFrame,
    schools: DataFrame,
    levels: Mapping[str, str],
    bands: Mapping[str, str] | None = None,
) -> DataFrame:
    """Population and schools per level, side by side for every department.

    ``bands`` (column name -> band value) adds the population of the age bands
    when ``pop`` has a ``band`` column.
    """
    facts = schools if pop is schools else stack(pop, schools)
    in_bands = [
        F.coalesce(F.sum(F.when(F.col("band") == value, F.col("persons"))), F.lit(0)).alias(name)
        for name, value in (bands or {}).items()
    ]
    per_department = facts.groupBy("dep_id").agg(
        F.sum("persons").alias("persons"), *in_bands, *_level_counts(levels)
    )
    return _zero_filled(dep, per_department)


def libraries_since(dep: DataFrame, libs: DataFrame) -> DataFrame:
    """Libraries per department, departments without any as 0.

    ``libs`` are facts that went through ``filter_since`` already, so that the
    date range stays next to the scan.
    """
    return _zero_filled(dep, libs.groupBy("dep_id").agg(F.sum("libraries").alias("libraries")))


def integrate(dep: DataFrame, *facts: DataFrame) -> DataFrame:
    """Population, schools and libraries of every department, one row each."""
    per_department = (
        stack(*facts).groupBy("dep_id").agg(*[F.sum(m).alias(m) for m in MEASURES])
    )
    return _zero_filled(dep, per_department)


def schools_per_department(dep: DataFrame, schools: DataFrame) -> DataFrame:
    """(prov_id, dep_id, schools) for every department."""
    counts = schools.groupBy("dep_id").agg(F.sum("schools").alias("schools"))
    return _zero_filled(dep.select("prov_id", "dep_id"), counts)


def libraries_per_province(prov: DataFrame, dep: DataFrame, libs: DataFrame) -> DataFrame:
    """Bar chart data: every province once, with its number of libraries.

    A library is in the province of its department. One whose department is missing
    or unknown is in the province it names itself, if ``libs`` has ``prov_id``.
    Counted per department, then per province: both joins see one row per key.
    """
    own = F.col("prov_id") if "prov_id" in libs.columns else F.lit(None)
    per_department = (
        libs.withColumn("own", own).groupBy("dep_id", "own").agg(F.sum("libraries").alias("libraries"))
    )
    per_province = (
        per_department.join(dep.select("dep_id", "prov_id"), "dep_id", "left")
        .groupBy(F.coalesce("prov_id", "own").alias("prov_id"))
        .agg(F.sum("libraries").alias("libraries"))
    )
    return prov.join(per_province, "prov_id", "left").select(
        *prov.columns, F.coalesce("libraries", F.lit(0)).alias("libraries")
    )


def rank_provinces(bars: DataFrame) -> DataFrame:
    """Bar chart data with the place of each province, 1 for the most libraries; equal counts share a place.

    The window orders provinces, not libraries.
    """
    place = F.rank().over(Window.orderBy(F.col("libraries").desc()))
    return bars.withColumn("place", place.cast("bigint"))


def scatter(dep: DataFrame, *facts: DataFrame) -> DataFrame:
    """One point (dep_id, level_id, schools, persons) per known department and level.

    ``persons`` is the whole population of the department. The window runs over
    sums: a department has one row per level there, however many schools it has.
    """
    per_level = (
        stack(*facts)
        .groupBy("dep_id", "level_id")
        .agg(F.sum("schools").alias("schools"), F.sum("persons").alias("level_persons"))
    )
    everyone = F.sum("level_persons").over(Window.partitionBy("dep_id"))
    return (
        per_level.withColumn("persons", F.coalesce(everyone, F.lit(0)))
        .where(F.col("level_id").isNotNull() & (F.col("schools") > 0))
        .join(dep.select("dep_id"), "dep_id", "left_semi")
        .select("dep_id", "level_id", "schools", "persons")
    )


def totals(dep: DataFrame, *facts: DataFrame) -> DataFrame:
    """(grain, prov_id, level_id, departments, persons, schools, libraries): the sums of every grain in one pass.

    ``grain`` is country, province, level or province and level. Facts are those of ``integrate``; those of a level
    have it in ``level_id`` and their schools in ``level_schools``, so that a school with several levels counts
    once in each and, by a fact with ``schools``, once in the total. Departments, persons and libraries
    have no level and are NULL where there is one. Only known departments count, and
    every province that has one is there.

    The grouping sets run over sums per province and level, not over facts.
    """
    sums = [*MEASURES, "level_schools"]
    empty = dep.select("dep_id", F.lit(None).cast("string").alias("level_id"), *[F.lit(0).cast("bigint").alias(m) for m in sums])
    per_level = stack(empty, *facts).groupBy("dep_id", "level_id").agg(*[F.sum(m).alias(m) for m in sums])
    known = dep.select("dep_id", "prov_id")
    per_province = (
        per_level.join(known, "dep_id")
        .groupBy("prov_id", "level_id")
        # A department has one row without a level, which its empty fact has made.
        .agg(F.count_if(F.col("level_id").isNull()).alias("departments"), *[F.sum(m).alias(m) for m in sums])
    )
    prov, level = F.col("prov_id"), F.col("level_id")
    grouped = per_province.groupingSets([[prov, level], [prov], [level], []], prov, level).agg(
        F.grouping_id(prov, level).alias("_left_out"), *[F.sum(m).alias(m) for m in ("departments", *sums)]
    )
    has_level = F.col("_left_out").isin(0, 2)
    grains = F.element_at(F.array(*map(F.lit, ("province and level", "province", "level", "country"))), F.col("_left_out").cast("int") + 1)

    def zero_filled(measure: str) -> Column:
        return F.when(~has_level, F.coalesce(measure, F.lit(0))).alias(measure)

    return grouped.where(~has_level | F.col("level_id").isNotNull()).select(
        grains.alias("grain"),
        "prov_id",
        "level_id",
        zero_filled("departments"),
        zero_filled("persons"),
        F.when(has_level, F.coalesce("level_schools", F.lit(0))).otherwise(F.coalesce("schools", F.lit(0))).alias("schools"),
        zero_filled("libraries"),
    )
