"""Joins of facts to dimensions.

Questions that end in an aggregate do not need ``lookup_join``: they aggregate
first and then join on unique keys. It is for results that keep every row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup_join(facts: DataFrame, dim: DataFrame, on: str) -> DataFrame:
    """Left join of many rows to a dimension with at most one row per ``on``.

    The plan is Spark's choice by bytes, at plan time and again at run time: a
    dimension below the broadcast threshold is broadcast, and beyond it a key with
    a large share of the rows is split over several tasks (skew join). NULL keys
    match nothing and are kept.
    """
    return facts.join(dim, on, "left")


def with_geo(dep: DataFrame, prov: DataFrame) -> DataFrame:
    """Departments with the columns of their province, found by ``prov_id``."""
    return lookup_join(dep, prov, "prov_id")


def roll_up(
    facts: DataFrame, key: str, lookup: DataFrame, sums: list[str], how: str = "inner"
) -> DataFrame:
    """Facts that know a key of ``lookup`` rather than their department.

    Sums per key come first, so that the join is one row to one row; joining the
    raw facts would send all rows of a hot key to one task. ``how="left"`` keeps
    the rows of ``lookup`` that have no facts.
    """
    per_key = facts.groupBy(key).agg(*[F.sum(c).alias(c) for c in sums])
    return lookup.join(per_key, key, how).drop(key)
