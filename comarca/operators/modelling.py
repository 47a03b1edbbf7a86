"""Relational modelling: dimensions, keys and normal forms.

The checks count groups. Each one aggregates on the mapper side first, so a key
that holds a large share of the rows reaches its reducer as one row per task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dim_extract(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Distinct values of ``cols``; the natural value is the key of the new table."""
    return df.select(*cols).dropna(how="all").distinct()


def dim_by_key(df: DataFrame, key: str, attributes: Sequence[str]) -> DataFrame:
    """One row per ``key``: its most frequent attributes, the first by value among equals.

    Rows without a key are no part of the dimension. Spellings are counted before they meet, so
    a key costs as many rows as it has different attributes.
    """
    spellings = df.dropna(subset=[key]).groupBy(key, *attributes).agg((-F.count(F.lit(1))).alias("_n"))
    best = spellings.groupBy(key).agg(F.min(F.struct("_n", *attributes)).alias("_best"))
    return best.select(key, *[F.col("_best")[a].alias(a) for a in attributes])


def key_variants(df: DataFrame, key: str, attributes: Sequence[str]) -> DataFrame:
    """What ``dim_by_key`` had to choose from: (key, n_variants) of keys with several attributes."""
    return check_fd(df.dropna(subset=[key]), [key], attributes).withColumnRenamed("n_values", "n_variants")


def dedup_rows(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row per ``key``: the smallest by the other columns in their order, NULL before all.

    A NULL part of a key is a value. The choice is an aggregate, made in part before the
    shuffle, so a row repeated any number of times is one row per task.
    """
    rest = [c for c in df.columns if c not in key]
    if not rest:
        return df.distinct()
    best = df.groupBy(*key).agg(F.min(F.struct(*rest)).alias("_best"))
    return best.select(*[c if c in key else F.col("_best")[c].alias(c) for c in df.columns])


def bridge(df: DataFrame, key: str, flags: Mapping[str, str], value_name: str) -> DataFrame:
    """Wide flag columns (column -> value) to one (key, value) row per set flag.

    NULL, blank and ``0`` mean "not set".
    """
    values = F.array(
        *[
            F.when(~F.trim(F.col(c).cast("string")).isin("", "0"), F.lit(v))
            for c, v in flags.items()
        ]
    )
    return df.select(key, F.explode(values).alias(value_name)).dropna(subset=[value_name])


def check_1nf(df: DataFrame, key: Sequence[str], cols: Sequence[str], delim: str) -> DataFrame:
    """Cells holding several values: (key, column_name, n_values)."""

    def n_values(col: Column) -> Column:
        without = F.length(F.replace(col, F.lit(delim), F.lit("")))
        return ((F.length(col) - without) / len(delim) + 1).cast("bigint")

    cells = [
        F.struct(F.lit(c).alias("column_name"), n_values(F.col(c)).alias("n_values")) for c in cols
    ]
    return (
        df.select(*key, F.explode(F.array(*cells)).alias("cell"))
        .where(F.col("cell.n_values") > 1)
        .select(*key, "cell.column_name", "cell.n_values")
    )


def check_key(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Groups that keep ``cols`` from being a key: repeated, or with a NULL part."""
    has_null = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in cols])
    return (
        df.groupBy(*cols)
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .where((F.col("n_rows") > 1) | has_null)
    )


def check_fd(df: DataFrame, lhs: Sequence[str], rhs: Sequence[str]) -> DataFrame:
    """Groups of ``lhs`` with more than one value of ``rhs`` (NULL is a value)."""
    return (
        df.select(*lhs, *rhs)
        .distinct()
        .groupBy(*lhs)
        .agg(F.count(F.lit(1)).alias("n_values"))
        .where("n_values > 1")
    )


def fd_profile(
    df: DataFrame, dependencies: Sequence[tuple[Sequence[str], Sequence[str]]]
) -> DataFrame:
    """One row per dependency ``lhs -> rhs``, all of them from one pass over ``df``.

    ``n_violating`` groups of ``lhs`` have several values of ``rhs``: zero means
    that the dependency holds. ``n_repeated`` groups have several rows: zero
    means that ``lhs`` is itself a candidate key. NULL counts as a value.

    A row is a few numbers per ``lhs``: 128 bits of its values, and 64 bits of each
    ``rhs``, of which a group keeps the smallest and the largest. Rows are dealt out
    before, as a single task may read a whole file of short rows and would keep all
    their groups.
    """
    asked: dict[tuple[str, ...], list[tuple[str, ...]]] = {}
    for lhs, rhs in dependencies:
        asked.setdefault(tuple(lhs), []).append(tuple(rhs))
    slots = range(max(len(sides) for sides in asked.values()))
    used = sorted({c for lhs, rhs in dependencies for c in (*lhs, *rhs)})

    def bits(salt: int, cols: Sequence[str]) -> Column:
        # A hash passes over NULL, so whether there is one is hashed too.
        cells = [(F.col(c).cast("string"), F.col(c).isNull()) for c in cols]
        return F.xxhash64(F.lit(salt), *[part for cell in cells for part in cell])

    def label(names: Sequence[str | None]) -> Column:
        return F.get(F.array(*[F.lit(n).cast("string") for n in names]), F.col("test"))

    tested = [
        F.struct(
            F.lit(i).alias("test"),
            bits(0, lhs).alias("x"),
            bits(1, lhs).alias("x_more"),
            *[bits(2, sides[j] if j < len(sides) else ()).alias(f"y{j}") for j in slots],
        )
        for i, (lhs, sides) in enumerate(asked.items())
    ]
    # Rows that are alike go to one task only as far as one task has read them.
    place = F.hash(F.spark_partition_id(), *[F.col(c).cast("string") for c in used])
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = (
        df.select(*used, place.alias("_place"))
        .repartition(tasks, "_place")
        .select(F.inline(F.array(*tested)))
        .groupBy("test", "x", "x_more")
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            *[f(f"y{j}").alias(f"{name}{j}") for j in slots for f, name in ((F.min, "low"), (F.max, "high"))],
        )
    )
    counts = groups.groupBy("test").agg(
        F.count(F.lit(1)).alias("n_groups"),
        F.count_if(F.col("n_rows") > 1).alias("n_repeated"),
        *[F.count_if(F.col(f"low{j}") != F.col(f"high{j}")).alias(f"n{j}") for j in slots],
    )
    sides = [
        F.struct(
            label([",".join(rhs[j]) if j < len(rhs) else None for rhs in asked.values()]).alias("rhs"),
            F.col(f"n{j}").alias("n_violating"),
        )
        for j in slots
    ]
    return (
        counts.select(
            label([",".join(lhs) for lhs in asked]).alias("lhs"), "n_groups", "n_repeated", F.inline(F.array(*sides))
        )
        .where("rhs is not null")
        .select("lhs", "rhs", "n_groups", "n_violating", "n_repeated")
    )


def check_normal_forms(df: DataFrame, key: Sequence[str], attributes: Sequence[str]) -> DataFrame:
    """Partial (2NF) and transitive (3NF) dependencies of a table with the given key.

    One row per tested dependency. ``breaks`` names the form it breaks, NULL if
    none: a proper part of the key, or an attribute that is no candidate key
    itself, must not determine another attribute.
    """
    parts = [list(p) for size in range(1, len(key)) for p in combinations(key, size)]
    partial = [(p, [a]) for p in parts for a in attributes]
    transitive = [([x], [a]) for x in attributes for a in attributes if x != a]
    holds_off_key = (F.col("n_violating") == 0) & (F.col("n_repeated") > 0)
    form = F.when(F.col("lhs").isin(*attributes), "3NF").otherwise("2NF")
    return fd_profile(df, partial + transitive).withColumn(
        "breaks", F.when(holds_off_key, form)
    )


def check_foreign_key(
    child: DataFrame, child_key: str, parent: DataFrame, parent_key: str
) -> DataFrame:
    """Key values on one side only: (key_value, problem, n_rows).

    ``orphan``: rows of ``child`` without a parent; ``childless``: the other way
    round. NULL references nothing and is no orphan. Both sides are reduced to
    one row per key before they meet.
    """
    refs = (
        child.where(F.col(child_key).isNotNull())
        .groupBy(F.col(child_key).alias("key_value"))
        .agg(F.count(F.lit(1)).alias("child_rows"))
    )
    keys = (
        parent.where(F.col(parent_key).isNotNull())
        .groupBy(F.col(parent_key).alias("key_value"))
        .agg(F.count(F.lit(1)).alias("parent_rows"))
    )
    return (
        refs.join(keys, "key_value", "full")
        .where(F.col("child_rows").isNull() | F.col("parent_rows").isNull())
        .select(
            "key_value",
            F.when(F.col("parent_rows").isNull(), "orphan").otherwise("childless").alias("problem"),
            F.coalesce("child_rows", "parent_rows").alias("n_rows"),
        )
    )
