"""Projection, types, NULLs and date filters.

All of these are row-local: they never shuffle, and filters written here reach
the Parquet scan.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from comarca.functions import parse_date, parse_integer, strip
from comarca.functions.numbers import INTEGRAL


def project(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Keep the columns named in ``mapping`` (source -> model name) and rename them."""
    return df.select(*[F.col(src).alias(dst) for src, dst in mapping.items()])


def unify(df: DataFrame, schema: Mapping[str, str | Sequence[str]]) -> DataFrame:
    """Bring text columns to one type.

    A value of ``schema`` is a type name, or a list of date formats tried in
    order. Text that does not fit becomes NULL instead of failing the job.
    """

    def typed(text: Column, target: str | Sequence[str]) -> Column:
        if not isinstance(target, str):
            return parse_date(text, target)
        return parse_integer(text, target) if target in INTEGRAL else text.try_cast(target)

    return df.withColumns({c: typed(strip(F.col(c)), t) for c, t in schema.items()})


def null_sentinel(df: DataFrame, cols: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Turn placeholder texts (outer spaces ignored) into NULL."""
    return df.withColumns(
        {c: F.when(~strip(F.col(c)).isin(*values), F.col(c)) for c in cols}
    )


def null_fill(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """NULLs of a column become its default, which must be of the column's kind."""
    for name, value in defaults.items():
        is_text = isinstance(df.schema[name].dataType, StringType)
        if is_text != isinstance(value, str):
            raise TypeError(f"{value!r} is no default for {df.schema[name].simpleString()}")
    return df.fillna(dict(defaults))


def null_drop(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(cols))


def null_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """NULLs per column as rows (column_name, n_rows, n_null), in one pass over ``df``."""
    cols = list(cols or df.columns)
    counts = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count_if(F.col(c).isNull()).alias(c) for c in cols],
    )
    return counts.unpivot("_rows", cols, "column_name", "n_null").select(
        "column_name", F.col("_rows").alias("n_rows"), "n_null"
    )


def filter_since(df: DataFrame, date_col: str, year: int) -> DataFrame:
    """Rows dated on or after 1 January of ``year``.

    A range on the bare column, so that Parquet row groups can be skipped;
    ``year(col) >= y`` would only push ``IS NOT NULL``. The literal takes the
    column's own type to keep a cast off the column.
    """
    kind = df.schema[date_col].dataType.simpleString()
    return df.where(F.col(date_col) >= F.lit(f"{year:04d}-01-01").cast(kind))


def since_tally(df: DataFrame, raw_col: str, date_col: str, year: int) -> DataFrame:
    """How ``filter_since`` splits a register: one row of counts.

    ``raw_col`` is the date as received, ``date_col`` the parsed date; a value
    that is there but was not readable is counted apart from a missing one.
    """
    start = F.lit(f"{year:04d}-01-01").cast("date")
    date = F.col(date_col)
    return df.agg(
        F.count_if(date >= start).alias("n_since"),
        F.count_if(date < start).alias("n_before"),
        F.count_if(date.isNull() & F.col(raw_col).isNotNull()).alias("n_unreadable"),
        F.count_if(F.col(raw_col).isNull()).alias("n_missing"),
    )
