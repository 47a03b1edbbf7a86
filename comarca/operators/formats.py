"""Formats and placeholders of text columns, found without being told."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What does not follow any pattern of a column.
OTHER = "*"
# Each level makes the patterns of the one before it wider: runs of a kind, then words of any kinds.
_WIDER = (
    (("9+", "9+"), ("a+", "a+"), ("A+", "A+")),
    ((r"([9aA][+])+", "w+"),),
)


def _shape(value: Column) -> Column:
    """Each digit as 9, small letter as a and other letter as A; all else stands for itself."""
    for found, put in ((r"\p{Nd}", "9"), (r"\p{Ll}", "a"), (r"[\p{Lu}\p{Lt}\p{Lo}\p{Lm}]", "A")):
        value = F.regexp_replace(value, found, put)
    return value


def _wider(pattern: Column, level: int) -> Column:
    for found, put in _WIDER[level - 1]:
        pattern = F.regexp_replace(pattern, found, put)
    return pattern


def mine_formats(df: DataFrame, cols: Sequence[str], share: float = 0.02, placeholder_share: float = 0.005) -> DataFrame:
    """The few patterns that cover a column's texts: (column_name, level, pattern, n_rows, n_values, example, is_placeholder).

    Texts become shapes (level 0). A shape that at least ``share`` of the column's texts have is a pattern. The texts
    of all others are looked at in wider shapes, with runs of any length (1) and then words of letters and digits (2);
    what has no pattern even then is ``*`` (3). Every text is counted in exactly one pattern, so there are at most
    3 / share + 1 a column. ``example`` is the smallest text.

    A shape of one single text that at least ``placeholder_share`` of the texts are, in a column with shapes of many
    texts, is a placeholder: it is a pattern of its own whatever its share. NULLs have no pattern; a column
    without texts has no rows.

    Equal texts are counted before the shuffle and their shapes once. Patterns widen as groups do, by partial sums, and
    are joined to the columns' totals only, a row each.
    """
    texts = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in cols]))
    values = (
        df.select(texts.alias("one")).select("one.*").dropna().groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    )
    measures = [F.sum("n").alias("n"), F.sum("n_values").alias("n_values"), F.min("example").alias("example")]
    shapes = (
        values.select("column_name", _shape(F.col("value")).alias("pattern"), "n", F.lit(1).cast("bigint").alias("n_values"), F.col("value").alias("example"))
        .groupBy("column_name", "pattern")
        .agg(*measures)
    )
    totals = shapes.groupBy("column_name").agg(F.sum("n").alias("total"), F.max("n_values").alias("most"))
    # One row a column, small enough for Spark to broadcast by itself.
    left = shapes.join(totals, "column_name")
    single = (F.col("n_values") == 1) & (F.col("most") > 1) & (F.col("n") >= F.col("total") * F.lit(placeholder_share))
    often = F.col("n") >= F.col("total") * F.lit(share)
    left = left.withColumn("is_placeholder", single).withColumn("level", F.when(often | single, 0))
    for level in range(1, len(_WIDER) + 1):
        # Those with a pattern keep it; the others meet in a wider one.
        wider = F.when(F.col("level").isNull(), _wider(F.col("pattern"), level)).otherwise(F.col("pattern"))
        left = (
            left.withColumn("pattern", wider)
            .groupBy("column_name", "pattern", "level", "is_placeholder", "total")
            .agg(*measures)
            .withColumn("level", F.coalesce("level", F.when(often, level)))
        )
    last = len(_WIDER) + 1
    pattern = F.when(F.col("level").isNull(), OTHER).otherwise(F.col("pattern"))
    return (
        left.select("column_name", F.coalesce("level", F.lit(last)).cast("bigint").alias("level"), pattern.alias("pattern"), "is_placeholder", "n", "n_values", "example")
        .groupBy("column_name", "level", "pattern", "is_placeholder")
        .agg(*measures)
        .select("column_name", "level", "pattern", F.col("n").alias("n_rows"), "n_values", "example", "is_placeholder")
    )
