"""Exact duplicates by content hash, with a comparison of the bytes behind it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from comarca.llm.common import ascii_lower, salted_join, stored


def content_hash(text: Column) -> Column:
    """128 bits of the text."""
    return F.unhex(F.md5(text.cast("binary")))


def exact_groups(
    docs: DataFrame,
    keep: str = "min",
    id_col: str = "doc_id",
    text_col: str = "text",
    hash_of: Callable[[Column], Column] = content_hash,
) -> DataFrame:
    """Groups documents whose texts are equal after lower-casing A-Z.

    Returns id, keep_id (the smallest or, with ``keep="max"``, the largest id of the group),
    group_size, kept and text_sha256 of the normalised text.

    - Null text counts as empty, so null and empty texts form one group.
    - Every row counts and comes back, also one that repeats an id together with its text; all rows
      that have the id that stays are kept. One id with different texts is in several groups.
    - Rows with a null id are in the group of their text; they are kept only where it has no other id.
    - Only id and text are read, other columns may have any name. An empty table gives no rows.

    Documents are grouped by the hash alone, on slim rows. Whole texts are compared apart:
    the distinct (hash, text) pairs, taken map-side before their one shuffle, show the hashes
    with more than one text. Documents of such hashes, if any, are grouped by the bytes.
    """
    norm = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    base = docs.select(F.col(id_col).alias("id"), norm.alias("norm")).withColumn("h", hash_of(F.col("norm")))
    slim = stored(base.select("id", "h", F.sha2("norm", 256).alias("sha"), F.monotonically_increasing_id().alias("row")))
    clashes = stored(base.select("h", "norm").distinct().groupBy("h").count().filter("count > 1").select("h"))
    pick = F.max("id") if keep == "max" else F.min("id")
    out = _grouped(slim.join(clashes, "h", "left_anti"), ["h"], pick)
    if not clashes.isEmpty():
        apart = base.join(clashes, "h", "left_semi").select("id", "norm", F.sha2("norm", 256).alias("sha"))
        apart = stored(apart.withColumn("row", F.monotonically_increasing_id()))
        out = out.unionByName(_grouped(apart, ["norm"], pick))
    return out.withColumnRenamed("id", id_col)


def _grouped(rows: DataFrame, keys: list[str], pick: Column) -> DataFrame:
    """Hot groups are summed map-side and their rows are dealt over several tasks."""
    groups = rows.groupBy(*keys).agg(pick.alias("keep_id"), F.count("*").alias("group_size"))
    return salted_join(rows, groups, keys, "group_size", rows.count(), "row").select(
        "id",
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_exact(docs: DataFrame, keep: str = "min", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that ``exact_groups`` keeps, with all their columns, each once."""
    found = exact_groups(docs, keep, id_col, text_col).filter("kept")
    kept = found.select(F.col(id_col).alias("_id"), F.col("text_sha256").alias("_sha"))
    sha = F.sha2(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), 256)
    same = docs[id_col].eqNullSafe(kept["_id"])
    # A null id cannot be hashed to a partition of its own by eqNullSafe and sha alone, so both are keys.
    matched = docs.withColumn("_text_sha", sha).join(
        kept.hint("merge"), same & (F.col("_text_sha") == F.col("_sha")), "left_semi"
    )
    first = Window.partitionBy(id_col, "_text_sha").orderBy("_text_sha")
    return matched.withColumn("_nth", F.row_number().over(first)).filter("_nth = 1").drop("_nth", "_text_sha")
