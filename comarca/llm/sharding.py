"""Contiguous shards of near equal bytes, by prefix sums over partition totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from comarca.llm.common import partitions, stored


def shard_by_bytes(
    docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Deals documents, in id order, over ``n_shards`` shards of near equal bytes.

    Returns one row per input row: id, size (UTF-8 bytes plus 1), text_crc32, shard, slot
    (position in the shard, gapless from 0). A row goes to the shard in which the middle
    of its bytes falls, so a shard misses its share by at most half a row at either end.

    - Null text: size 1, the checksum of the empty text. Empty text: the same.
    - A text longer than a shard's share leaves its neighbours short or empty; nothing is cut.
    - Null ids come first. Repeated ids are ordered by checksum; equal rows in any order.
    - Only id and text are read, other columns may have any name. An empty table gives no rows.

    Text is read once and only sizes are shuffled. The rows are ordered by range partitions,
    running sums are taken within each, and the partition totals (a row per partition) give
    the offsets. Row numbers are part of the range key, so no id can fill a partition alone.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = stored(
        docs.select(
            F.col(id_col).alias("id"),
            (F.octet_length(text).cast("long") + 1).alias("size"),
            F.crc32(text.cast("binary")).alias("crc"),
            F.monotonically_increasing_id().alias("row"),
        )
    )
    order = [F.col("id").asc_nulls_first(), F.col("crc"), F.col("row")]
    ranged = stored(
        slim.repartitionByRange(partitions(spark), *order).withColumn("part", F.spark_partition_id())
    )
    by_part = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy("part")
        .agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
        .select(
            "part",
            F.coalesce(F.sum("bytes").over(by_part), F.lit(0)).alias("bytes_before"),
            F.coalesce(F.sum("rows").over(by_part), F.lit(0)).alias("rows_before"),
            F.sum("bytes").over(Window.partitionBy()).alias("total"),
        )
    )
    within = Window.partitionBy("part").orderBy(*order)
    running = F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0))
    summed = ranged.select("*", running.alias("upto"), F.row_number().over(within).alias("nth"))
    middle = f"int(({n_shards} * (2 * (bytes_before + upto) - size)) div (2 * total))"
    placed = summed.join(offsets, "part").select(
        "id",
        "size",
        "crc",
        F.expr(middle).alias("shard"),
        (F.col("rows_before") + F.col("nth") - 1).alias("at"),
    )
    placed = stored(placed)
    starts = placed.groupBy("shard").agg(F.min("at").alias("start"))  # n_shards rows
    return placed.join(F.broadcast(starts), "shard").select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        "shard",
        (F.col("at") - F.col("start")).alias("slot"),
    )
