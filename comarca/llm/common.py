"""Helpers that several operators of this package share."""

from __future__ import annotations

import ctypes
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from comarca.sources import work_folder

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# A key is hot if it holds at least one in so many rows, or one in as many as there are shuffle partitions if those are more.
HOT_SHARE = 256


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def stored(df: DataFrame) -> DataFrame:
    """The frame, written to the folder all executors share and read again: lineage ends here."""
    spark = df.sparkSession
    path = f"{work_folder(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tokenizer_file(name: str) -> str:
    """A vocabulary file of the installed public tokenizers; every machine has the package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hot_shares(spark: SparkSession) -> int:
    """A key is hot if it holds more than one of so many shares of all rows; it is dealt over a task for each."""
    return max(HOT_SHARE, partitions(spark))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def training_remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, by which documents are held out; a null id counts as empty text."""
    crc = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    return F.pmod(crc, F.lit(divisor))


def release_memory() -> None:
    """Gives back to the system what Arrow and, where it can, the C library hold of memory that was freed."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def slices(texts: list[str], chars: int):
    """Runs of texts of about so many characters, so that a batch's arrays stay small."""
    run, size = [], 0
    for t in texts:
        run.append(t)
        size += len(t)
        if size >= chars:
            yield run
            run, size = [], 0
    if run:
        yield run


def salted_join(
    left: DataFrame, right: DataFrame, keys: list[str], weight: str, total: int, salt_by: str
) -> DataFrame:
    """Inner join with the left rows of hot keys dealt over several tasks.

    ``right[weight]`` is the number of left rows of the key and ``total`` the number of all left
    rows. A share is a task's mean part of them, or less, and no more keys can reach one than there are
    shares, so the broadcast list of hot keys has at most as many rows as there are shuffle partitions,
    or ``HOT_SHARE``. A key is dealt over as many tasks as it has shares, and its right rows are
    copied as often: the copies of all hot keys are no more than the shares.
    """
    shares = hot_shares(left.sparkSession)
    salts = F.greatest(F.lit(1), F.expr(f"int({weight} * {shares} div {max(total, 1)})"))
    hot = right.select(*keys, salts.alias("_salts")).filter("_salts > 1").groupBy(*keys).agg(F.max("_salts").alias("_salts"))
    dealt = left.join(F.broadcast(hot), keys, "left").withColumn(
        "_salt", F.coalesce(F.pmod(F.xxhash64(salt_by), "_salts"), F.lit(0)).cast("int")
    )
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    return dealt.join(copies.hint("merge"), [*keys, "_salt"]).drop("_salt", "_salts")
