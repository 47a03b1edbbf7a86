"""The folder of model tables: Parquet to work with, CSV to hand out."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Mapping
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from comarca.sources.csv import CSV_OPTIONS

# Bounds the file a multi-line CSV reader has to take in one task.
ROWS_PER_CSV_FILE = 1_000_000


@lru_cache(1)
def _own_folder() -> str:
    folder = tempfile.mkdtemp(prefix="comarca-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def work_folder(spark: SparkSession) -> str:
    """A new folder for tables written on the way, below ``spark.checkpoint.dir``.

    That setting names the folder all executors share. Only a local session
    without the setting gets a temporary folder of this machine, which goes when
    the process ends.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        shared = _own_folder()
    return f"{shared.rstrip('/')}/{uuid.uuid4().hex}"


def store(df: DataFrame, directory: str, name: str) -> DataFrame:
    """Write ``<name>.parquet`` and give back the stored table, free of what made it."""
    df.write.mode("overwrite").parquet(f"{directory}/{name}.parquet")
    return read_model(df.sparkSession, directory, name, df.schema)


def write_model(
    df: DataFrame, directory: str, name: str, rows_per_file: int = ROWS_PER_CSV_FILE
) -> DataFrame:
    """Write a model table as ``<name>.parquet`` and ``<name>.csv``; give back the former.

    The CSV is made from the written Parquet, so that ``df`` is computed once.
    """
    stored = store(df, directory, name)
    (
        stored.write.mode("overwrite")
        .options(**CSV_OPTIONS)
        .option("maxRecordsPerFile", rows_per_file)
        .csv(f"{directory}/{name}.csv")
    )
    return stored


def read_model(
    spark: SparkSession, directory: str, name: str, schema: StructType | str | None = None
) -> DataFrame:
    """A model table; with its schema given, no job runs to read one from a file."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(f"{directory}/{name}.parquet")


def register_model(
    spark: SparkSession, directory: str, schemas: Mapping[str, StructType | str], prefix: str = ""
) -> None:
    """Make the model tables of a folder known to ``spark.sql`` as ``<prefix><name>``."""
    for name, schema in schemas.items():
        read_model(spark, directory, name, schema).createOrReplaceTempView(prefix + name)
