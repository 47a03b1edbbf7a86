"""CSV registers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StringType, StructType

CORRUPT = "_corrupt_record"

# Reader and writer must agree on these, or quotes, line breaks and outer spaces
# change on the way. Spark's own defaults escape quotes with a backslash and trim.
CSV_OPTIONS = {
    "header": True,
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
    # Told apart from an empty text, which is written as "".
    "nullValue": "\\N",
}


def scan_csv(
    spark: SparkSession,
    path: str,
    schema: StructType | str,
    multi_line: bool = False,
    separator: str = ",",
    encoding: str = "UTF-8",
) -> DataFrame:
    """Read a register under a fixed schema, never an inferred one.

    Inference would turn the code ``02`` into the number 2. Columns are taken by
    position, so a file whose header differs from the schema fails the read.
    Rows that do not fit keep what could be read and hold their whole text in
    ``_corrupt_record``, NULL for good rows.

    Set ``multi_line`` only for files with line breaks inside values: Spark
    cannot split such a file, so each one is read by a single task. Files from
    ``write_model`` are kept small enough for that.
    """
    fields = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    flagged = StructType([*fields.fields]).add(CORRUPT, StringType())
    return (
        spark.read.schema(flagged)
        .options(**CSV_OPTIONS, multiLine=multi_line, mode="PERMISSIVE", enforceSchema=False)
        .options(columnNameOfCorruptRecord=CORRUPT, sep=separator, encoding=encoding)
        .csv(path)
    )
