"""Runs the whole study: ``python -m comarca study.json``; on a cluster, with the
repository on ``PYTHONPATH``, ``spark-submit comarca/__main__.py study.json``.

The file names the registers and how their columns are called:

    {
      "output": "<shared folder>/study",
      "registers": {
        "codes": {
          "path": "<shared folder>/codes.csv",
          "header": ["all", "columns", "in", "file", "order"],
          "columns": {"<column>": "prov_code", "<column>": "prov_name", ...},
          "multi_line": false,
          "separator": ";",
          "encoding": "ISO-8859-1"
        },
        "population": {...}, "schools": {...}, "libraries": {...}
      },
      "levels": {"<flag column of schools>": "<level name>"},
      "bands": {"<result column>": "<value of band>"},
      "since": 1950,
      "prov_width": 2,
      "dep_width": 3,
      "date_formats": ["yyyy-MM-dd", "yyyy"],
      "sentinels": ["", "S/D"]
    }

``comarca.plans.model`` lists the columns each register must have. ``bands`` and
what follows it may be left out, and so may what follows ``columns``.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StringType, StructField, StructType

from comarca.operators.cleaning import project
from comarca.plans.study import run_study
from comarca.sources import CORRUPT, scan_csv

OPTIONAL = ("bands", "since", "prov_width", "dep_width", "date_formats", "sentinels")


def read_register(spark: SparkSession, source: Mapping) -> DataFrame:
    schema = StructType([StructField(name, StringType()) for name in source["header"]])
    how = {name: source[name] for name in ("multi_line", "separator", "encoding") if name in source}
    raw = scan_csv(spark, source["path"], schema, **how)
    return project(raw, source["columns"] | {CORRUPT: CORRUPT})


def run(spark: SparkSession, settings: Mapping) -> dict[str, DataFrame]:
    registers = {n: read_register(spark, s) for n, s in settings["registers"].items()}
    options = {name: settings[name] for name in OPTIONAL if name in settings}
    return run_study(spark, registers, settings["levels"], settings["output"], **options)


if __name__ == "__main__":
    with open(sys.argv[1], encoding="utf-8") as file:
        run(SparkSession.builder.appName("comarca").getOrCreate(), json.load(file))
