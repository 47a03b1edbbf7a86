"""Does a built model keep its own rules? Keys, references and normal forms."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from comarca.operators.modelling import check_key, check_normal_forms

KEYS = {
    "provinces": ["prov_id"],
    "departments": ["dep_id"],
    "levels": ["level_id"],
    "schools": ["school_id"],
    "school_levels": ["school_id", "level_id"],
    "libraries": ["lib_id"],
    "population": ["dep_id", "band"],  # band where the register has it
}
# child table, column, parent table
REFERENCES = (
    ("departments", "prov_id", "provinces"),
    ("schools", "dep_id", "departments"),
    ("school_levels", "school_id", "schools"),
    ("school_levels", "level_id", "levels"),
    ("libraries", "dep_id", "departments"),
    ("libraries", "prov_id", "provinces"),
    ("population", "dep_id", "departments"),
)
NORMAL_FORMS = {"departments": ["dep_name", "prov_id"]}


def _keys(model: Mapping[str, DataFrame], table: str) -> list[str]:
    return [c for c in KEYS[table] if c in model[table].columns]


def _without_parent(model: Mapping[str, DataFrame], child: str, column: str, parent: str) -> DataFrame:
    """Rows of ``child`` that refer to nothing. NULL refers to nothing on purpose and is none of them."""
    return model[child].dropna(subset=[column]).join(model[parent].select(column), column, "left_anti")


def unknown_keys(model: Mapping[str, DataFrame]) -> DataFrame:
    """Rows that refer to nothing: (table_name, column_name, key_value, n_rows).

    Their codes are well formed but not in the parent table, so no result that
    starts from the parent can show them.
    """
    return reduce(
        DataFrame.unionByName,
        [
            _without_parent(model, child, column, parent)
            .groupBy(
                F.lit(child).alias("table_name"),
                F.lit(column).alias("column_name"),
                F.col(column).alias("key_value"),
            )
            .agg(F.count(F.lit(1)).alias("n_rows"))
            for child, column, parent in REFERENCES
        ],
    )


def check_model(model: Mapping[str, DataFrame]) -> DataFrame:
    """One row per rule: (table_name, rule, n_violations)."""

    def tally(table: str, rule: str, violations: DataFrame) -> DataFrame:
        return violations.agg(F.count(F.lit(1)).alias("n_violations")).select(
            F.lit(table).alias("table_name"), F.lit(rule).alias("rule"), "n_violations"
        )

    keys = [
        tally(t, f"key {','.join(_keys(model, t))}", check_key(model[t], _keys(model, t))) for t in KEYS
    ]
    references = [
        tally(
            child,
            f"{column} in {parent}",
            _without_parent(model, child, column, parent).select(column).distinct(),
        )
        for child, column, parent in REFERENCES
    ]
    forms = [
        tally(
            t, "3NF", check_normal_forms(model[t], KEYS[t], attributes).where("breaks is not null")
        )
        for t, attributes in NORMAL_FORMS.items()
    ]
    return reduce(DataFrame.unionByName, keys + references + forms)
