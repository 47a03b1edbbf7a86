"""Raw registers to model tables.

``build_model`` takes four all-text registers whose columns were renamed with
``project`` to the names below, and returns the tables of the model, lazily.

=============  ==============================================================
register       columns
=============  ==============================================================
codes          prov_code, prov_name, dep_code, dep_name
population     prov_code, dep_code, persons, and band if it is given per band
schools        school_code, prov_code, dep_code, one flag column per level
libraries      lib_code, prov_code, dep_code, founded, email
=============  ==============================================================

A register may also have prov_name and dep_name, by which ``recover_codes`` places rows without codes.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from comarca.functions import compose_id, normalize_text, standardize_id
from comarca.operators.cleaning import null_drop, null_sentinel, since_tally, unify
from comarca.operators.modelling import bridge, dedup_rows, dim_by_key
from comarca.operators.placement import place_rows
from comarca.sources import CORRUPT, register_model, write_model

PROV_WIDTH = 2
DEP_WIDTH = 3
# Texts that stand for "unknown" in a register.
SENTINELS = ("", "-", "S/D", "s/d")
DATE_FORMATS = ("yyyy-MM-dd", "dd/MM/yyyy")


def _clean(
    register: DataFrame, prov_width: int, dep_width: int, sentinels: Sequence[str], but: Sequence[str] = ()
) -> DataFrame:
    """Placeholders to NULL, except in columns ``but``, and the two codes to one department id.

    Rows whose codes cannot be standardised keep a NULL ``dep_id``.
    """
    prov = standardize_id(F.col("prov_code"), prov_width)
    dep = standardize_id(F.col("dep_code"), dep_width)
    return (
        null_sentinel(register, [c for c in register.columns if c not in but], sentinels)
        .withColumns({"prov_id": prov, "dep_id": compose_id(prov, dep)})
        .drop("prov_code", "dep_code")
    )


def build_model(
    registers: Mapping[str, DataFrame],
    levels: Mapping[str, str],
    prov_width: int = PROV_WIDTH,
    dep_width: int = DEP_WIDTH,
    sentinels: Sequence[str] = SENTINELS,
    date_formats: Sequence[str] = DATE_FORMATS,
) -> dict[str, DataFrame]:
    """The model tables by name; ``levels`` maps a flag column to its level name.

    Every key is there once: a department has its most frequent name, a school or library
    that is registered again counts once. Census rows that are equal in all columns of the register
    are one, and the others of a department (and band) are added up. A row needs its department to be
    used, a library at least its province; ``losses`` counts the others.
    """
    registers = dict(registers, population=registers["population"].drop(CORRUPT).distinct())
    clean = {
        name: _clean(df.drop(CORRUPT), prov_width, dep_width, sentinels)
        for name, df in registers.items()
    }
    codes = null_drop(clean["codes"], ["dep_id"]).withColumns(
        {"prov_name": normalize_text(F.col("prov_name")), "dep_name": normalize_text(F.col("dep_name"))}
    )
    schools = null_drop(clean["schools"], ["school_code", "dep_id"]).withColumnRenamed(
        "school_code", "school_id"
    )
    libraries = null_drop(clean["libraries"], ["lib_code", "prov_id"])
    school_levels = bridge(schools, "school_id", levels, "level_id").distinct()
    population = unify(null_drop(clean["population"], ["dep_id"]), {"persons": "bigint"})
    grain = [c for c in ("dep_id", "band") if c in population.columns]
    libraries = unify(libraries, {"founded": date_formats}).select(
        F.col("lib_code").alias("lib_id"), "dep_id", "prov_id", "founded", "email"
    )
    return {
        "provinces": dim_by_key(codes, "prov_id", ["prov_name"]),
        "departments": dim_by_key(codes, "dep_id", ["dep_name", "prov_id"]),
        "levels": schools.sparkSession.createDataFrame(
            [(name,) for name in levels.values()], "level_id string"
        ),
        "schools": dedup_rows(schools.select("school_id", "dep_id"), ["school_id"]),
        "school_levels": school_levels,
        "libraries": dedup_rows(libraries, ["lib_id"]),
        "population": population.groupBy(*grain).agg(F.sum("persons").alias("persons")),
    }


def recover_codes(
    registers: Mapping[str, DataFrame],
    prov_width: int = PROV_WIDTH,
    dep_width: int = DEP_WIDTH,
    sentinels: Sequence[str] = SENTINELS,
) -> tuple[dict[str, DataFrame], DataFrame]:
    """The registers with codes for rows that only name their place, and (register, outcome, n_rows).

    A register with a column ``dep_name``, and maybe ``prov_name``, has codes that cannot be read filled from
    the names: first the province, then the department among those of its province (see ``place_names``;
    what is ambiguous or unknown keeps its codes as received). The name columns go. ``outcome`` is that of the
    department: ``given`` if it could be read. Other registers, and the codes, come back as they are.
    """
    codes = _clean(registers["codes"].drop(CORRUPT), prov_width, dep_width, sentinels)
    provinces = dim_by_key(codes.dropna(subset=["prov_id", "prov_name"]), "prov_id", ["prov_name"])
    places = dim_by_key(codes.dropna(subset=["dep_id", "dep_name"]), "dep_id", ["dep_name", "prov_id"])
    recovered, parts = dict(registers), []
    for name, register in registers.items():
        if name == "codes" or "dep_name" not in register.columns:
            continue
        prov = standardize_id(F.col("prov_code"), prov_width)
        dep = compose_id(prov, standardize_id(F.col("dep_code"), dep_width))
        names = [c for c in ("prov_name", "dep_name") if c in register.columns]
        rows = null_sentinel(register.withColumns({"prov_id": prov, "dep_id": dep}), names, sentinels)
        if "prov_name" in names:
            rows = place_rows(rows, provinces, "prov_name", "prov_id").drop("outcome")
        rows = place_rows(rows, places, "dep_name", "dep_id", within="prov_id")
        parts.append(rows.groupBy("outcome").agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("register"), "outcome", "n_rows"))
        recovered[name] = rows.withColumns(
            {
                "prov_code": F.coalesce("prov_id", "prov_code"),
                "dep_code": F.coalesce(F.substring("dep_id", prov_width + 1, dep_width), "dep_code"),
            }
        ).select(*[c for c in register.columns if c not in names])
    if not parts:
        return recovered, registers["codes"].sparkSession.createDataFrame([], "register string, outcome string, n_rows bigint")
    return recovered, reduce(DataFrame.unionByName, parts)


def losses(
    registers: Mapping[str, DataFrame],
    prov_width: int = PROV_WIDTH,
    dep_width: int = DEP_WIDTH,
    sentinels: Sequence[str] = SENTINELS,
    date_formats: Sequence[str] = DATE_FORMATS,
) -> DataFrame:
    """(register, reason, n_rows): what became of every row; a register's rows add up to all it has.

    ``corrupt`` rows did not fit the file's columns (they keep what could be read, and are
    used if that is enough). Of the others those without a ``missing code`` or department are left out
    (``unplaced``; a library has its province at least, ``province only``, and is in the model).
    Rows of an ``unknown department`` cannot show in any result, however often they are there. Of those that can,
    ``duplicate`` rows say again what a row that is used says, and in ``conflict`` with it is another row
    of the same school or library. An ``unreadable`` number or date is NULL. The rest is ``placed``.

    Rows that say the same are counted before they meet, so a key costs as many rows as it has
    different ones.
    """
    codes = _clean(registers["codes"], prov_width, dep_width, sentinels)
    known = codes.dropna(subset=["dep_id"]).select("dep_id").distinct().withColumn("known", F.lit(True))
    typed = {"population": {"persons": "bigint"}, "libraries": {"founded": date_formats}}
    own_code = {"schools": "school_code", "libraries": "lib_code"}
    # The model takes a key's smallest row by these; every row of the codes is a vote for a name.
    told_apart = {"schools": ["dep_id"], "libraries": ["dep_id", "prov_id", "founded", "email"]}
    parts = []
    for name, register in registers.items():
        as_received = [c for c in register.columns if c != CORRUPT]
        rows = register.withColumn("_received", F.struct(*as_received)) if name == "population" else register
        rows = _clean(rows, prov_width, dep_width, sentinels, ["_received"])
        corrupt = F.col(CORRUPT).isNotNull() if CORRUPT in rows.columns else F.lit(False)
        unreadable = F.lit(False)
        rows = rows.withColumn("_corrupt", corrupt)
        for column, target in typed.get(name, {}).items():
            rows = unify(rows.withColumn("_given", F.col(column)), {column: target})
            unreadable = F.col("_given").isNotNull() & F.col(column).isNull()
        code = F.col(own_code[name]).isNull() if name in own_code else F.lit(False)
        place = F.coalesce("dep_id", "prov_id") if name == "libraries" else F.col("dep_id")
        left_out = (
            F.when(F.col("_corrupt"), "corrupt")
            .when(code, "missing code")
            .when(place.isNull(), "unplaced")
        )
        rows = rows.withColumns({"_left_out": left_out, "_unreadable": unreadable})
        gone = rows.where("_left_out is not null").groupBy(F.col("_left_out").alias("reason")).agg(F.count(F.lit(1)).alias("n_rows"))
        used = rows.where("_left_out is null")
        if name == "codes":
            settled = used.groupBy("dep_id", "_unreadable").agg(F.count(F.lit(1)).alias("_placed")).withColumns(
                {"_duplicate": F.lit(0).cast("bigint"), "_conflict": F.lit(0).cast("bigint")}
            )
        else:
            key, apart = own_code.get(name, "_received"), told_apart.get(name, ["dep_id"])
            said = used.groupBy(key, *apart, "_unreadable").agg(F.count(F.lit(1)).alias("_n"))
            taken = said.groupBy(key).agg(
                F.min(F.struct(*apart, "_unreadable", "_n")).alias("_taken"), F.sum("_n").alias("_all")
            )
            settled = taken.select(
                "_taken.dep_id",
                "_taken._unreadable",
                F.lit(1).cast("bigint").alias("_placed"),
                (F.col("_taken._n") - 1).alias("_duplicate"),
                (F.col("_all") - F.col("_taken._n")).alias("_conflict"),
            )
        summed = settled.groupBy("dep_id", "_unreadable").agg(
            *[F.sum(c).alias(c) for c in ("_placed", "_duplicate", "_conflict")]
        )
        fate = (
            F.when(F.col("dep_id").isNull(), "province only")
            .when(F.col("known").isNull(), "unknown department")
            .when(F.col("_unreadable"), "unreadable")
            .otherwise("placed")
        )
        lost = F.when(F.col("dep_id").isNotNull() & F.col("known").isNull(), F.lit("unknown department"))
        fates = [
            F.struct(fate.alias("reason"), F.col("_placed").alias("n_rows")),
            F.struct(F.coalesce(lost, F.lit("duplicate")).alias("reason"), F.col("_duplicate").alias("n_rows")),
            F.struct(F.coalesce(lost, F.lit("conflict")).alias("reason"), F.col("_conflict").alias("n_rows")),
        ]
        kept = summed.join(known, "dep_id", "left").select(F.inline(F.array(*fates)))
        counted = gone.unionByName(kept).groupBy("reason").agg(F.sum("n_rows").alias("n_rows")).where("n_rows > 0")
        parts.append(counted.select(F.lit(name).alias("register"), "reason", "n_rows"))
    return reduce(DataFrame.unionByName, parts)


def unplaced(
    registers: Mapping[str, DataFrame],
    prov_width: int = PROV_WIDTH,
    dep_width: int = DEP_WIDTH,
    sentinels: Sequence[str] = SENTINELS,
) -> DataFrame:
    """(register, n_rows, n_unplaced): what ``build_model`` could not give a department."""
    parts = [
        _clean(df, prov_width, dep_width, sentinels).agg(
            F.lit(name).alias("register"),
            F.count(F.lit(1)).alias("n_rows"),
            F.count_if(F.col("dep_id").isNull()).alias("n_unplaced"),
        )
        for name, df in registers.items()
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def founding_dates(
    registers: Mapping[str, DataFrame],
    since: int,
    sentinels: Sequence[str] = SENTINELS,
    date_formats: Sequence[str] = DATE_FORMATS,
) -> DataFrame:
    """One row: libraries founded since a year, before, at no readable date, at none given."""
    given = null_sentinel(registers["libraries"], ["founded"], sentinels).withColumn(
        "as_received", F.col("founded")
    )
    return since_tally(unify(given, {"founded": date_formats}), "as_received", "founded", since)


def store_model(
    spark: SparkSession, model: Mapping[str, DataFrame], directory: str, prefix: str = ""
) -> dict[str, DataFrame]:
    """Write every table as Parquet and CSV, register it for ``spark.sql``, give it back."""
    stored = {name: write_model(df, directory, name) for name, df in model.items()}
    register_model(spark, directory, {name: df.schema for name, df in model.items()}, prefix)
    return stored
