"""

``comarca.plans.roles`` says which driver table plays which part. Every query
runs over its whole tables.
"""

from __future__ import annotations

import importlib.util
from collections.abc import Callable
from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from comarca.functions import (
    compose_id,
    email_domain,
    founding_year,
    normalize_text,
    per_thousand,
    regex_clean,
    standardize_id,
)
from comarca.operators import cleaning, departments, discovery, distribution, formats, joins, mail, modelling
from comarca.operators import placement, refresh, relationship, selection, synthesis
from comarca.plans import checks, model, roles
from comarca.sources import CORRUPT, SCHEMAS, register_model, scan_csv, store, table
from comarca.sources import work_folder, write_model
from comarca.functions.text import ACCENTED, MARKS, PLAIN, SPACES
from comarca.sources.csv import CSV_OPTIONS

PROV_WIDTH = 2
DEP_WIDTH = 12


# Sources and sinks


def q_scan_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole document texts, with quotes and line breaks, through a CSV register."""
    path = f"{work_folder(spark)}/documents.csv"
    register = table(spark, sf_dir, "documents")
    register.write.options(**CSV_OPTIONS).option("maxRecordsPerFile", 100_000).csv(path)
    register = scan_csv(spark, path, SCHEMAS["documents"], multi_line=True)
    return register.withColumn("is_corrupt", F.col(CORRUPT).isNotNull()).drop(CORRUPT)


def q_scan_csv_latin1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A register as many offices hand it out: semicolons between values, one byte per letter."""
    path = f"{work_folder(spark)}/customer.csv"
    name = F.concat(F.lit("Ñandú; "), F.col("c_name"))
    register = table(spark, sf_dir, "customer").withColumn("c_name", name)
    register.write.options(**CSV_OPTIONS, sep=";", encoding="ISO-8859-1").csv(path)
    return scan_csv(spark, path, SCHEMAS["customer"], separator=";", encoding="ISO-8859-1").drop(CORRUPT)


def q_sink_model_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All columns of a table as they come back from the CSV copy: dates, empty texts and NULLs."""
    folder = work_folder(spark)
    number = F.col("o_orderkey")
    status = F.when(number % 7 == 0, "").when(number % 11 != 0, F.col("o_orderstatus"))
    orders = table(spark, sf_dir, "orders").withColumn("o_orderstatus", status)
    write_model(orders, folder, "schools")
    back = scan_csv(spark, f"{folder}/schools.csv", SCHEMAS["orders"]).drop(CORRUPT)
    return back.withColumn("o_orderdate", F.col("o_orderdate").cast("string"))


def q_register_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_model(spark, sf_dir, SCHEMAS, prefix="driver_")
    return spark.sql(
        " union all ".join(
            f"select '{t}' as table_name, count(*) as n_rows from driver_{t}" for t in SCHEMAS
        )
    )


def q_build_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registers as CSV -> cleaned model as Parquet and CSV -> a question in SQL."""
    folder = work_folder(spark)
    registers = {}
    for name, df in roles.raw_registers(spark, sf_dir).items():
        path = f"{folder}/raw/{name}.csv"
        df.write.options(**CSV_OPTIONS).csv(path)
        registers[name] = scan_csv(spark, path, df.schema).drop(CORRUPT)
    tables = model.build_model(registers, roles.LEVELS, PROV_WIDTH, DEP_WIDTH)
    model.store_model(spark, tables, f"{folder}/model", prefix="model_")
    return spark.sql(
        """
        select d.prov_id, p.prov_name, d.dep_id, d.dep_name,
               coalesce(w.persons, 0) as persons,
               coalesce(s.schools, 0) as schools,
               coalesce(s.unknown_level, 0) as unknown_level,
               coalesce(l.libraries, 0) as libraries,
               coalesce(l.libraries_since, 0) as libraries_since
        from model_departments d
        join model_provinces p on p.prov_id = d.prov_id
        left join (select dep_id, sum(persons) as persons
                   from model_population group by dep_id) w on w.dep_id = d.dep_id
        left join (select dep_id, count(*) as schools,
                          count_if(level_id = '4-NOT SPECIFIED') as unknown_level
                   from model_schools left join
                        (select * from model_school_levels where level_id = '4-NOT SPECIFIED')
                        using (school_id)
                   group by dep_id) s on s.dep_id = d.dep_id
        left join (select dep_id, count(*) as libraries,
                          count_if(founded >= date'1998-01-01') as libraries_since
                   from model_libraries group by dep_id) l on l.dep_id = d.dep_id
        """
    )


def q_check_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys, references and normal forms of the model built from all registers.

    The rules read the tables many times, so these are stored first.
    """
    folder = work_folder(spark)
    registers = roles.raw_registers(spark, sf_dir)
    tables = model.build_model(registers, roles.LEVELS, PROV_WIDTH, DEP_WIDTH)
    return checks.check_model({name: store(df, folder, name) for name, df in tables.items()})


def q_check_faulty_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.check_model(roles.faulty_model(spark, sf_dir))


def q_model_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of every row of registers with planted faults."""
    registers = roles.faulty_registers(spark, sf_dir)
    return model.losses(registers, PROV_WIDTH, DEP_WIDTH)


def q_build_faulty_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The integrated table out of registers with planted faults: every key once, nothing doubled."""
    registers = roles.faulty_registers(spark, sf_dir)
    tables = model.build_model(registers, roles.LEVELS, PROV_WIDTH, DEP_WIDTH)
    return departments.integrate(
        tables["departments"],
        tables["population"],
        departments.as_facts(tables["schools"], "schools"),
        departments.as_facts(tables["libraries"], "libraries"),
    )


# Projection, filter, cleaning


def q_project_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roles.departments(spark, sf_dir)


def q_normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", normalize_text(F.col("text")).alias("name")
    )


def q_unify_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Padded numbers, amounts and two date formats, from text to types."""
    iso, local = F.date_format("o_orderdate", "yyyy-MM-dd"), F.date_format("o_orderdate", "dd/MM/yyyy")
    raw = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.concat(F.lit(" 0"), F.col("o_custkey").cast("string")).alias("dep_code"),
        F.when(F.col("o_orderstatus") == "O", local)
        .when(F.col("o_orderstatus") == "F", iso)
        .otherwise("not yet")
        .alias("founded"),
        F.when(F.col("o_orderstatus") == "P", F.col("o_orderpriority"))
        .otherwise(F.concat(F.lit("+"), F.col("o_orderkey").cast("string")))
        .alias("staff"),
    )
    typed = cleaning.unify(
        raw, {"dep_code": "bigint", "founded": ["yyyy-MM-dd", "dd/MM/yyyy"], "staff": "bigint"}
    )
    return typed.withColumn("founded", F.col("founded").cast("string"))


def _levels_with_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = roles.schools(spark, sf_dir).drop("schools")
    return cleaning.null_sentinel(rows, ["level_id"], [roles.UNKNOWN_LEVEL])


def q_null_sentinel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _levels_with_null(spark, sf_dir)


def q_null_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.null_fill(_levels_with_null(spark, sf_dir), {"level_id": "unknown"})


def q_null_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.null_drop(_levels_with_null(spark, sf_dir), ["level_id"])


def q_null_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.null_profile(_levels_with_null(spark, sf_dir))


def q_standardize_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed-width codes; province codes above 9 do not fit width 1 and become NULL."""
    prov = standardize_id(F.col("c_nationkey"), PROV_WIDTH)
    dep = standardize_id(F.col("c_custkey"), DEP_WIDTH)
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        prov.alias("prov_code"),
        compose_id(prov, dep).alias("dep_code"),
        standardize_id(F.col("c_nationkey"), 1).alias("short_code"),
    )


def q_place_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part's product by its name, with misspelt, cut, missing and ambiguous names among them."""
    rows, products = roles.misspelt_products(spark, sf_dir)
    return placement.place_rows(rows, products, "p_name", "product").select("p_partkey", "product", "outcome")


def q_place_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each different name stands for, and how many edits away."""
    rows, products = roles.misspelt_products(spark, sf_dir)
    return placement.place_names(rows, products, "p_name", "product")


def q_regex_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        "c_custkey", regex_clean(F.col("c_name"), "^Customer#0*").alias("dep_name")
    )


def q_filter_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cleaning.filter_since(table(spark, sf_dir, "lineitem"), "l_shipdate", roles.SINCE_YEAR)
    return rows.select(
        "l_orderkey", "l_linenumber", "l_partkey", founding_year(F.col("l_shipdate")).alias("year")
    )


# Relational modelling


def q_dim_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modelling.dim_extract(roles.schools(spark, sf_dir), ["level_id"])


def q_dedup_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag"
    )
    return modelling.dedup_rows(lines, ["l_orderkey", "l_linenumber"])


def q_dim_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modelling.dim_by_key(table(spark, sf_dir, "part"), "p_brand", ["p_type", "p_size"])


def q_key_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modelling.key_variants(table(spark, sf_dir, "part"), "p_brand", ["p_type", "p_size"])


def q_bridge_school_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("school_id"),
        *[
            F.when(F.col("o_orderpriority") == value, "X").alias(name)
            for name, value in roles.LEVELS.items()
        ],
        F.when(F.col("o_orderstatus") == "F", "1").otherwise("0").alias("adults"),
    )
    return modelling.bridge(wide, "school_id", roles.LEVELS | {"adults": "ADULTS"}, "level_id")


def q_check_1nf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modelling.check_1nf(
        table(spark, sf_dir, "part"), ["p_partkey"], ["p_name", "p_type"], " "
    )


def q_check_candidate_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modelling.check_key(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


def q_check_fd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modelling.check_fd(table(spark, sf_dir, "part"), ["p_brand"], ["p_type"])


def q_check_normal_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flat department table: its province name hangs on the province, not on the key."""
    flat = joins.with_geo(roles.departments(spark, sf_dir), roles.provinces(spark, sf_dir))
    report = modelling.check_normal_forms(
        flat, ["dep_id", "prov_id"], ["dep_name", "prov_name"]
    )
    return report.withColumn("breaks", F.coalesce("breaks", F.lit("none")))


def q_check_foreign_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modelling.check_foreign_key(
        table(spark, sf_dir, "lineitem"), "l_orderkey", table(spark, sf_dir, "orders"), "o_orderkey"
    )


# Driver tables and the columns that may refer to one another.
KEY_COLUMNS = {
    "region": ["r_regionkey"],
    "nation": ["n_nationkey", "n_regionkey"],
    "customer": ["c_custkey", "c_nationkey"],
    "orders": ["o_orderkey", "o_custkey"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"],
}


def q_discover_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which key columns of five tables refer to which, without being told."""
    tables = {t: table(spark, sf_dir, t) for t in KEY_COLUMNS}
    return discovery.discover_references(tables, KEY_COLUMNS)


def q_discover_broken_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References that hold for nine in ten values or more, as in a register with wrong codes."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_orderkey") % 20 == 0, -F.col("l_orderkey")).otherwise(F.col("l_orderkey")).alias("l_orderkey"),
        F.when(F.col("l_partkey") % 5 == 0, -F.col("l_partkey")).otherwise(F.col("l_partkey")).alias("l_partkey"),
    )
    tables = {"orders": table(spark, sf_dir, "orders"), "part": table(spark, sf_dir, "part"), "lines": lines}
    columns = {"orders": ["o_orderkey"], "part": ["p_partkey"], "lines": ["l_orderkey", "l_partkey"]}
    return discovery.discover_references(tables, columns, 0.9)


RULE_TABLES = {"part": 3, "lineitem": 3}


def q_discover_rules_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.discover_rules(table(spark, sf_dir, "part"), largest=RULE_TABLES["part"]).frame(spark)


def q_discover_rules_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.discover_rules(table(spark, sf_dir, "lineitem"), largest=RULE_TABLES["lineitem"]).frame(spark)


def _flat_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with the names of their nation and region in every row."""
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    placed = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    placed = placed.join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return placed.select("c_custkey", "c_name", "n_nationkey", "n_name", "r_regionkey", "r_name")


def _synthesized(spark: SparkSession, sf_dir: str) -> tuple[list[synthesis.Table], dict[str, DataFrame]]:
    flat = store(_flat_customers(spark, sf_dir), work_folder(spark), "flat")
    tables = synthesis.synthesize(discovery.discover_rules(flat, largest=2))
    return tables, synthesis.decompose(flat, tables)


def q_synthesized_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables a flat one comes apart into, with their rows: customers, nations and regions again."""
    tables, parts = _synthesized(spark, sf_dir)
    counted = [
        part.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(name).alias("table_name"), F.lit(",".join(t.columns)).alias("column_names"), "n_rows"
        )
        for t, (name, part) in zip(tables, parts.items())
    ]
    return reduce(DataFrame.unionByName, counted)


def q_recombined_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The proof that nothing is lost: the joined tables are the flat one."""
    tables, parts = _synthesized(spark, sf_dir)
    return synthesis.recombine(parts, tables).select("c_custkey", "c_name", "n_nationkey", "n_name", "r_regionkey", "r_name")


# Joins


def q_join_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = table(spark, sf_dir, "region")
    nation = table(spark, sf_dir, "nation")
    prov = nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.col("n_nationkey").alias("prov_id"),
        F.col("n_name").alias("prov_name"),
        F.col("r_name").alias("region_name"),
    )
    return joins.with_geo(roles.departments(spark, sf_dir), prov)


def _integrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return departments.integrate(roles.departments(spark, sf_dir), roles.facts(spark, sf_dir))


def q_integrate_departments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _integrated(spark, sf_dir)


# Aggregations


def q_population_by_department(spark: SparkSession, sf_dir: str) -> DataFrame:
    return departments.population(roles.population(spark, sf_dir))


def q_schools_by_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return departments.schools_by_level(roles.schools(spark, sf_dir), roles.LEVELS)


def q_summary_population_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = roles.facts(spark, sf_dir)
    return departments.summary(roles.departments(spark, sf_dir), rows, rows, roles.LEVELS)


def q_summary_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Country, provinces, levels, and levels of each province, out of one scan of each table."""
    rows = roles.facts(spark, sf_dir).withColumn("level_schools", F.col("schools"))
    return departments.totals(roles.departments(spark, sf_dir), rows)


_REFRESHED = ["schools", "cents"]


def _order_facts(orders: DataFrame) -> DataFrame:
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    return orders.select(
        "o_orderkey", F.col("o_custkey").alias("dep_id"), F.lit(1).cast("bigint").alias("schools"), cents.alias("cents")
    )


def _earlier_state(spark: SparkSession, sf_dir: str) -> refresh.State:
    """What was kept of the delivery before, written and read again."""
    earlier = roles.earlier_orders(spark, sf_dir)
    state = refresh.first_state(earlier, "o_orderkey", ["dep_id"], _REFRESHED, _order_facts)
    return refresh.store_state(state, work_folder(spark), "earlier")


def q_refresh_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of an earlier delivery brought up to this one: those a rebuild would give."""
    orders, folder = table(spark, sf_dir, "orders"), work_folder(spark)
    state = refresh.refresh(
        _earlier_state(spark, sf_dir), orders, "o_orderkey", ["dep_id"], _REFRESHED, _order_facts,
        keep=lambda name, df: store(df, folder, name),
    )
    return state.sums.drop("n_facts")


def q_refresh_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that are new, changed or withdrawn since the earlier delivery."""
    marks = refresh.fingerprints(table(spark, sf_dir, "orders"), "o_orderkey")
    return refresh.changed_keys(_earlier_state(spark, sf_dir), marks, "o_orderkey")


def q_libraries_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    return departments.libraries_since(
        roles.departments(spark, sf_dir).select("dep_id"),
        roles.libraries(spark, sf_dir, since=roles.SINCE_YEAR),
    )


def q_domain_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mail.domain_frequency(mail.library_domains(roles.mail(spark, sf_dir), "lib_id", "email"))


def q_bars_libraries_province(spark: SparkSession, sf_dir: str) -> DataFrame:
    return departments.libraries_per_province(
        roles.provinces(spark, sf_dir),
        roles.departments(spark, sf_dir),
        roles.libraries(spark, sf_dir),
    )


def q_scatter_schools_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    return departments.scatter(roles.departments(spark, sf_dir), roles.facts(spark, sf_dir))


def q_rank_provinces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return departments.rank_provinces(q_bars_libraries_province(spark, sf_dir))


def q_schools_per_department(spark: SparkSession, sf_dir: str) -> DataFrame:
    return departments.schools_per_department(
        roles.departments(spark, sf_dir), roles.schools(spark, sf_dir)
    )


# Ranking, distribution


def q_top_email_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mail.top_domain(mail.library_domains(roles.mail(spark, sf_dir), "lib_id", "email"))


def q_top_domain_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    domains = mail.library_domains(roles.mail(spark, sf_dir), "lib_id", "email", "lang")
    return mail.top_domain_per_group(domains, "lang")


def q_boxplot_quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distribution.quartiles(q_schools_per_department(spark, sf_dir), "prov_id", "schools")


def q_boxplot_whiskers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distribution.whiskers(q_schools_per_department(spark, sf_dir), "prov_id", "schools")


def q_boxplot_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = q_schools_per_department(spark, sf_dir)
    return distribution.outliers(counts, "prov_id", "schools")


def _province_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = per_thousand(F.col("schools"), F.col("persons"))
    return _integrated(spark, sf_dir).select("prov_id", "dep_id", rate.alias("schools_per_1000"))


def q_rate_quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The box of schools per 1000 inhabitants, a real value of its own for almost every department."""
    boxes = selection.value_quartiles(_province_rates(spark, sf_dir), "prov_id", "schools_per_1000")
    return _rounded(boxes, "q1", "median", "q3")


def q_rate_whiskers(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = selection.value_whiskers(_province_rates(spark, sf_dir), "prov_id", "schools_per_1000")
    return _rounded(ends, "low", "high")


def q_rate_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    beyond = selection.value_outliers(_province_rates(spark, sf_dir), "prov_id", "schools_per_1000")
    return _rounded(beyond, "schools_per_1000")


def q_price_quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The box of line prices per return flag: three groups, each far larger than a task."""
    boxes = selection.value_quartiles(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice")
    return _rounded(boxes, "q1", "median", "q3")


# Scalar functions, relationship


def q_email_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", email_domain(F.col("text")).alias("domain")
    )


def q_founding_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", founding_year(F.col("o_orderdate")).alias("year")
    )


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    """Last digits of logarithms and sums of doubles differ between engines."""
    return df.withColumns({n: F.round(n, 6) for n in names})


def q_per_thousand(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = relationship.rates(_integrated(spark, sf_dir))
    return _rounded(rates, "schools_per_1000", "libraries_per_1000")


def q_log10_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(
        relationship.log_rates(_integrated(spark, sf_dir)), "log_schools", "log_libraries"
    )


def q_loglog_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(
        relationship.loglog_points(_integrated(spark, sf_dir)), "log_schools", "log_libraries"
    )


def q_loglog_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relationship.loglog_excluded(_integrated(spark, sf_dir))


def q_relationship_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(
        relationship.relationship_corr(_integrated(spark, sf_dir), "schools", "libraries"), "r"
    )


def q_loglog_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = relationship.loglog_points(_integrated(spark, sf_dir))
    return _rounded(relationship.loglog_fit(points), "slope", "intercept", "r2")


def q_relationship_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(
        relationship.relationship_spearman(_integrated(spark, sf_dir), "schools", "libraries"), "rho"
    )


def q_relationship_kendall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(
        relationship.relationship_kendall(_integrated(spark, sf_dir), "schools", "libraries"), "tau"
    )


def q_relationship_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = relationship.log_rates(_integrated(spark, sf_dir))
    found = relationship.relationship_interval(points, "dep_id", "log_schools", "log_libraries")
    return _rounded(found, "low", "high")


def _as_received(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Two registers with dates in several formats and placeholders among them."""
    key, day = F.col("o_orderkey"), F.col("o_orderdate")
    founded = (
        F.when(key % 50 == 0, "s/d").when(key % 3 == 0, F.date_format(day, "dd/MM/yyyy"))
        .when(key % 3 == 1, F.date_format(day, "yyyy-MM-dd")).otherwise(F.date_format(day, "yyyy"))
    )
    status = F.when(key % 40 == 0, "N/A").otherwise(F.concat(F.col("o_orderstatus"), F.lit("-"), (key % 7000).cast("string")))
    key, day = F.col("l_orderkey"), F.col("l_shipdate")
    opened = F.when(key % 30 == 0, "99/99/9999").when(key % 2 == 0, F.date_format(day, "yyyy.MM.dd")).otherwise(F.date_format(day, "d/M/yyyy"))
    return {
        "schools": table(spark, sf_dir, "orders").select(founded.alias("founded"), status.alias("code")),
        "libraries": table(spark, sf_dir, "lineitem").select(opened.alias("opened"), F.col("l_returnflag").alias("flag")),
    }


def q_mine_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats and placeholders of the text columns of two registers."""
    found = [
        formats.mine_formats(df, df.columns).select(F.lit(name).alias("register"), "*")
        for name, df in _as_received(spark, sf_dir).items()
    ]
    return reduce(DataFrame.unionByName, found)


def entry(spark: SparkSession) -> DataFrame:
    """The flagship: population, schools and libraries of every department."""
    return q_integrate_departments(spark, "/root/testdata/sf0.001")


def library_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name[2:]: fn for name, fn in globals().items() if name.startswith("q_")}


def _has_llm() -> bool:
    """Whether the optional subpackage and its pipeline are there; if they are, their errors show."""
    return all(importlib.util.find_spec(name) for name in ("comarca.llm", "corpus_pipeline"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = library_queries()
    if _has_llm():
        import corpus_pipeline
        from comarca.llm.queries import queries as llm_queries

        found |= llm_queries() | {"pipeline": corpus_pipeline.run}
    return found


def oracle_sql() -> dict[str, str]:
    found = library_sql()
    if _has_llm():
        import corpus_pipeline
        from comarca.llm.queries import oracle_sql as llm_sql

        found |= llm_sql()
        if corpus_pipeline.ORACLE_SQL:
            found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found


# SQL twins. The departments of lines and orders, written once for all of them.

_LINES = """
lines as (
  select o.o_custkey as dep_id, l.l_quantity, l.l_returnflag, l.l_shipdate
  from lineitem l join orders o on l.l_orderkey = o.o_orderkey
)
"""
_INTEGRATED = f"""
{_LINES},
pop as (select dep_id, cast(sum(cast(l_quantity as bigint)) as bigint) as n from lines group by 1),
sch as (select o_custkey as dep_id, count(*) as n from orders group by 1),
lib as (select dep_id, count(*) as n from lines where l_returnflag = 'R' group by 1),
integrated as (
  select c.c_custkey as dep_id, c.c_name as dep_name, c.c_nationkey as prov_id,
         coalesce(pop.n, 0) as persons, coalesce(sch.n, 0) as schools,
         coalesce(lib.n, 0) as libraries
  from customer c
  left join pop on pop.dep_id = c.c_custkey
  left join sch on sch.dep_id = c.c_custkey
  left join lib on lib.dep_id = c.c_custkey
)
"""
_RATES = f"""
{_INTEGRATED},
rates as (
  select dep_id,
         case when persons > 0 then cast(schools as double) * 1000 / persons end as s,
         case when persons > 0 then cast(libraries as double) * 1000 / persons end as l
  from integrated
),
logs as (
  select dep_id, round(log10(case when s > 0 then s end), 6) as log_schools,
         round(log10(case when l > 0 then l end), 6) as log_libraries
  from rates
)
"""
_COUNTS = """
counts as (
  select c.c_nationkey as prov_id, c.c_custkey as dep_id, count(o.o_orderkey) as schools
  from customer c left join orders o on o.o_custkey = c.c_custkey
  group by 1, 2
)
"""
_FENCES = f"""
{_COUNTS},
box as (
  select prov_id, quantile_cont(schools, 0.25) as q1, quantile_cont(schools, 0.75) as q3
  from counts group by 1
),
fences as (
  select prov_id, q1 - (q3 - q1) * 1.5 as low, q3 + (q3 - q1) * 1.5 as high from box
)
"""
_DOMAINS = """
found as (
  select doc_id, lang,
         unnest(regexp_extract_all(text, '@([A-Za-z0-9.-]+[.][A-Za-z]{2,})', 1)) as domain
  from documents
),
domains as (select distinct doc_id, lang, lower(domain) as domain from found)
"""


def _level_counts(table_alias: str) -> str:
    return ", ".join(
        f"cast(count(*) filter (where {table_alias}.o_orderpriority = '{value}') as bigint) as {name}"
        for name, value in roles.LEVELS.items()
    )


def _fd_sql(form: str, lhs: str, rhs: str) -> str:
    """What the 2NF or 3NF report says on one dependency of the flat department table."""
    return f"""
    select '{lhs}' as lhs, '{rhs}' as rhs, count(*) as n_groups,
           count(*) filter (where n_values > 1) as n_violating,
           count(*) filter (where n_rows > 1) as n_repeated,
           case when count(*) filter (where n_values > 1) = 0
                 and count(*) filter (where n_rows > 1) > 0 then '{form}' else 'none' end as breaks
    from (select {lhs}, count(distinct {rhs}) as n_values, count(*) as n_rows
          from flat group by {lhs})
    """


def _references_sql(columns: dict[str, list[str]], tables: dict[str, str], least_share: float) -> str:
    """Every pair of columns, compared value by value."""
    named = [(t, c) for t in columns for c in columns[t]]
    pairs = [
        f"""
        select '{t}' as child_table, '{c}' as child_column, '{u}' as parent_table, '{d}' as parent_column,
               (select count(distinct {c}) from {tables[t]}) as n_values,
               (select count(distinct {c}) from {tables[t]}
                where {c} not in (select {d} from {tables[u]} where {d} is not null)) as n_missing,
               (select count({d}) = count(distinct {d}) from {tables[u]}) as parent_is_key
        """
        for t, c in named
        for u, d in named
        if (t, c) != (u, d)
    ]
    return f"""select * from ({" union all ".join(pairs)})
               where n_values > 0 and n_values - n_missing >= n_values * {least_share}"""


def _rules_sql(name: str, largest: int) -> str:
    """All sets of columns, grouped one by one, and of what holds the minimal rules."""
    columns = [c.split()[0] for c in SCHEMAS[name].split(", ")]
    sets = []
    for size in range(largest + 1):
        for given in combinations(columns, size):
            others = [c for c in columns if c not in given]
            same = ", ".join(
                f"(min({c}) is not distinct from max({c}) and count({c}) in (0, count(*))) as s_{c}" for c in others
            )
            listed = ", ".join(f"{{'dependent': '{c}', 'holds': bool_and(s_{c})}}" for c in others)
            grouped = f"select count(*) as n, {same} from {name}" + (f" group by {', '.join(given)}" if given else "")
            array = ", ".join(f"'{c}'" for c in given)
            sets.append(f"select [{array}]::varchar[] as x, max(n) = 1 as is_key, [{listed}] as found from ({grouped})")
    return f"""
        with tested as materialized ({" union all ".join(sets)}),
        keys as (
          select x from tested where is_key
            and not exists (select 1 from tested s where s.is_key and len(s.x) < len(tested.x) and list_has_all(tested.x, s.x))
        ),
        held as (
          select x, f.dependent from (select x, unnest(found) as f from tested where not is_key) where f.holds
        )
        select 'key' as kind, array_to_string(x, ',') as determinant, '*' as dependent from keys
        union all
        select 'dependency', array_to_string(x, ','), dependent from held
        where not exists (select 1 from held s where s.dependent = held.dependent
                          and len(s.x) < len(held.x) and list_has_all(held.x, s.x))
    """


_RATE_FENCES = f"""
{_INTEGRATED},
rates as (
  select prov_id, dep_id, case when persons > 0 then cast(schools as double) * 1000 / persons end as rate
  from integrated
),
box as (
  select prov_id, quantile_cont(rate, 0.25) as q1, quantile_cont(rate, 0.5) as median,
         quantile_cont(rate, 0.75) as q3
  from rates where rate is not null group by 1
)
"""
_FLAT = """
select c_custkey, c_name, n_nationkey, n_name, r_regionkey, r_name
from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
"""


# Every name compared to every product. Names have no accents here.
_PLACED = """
written as (
  select p_partkey, case when p_partkey % 23 = 0 then p_partkey end as product,
         p_partkey % length(p_name) + 1 as pos, p_name as n,
         case when p_partkey % 5 = 0 then substr(n, 1, pos - 1) || substr(n, pos + 1)
              when p_partkey % 7 = 0 then substr(n, 1, pos - 1) || 'q' || substr(n, pos + 1)
              when p_partkey % 11 = 0 then 'x' || n || 'x'
              when p_partkey % 13 = 0 then upper(n)
              when p_partkey % 17 = 0 then substr(n, 1, 3)
              when p_partkey % 19 <> 0 then n end as given
  from part
),
received as (
  select p_partkey, product, lower(trim(regexp_replace(given, ' +', ' ', 'g'))) as name from written
),
products as (select lower(p_name) as like_name, min(p_partkey) as product from part group by 1),
names as (
  select name,
         greatest(0, least(2, length(name) // 4, (len(list_distinct([
           substr(chr(1) || name || chr(2), i, 2) for i in range(1, length(name) + 2)])) - 1) // 2 - 1)) as most
  from (select distinct name from received where name <> '')
),
compared as (
  select name, most, products.product, levenshtein(name, like_name) as edits from names, products
),
best as (select name, most, min(edits) as edits, min_by(product, edits) as product from compared group by 1, 2),
rivals as (
  select c.name, count(*) as n from compared c join best b on c.name = b.name and c.edits <= b.edits + 1 group by 1
),
placed as (
  select b.name,
         case when b.edits = 0 then 'equal' when b.edits > b.most then 'unknown'
              when r.n = 1 then 'placed' else 'ambiguous' end as outcome,
         case when outcome in ('equal', 'placed') then b.product end as product,
         case when outcome <> 'unknown' then cast(b.edits as integer) end as edits
  from best b join rivals r on b.name = r.name
)
"""


def library_sql() -> dict[str, str]:
    flat = """
    with flat as (
      select c_custkey as dep_id, c_nationkey as prov_id, c_name as dep_name, n_name as prov_name
      from customer join nation on c_nationkey = n_nationkey
    )
    """
    return {
        "scan_csv": "select doc_id, text, lang, source, n_chars, false as is_corrupt from documents",
        "scan_csv_latin1": """
            select c_custkey, 'Ñandú; ' || c_name as c_name, c_nationkey, c_acctbal, c_mktsegment
            from customer""",
        "sink_model_csv": """
            select o_orderkey, o_custkey, case when o_orderkey % 7 = 0 then ''
                     when o_orderkey % 11 <> 0 then o_orderstatus end as o_orderstatus, o_totalprice,
                   strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') as o_orderdate, o_orderpriority
            from orders""",
        "register_model": " union all ".join(
            f"select '{t}' as table_name, count(*) as n_rows from {t}" for t in SCHEMAS
        ),
        "build_model": f"""
            with {_INTEGRATED},
            unk as (select o_custkey as dep_id, count(*) as n from orders
                    where o_orderpriority = '4-NOT SPECIFIED' group by 1),
            since as (select dep_id, count(*) as n from lines
                      where l_returnflag = 'R' and l_shipdate >= timestamp '1998-01-01' group by 1)
            select lpad(cast(i.prov_id as varchar), 2, '0') as prov_id,
                   lower(n.n_name) as prov_name,
                   lpad(cast(i.prov_id as varchar), 2, '0')
                     || lpad(cast(i.dep_id as varchar), 12, '0') as dep_id,
                   'departamento ' || lower(i.dep_name) as dep_name,
                   i.persons, i.schools, coalesce(unk.n, 0) as unknown_level, i.libraries,
                   coalesce(since.n, 0) as libraries_since
            from integrated i join nation n on n.n_nationkey = i.prov_id
            left join unk on unk.dep_id = i.dep_id
            left join since on since.dep_id = i.dep_id""",
        "place_rows": f"""
            with {_PLACED}
            select r.p_partkey, coalesce(r.product, p.product) as product,
                   case when r.product is not null then 'given' else coalesce(p.outcome, 'no name') end as outcome
            from received r left join placed p on p.name = r.name""",
        "place_names": f"""
            with {_PLACED}
            select name, product, edits, outcome from placed""",
        "summary_totals": f"""
            with {_INTEGRATED},
            leveled as (select c_nationkey as prov_id, o_orderpriority as level_id, count(*) as n
                        from orders join customer on c_custkey = o_custkey group by 1, 2)
            select 'country' as grain, cast(null as integer) as prov_id, cast(null as varchar) as level_id,
                   count(*) as departments, cast(sum(persons) as bigint) as persons,
                   cast(sum(schools) as bigint) as schools, cast(sum(libraries) as bigint) as libraries
            from integrated
            union all
            select 'province', prov_id, null, count(*), cast(sum(persons) as bigint),
                   cast(sum(schools) as bigint), cast(sum(libraries) as bigint)
            from integrated group by prov_id
            union all
            select 'level', null, level_id, null, null, cast(sum(n) as bigint), null from leveled group by level_id
            union all
            select 'province and level', prov_id, level_id, null, null, n, null from leveled""",
        "refresh_sums": """
            select o_custkey as dep_id, count(*) as schools,
                   cast(sum(cast(round(o_totalprice * 100) as bigint)) as bigint) as cents
            from orders group by 1""",
        "refresh_changes": """
            select o_orderkey, case when o_orderkey % 11 = 0 then 'new' else 'changed' end as change
            from orders where o_orderkey % 11 = 0 or o_orderkey % 7 = 0 or o_orderkey % 13 = 0
            union all
            select -1 - o_orderkey, 'withdrawn' from orders where o_orderkey % 5 = 0""",
        "check_faulty_model": """
            with dep as (
              select c_custkey as id, c_name as name,
                     case when c_custkey % 50 = 0 then 99 else c_nationkey end as prov from customer),
            dep2 as (select * from dep union all select * from dep where id % 40 = 0),
            lib as (select l_orderkey as id, l_partkey as dep, l_linenumber as prov from lineitem
                    where l_returnflag = 'R')
            select 'provinces' as table_name, 'key prov_id' as rule, count(*) as n_violations
              from nation where n_nationkey < 3
            union all select 'departments', 'key dep_id', count(*) from dep where id % 40 = 0
            union all select 'levels', 'key level_id', count(*)
              from (select o_orderpriority from (select distinct o_orderpriority from orders)
                    group by 1 having count(*) > 1)
            union all select 'schools', 'key school_id', count(*)
              from (select o_orderkey from orders group by 1 having count(*) > 1)
            union all select 'school_levels', 'key school_id,level_id', count(*)
              from orders where o_orderkey % 79 = 0
            union all select 'libraries', 'key lib_id', count(*)
              from (select id from lib group by 1 having count(*) > 1)
            union all select 'population', 'key dep_id', count(*) from dep where id % 31 = 0
            union all select 'departments', 'prov_id in provinces', count(distinct prov)
              from dep where prov not in (select n_nationkey from nation)
            union all select 'schools', 'dep_id in departments', count(distinct o_orderkey)
              from orders where o_orderkey % 83 = 0
            union all select 'school_levels', 'school_id in schools', count(*)
              from orders where o_orderkey is null
            union all select 'school_levels', 'level_id in levels', count(distinct o_orderpriority)
              from orders where o_orderpriority = '5-LOW'
            union all select 'libraries', 'dep_id in departments', count(distinct dep)
              from lib where dep not in (select id from dep)
            union all select 'libraries', 'prov_id in provinces', count(distinct prov)
              from lib where prov not in (select n_nationkey from nation)
            union all select 'population', 'dep_id in departments', count(*) from dep where id is null
            union all select 'departments', '3NF',
              cast((select count(*) = 0 from (select name from dep2 group by 1
                                              having count(distinct prov) > 1))
                   and (select count(*) > 0 from (select name from dep2 group by 1
                                                  having count(*) > 1)) as bigint)
              + cast((select count(*) = 0 from (select prov from dep2 group by 1
                                                having count(distinct name) > 1))
                     and (select count(*) > 0 from (select prov from dep2 group by 1
                                                    having count(*) > 1)) as bigint)""",
        "model_losses": f"""
            with {_LINES},
            school as (
              select o_orderkey as id, '' as again from orders
              where o_custkey in (select c_custkey from customer)
              union all
              select o_orderkey, 'a' from orders
              where o_custkey in (select c_custkey from customer)
                and o_orderkey % 79 = 0 and o_orderkey % 97 <> 0
              union all
              select o_orderkey, 'b' from orders
              where o_custkey in (select c_custkey from customer)
                and o_orderkey % 73 = 0 and o_orderkey % 97 <> 0 and o_orderkey % 89 <> 0),
            library as (
              select l_partkey as id, row_number() over (partition by l_orderkey, l_linenumber, l_partkey,
                       cast(l_shipdate as date), l_linestatus) as seen
              from lineitem join orders on l_orderkey = o_orderkey
              where l_returnflag = 'R' and o_custkey in (select c_custkey from customer)),
            person as (select distinct dep_id as id from lines join customer on c_custkey = dep_id),
            fate as (
              select 'codes' as register, 'placed' as reason from customer
              union all select 'codes', 'placed' from customer
              union all select 'codes', 'placed' from customer where c_custkey % 10 = 0
              union all select 'population', case when id % 13 = 0 then 'unreadable' else 'placed' end from person
              union all select 'population', 'duplicate' from person where id % 17 = 0
              union all select 'schools', case when id % 97 = 0 then 'missing code'
                  when id % 89 = 0 then 'unplaced'
                  when id % 83 = 0 then 'unknown department'
                  when again = 'a' then 'duplicate' when again = 'b' then 'conflict' else 'placed' end from school
              union all select 'libraries', case when id % 67 = 0 then 'missing code'
                  when seen > 1 then 'duplicate' when id % 61 = 0 then 'province only'
                  when id % 71 = 0 then 'unreadable' else 'placed' end from library)
            select register, reason, count(*) as n_rows from fate group by 1, 2""",
        "build_faulty_model": f"""
            with {_INTEGRATED},
            school as (select o_custkey as dep_id, count(*) as n from orders
                       where o_orderkey % 97 <> 0 and o_orderkey % 89 <> 0 and o_orderkey % 83 <> 0
                       group by 1),
            library as (select o_custkey as dep_id, count(distinct (l_orderkey, l_linenumber, l_partkey)) as n
                        from lineitem join orders on l_orderkey = o_orderkey
                        where l_returnflag = 'R' and l_partkey % 67 <> 0 and l_partkey % 61 <> 0 group by 1)
            select lpad(cast(i.prov_id as varchar), 2, '0')
                     || lpad(cast(i.dep_id as varchar), 12, '0') as dep_id,
                   'departamento ' || lower(i.dep_name) as dep_name,
                   lpad(cast(i.prov_id as varchar), 2, '0') as prov_id,
                   case when i.dep_id % 13 = 0 then 0 else persons end as persons,
                   coalesce(school.n, 0) as schools, coalesce(library.n, 0) as libraries
            from integrated i join nation on n_nationkey = i.prov_id
            left join school on school.dep_id = i.dep_id
            left join library on library.dep_id = i.dep_id""",
        "check_model": """
            with dep as (select c_custkey as id, c_nationkey as prov, c_name as name from customer),
            place as (select o_orderkey as id, o_custkey as dep from orders
                      where o_custkey in (select id from dep)),
            lib as (select l_orderkey, l_linenumber, l_partkey, dep from lineitem
                    join place on l_orderkey = place.id where l_returnflag = 'R'),
            pop as (select distinct dep from lineitem join place on l_orderkey = place.id)
            select 'provinces' as table_name, 'key prov_id' as rule, count(*) as n_violations
              from (select prov from (select distinct prov, n_name from dep
                    join nation on n_nationkey = prov) group by 1 having count(*) > 1)
            union all select 'departments', 'key dep_id', count(*)
              from (select id from (select distinct * from dep) group by 1 having count(*) > 1)
            union all select 'levels', 'key level_id', 0::bigint
            union all select 'schools', 'key school_id', count(*)
              from (select id from place group by 1 having count(*) > 1)
            union all select 'school_levels', 'key school_id,level_id', count(*)
              from (select o_orderkey, o_orderpriority from orders group by 1, 2 having count(*) > 1)
            union all select 'libraries', 'key lib_id', count(*)
              from (select 1 from lib group by l_orderkey, l_linenumber, l_partkey
                    having count(*) > 1)
            union all select 'departments', 'prov_id in provinces', count(distinct prov)
              from dep where prov not in (select n_nationkey from nation)
            union all select 'schools', 'dep_id in departments', count(distinct dep)
              from place where dep not in (select id from dep)
            union all select 'school_levels', 'school_id in schools', count(distinct o_orderkey)
              from orders where o_orderkey not in (select id from place)
            union all select 'school_levels', 'level_id in levels', 0::bigint
            union all select 'libraries', 'dep_id in departments', count(distinct dep)
              from lib where dep not in (select id from dep)
            union all select 'libraries', 'prov_id in provinces', count(distinct prov)
              from lib join dep on dep.id = lib.dep where prov not in (select n_nationkey from nation)
            union all select 'population', 'key dep_id', count(*)
              from (select dep from pop group by 1 having count(*) > 1)
            union all select 'population', 'dep_id in departments', count(distinct dep)
              from pop where dep not in (select id from dep)
            union all select 'departments', '3NF',
              cast((select count(*) = 0 from (select name from dep group by 1
                                              having count(distinct prov) > 1))
                   and (select count(*) > 0 from (select name from dep group by 1
                                                  having count(*) > 1)) as bigint)
              + cast((select count(*) = 0 from (select prov from dep group by 1
                                                having count(distinct name) > 1))
                     and (select count(*) > 0 from (select prov from dep group by 1
                                                    having count(*) > 1)) as bigint)""",
        "project_rename": """
            select c_custkey as dep_id, c_name as dep_name, c_nationkey as prov_id from customer""",
        "normalize_text": f"""
            select doc_id, lower(trim(regexp_replace(
              translate(text, '{ACCENTED + MARKS}', '{PLAIN}'), '[{SPACES}]+', ' ', 'g'))) as name
            from documents""",
        "unify_format": """
            select o_orderkey, o_custkey as dep_code,
                   case when o_orderstatus in ('O', 'F')
                        then strftime(o_orderdate, '%Y-%m-%d') end as founded,
                   case when o_orderstatus <> 'P' then o_orderkey end as staff
            from orders""",
        "null_sentinel": """
            select o_orderkey as school_id, o_custkey as dep_id,
                   nullif(o_orderpriority, '4-NOT SPECIFIED') as level_id from orders""",
        "null_fill": """
            select o_orderkey as school_id, o_custkey as dep_id,
                   coalesce(nullif(o_orderpriority, '4-NOT SPECIFIED'), 'unknown') as level_id
            from orders""",
        "null_drop": """
            select o_orderkey as school_id, o_custkey as dep_id, o_orderpriority as level_id
            from orders where o_orderpriority <> '4-NOT SPECIFIED'""",
        "null_profile": """
            select 'school_id' as column_name, count(*) as n_rows, 0::bigint as n_null from orders
            union all select 'dep_id', count(*), 0::bigint from orders
            union all select 'level_id', count(*),
              count(*) filter (where o_orderpriority = '4-NOT SPECIFIED') from orders""",
        "standardize_id": """
            select c_custkey, lpad(cast(c_nationkey as varchar), 2, '0') as prov_code,
                   lpad(cast(c_nationkey as varchar), 2, '0')
                     || lpad(cast(c_custkey as varchar), 12, '0') as dep_code,
                   case when c_nationkey < 10 then cast(c_nationkey as varchar) end as short_code
            from customer""",
        "regex_clean": """
            select c_custkey, regexp_replace(c_name, '^Customer#0*', '') as dep_name
            from customer""",
        "filter_since": """
            select l_orderkey, l_linenumber, l_partkey, cast(year(l_shipdate) as bigint) as year
            from lineitem where l_shipdate >= timestamp '1998-01-01'""",
        "dim_extract": "select distinct o_orderpriority as level_id from orders",
        "dedup_rows": """
            select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag from lineitem
            qualify row_number() over (partition by l_orderkey, l_linenumber
                                       order by l_partkey, l_suppkey, l_quantity, l_returnflag) = 1""",
        "dim_by_key": """
            with n as (select p_brand, p_type, p_size, count(*) as n from part group by all)
            select p_brand, p_type, p_size from n
            qualify row_number() over (partition by p_brand order by n desc, p_type, p_size) = 1""",
        "key_variants": """
            select p_brand, count(distinct (p_type, p_size)) as n_variants
            from part group by 1 having count(distinct (p_type, p_size)) > 1""",
        "bridge_school_level": """
            select o_orderkey as school_id, o_orderpriority as level_id from orders
            union all select o_orderkey, 'ADULTS' from orders where o_orderstatus = 'F'""",
        "check_1nf": """
            select p_partkey, 'p_name' as column_name,
                   cast(len(string_split(p_name, ' ')) as bigint) as n_values
            from part where len(string_split(p_name, ' ')) > 1
            union all
            select p_partkey, 'p_type', cast(len(string_split(p_type, ' ')) as bigint)
            from part where len(string_split(p_type, ' ')) > 1""",
        "check_candidate_key": """
            select l_orderkey, l_linenumber, count(*) as n_rows
            from lineitem group by 1, 2 having count(*) > 1""",
        "check_fd": """
            select p_brand, count(distinct p_type) as n_values
            from part group by 1 having count(distinct p_type) > 1""",
        "check_normal_forms": flat
        + " union all ".join(
            _fd_sql(form, lhs, rhs)
            for form, lhs, rhs in (
                ("2NF", "dep_id", "dep_name"),
                ("2NF", "dep_id", "prov_name"),
                ("2NF", "prov_id", "dep_name"),
                ("2NF", "prov_id", "prov_name"),
                ("3NF", "dep_name", "prov_name"),
                ("3NF", "prov_name", "dep_name"),
            )
        ),
        "check_foreign_key": """
            select l_orderkey as key_value, 'orphan' as problem, count(*) as n_rows from lineitem
            where l_orderkey not in (select o_orderkey from orders) group by 1
            union all
            select o_orderkey, 'childless', count(*) from orders
            where o_orderkey not in (select l_orderkey from lineitem) group by 1""",
        "join_lookup": """
            select c_nationkey as prov_id, c_custkey as dep_id, c_name as dep_name,
                   n_name as prov_name, r_name as region_name
            from customer join nation on c_nationkey = n_nationkey
            join region on n_regionkey = r_regionkey""",
        "integrate_departments": f"with {_INTEGRATED} select * from integrated",
        "population_by_department": f"""
            with {_LINES}
            select dep_id, cast(sum(cast(l_quantity as bigint)) as bigint) as persons
            from lines group by 1""",
        "schools_by_level": f"""
            select o.o_custkey as dep_id, {_level_counts("o")} from orders o group by 1""",
        "summary_population_levels": f"""
            with {_INTEGRATED},
            lev as (select o.o_custkey as dep_id, {_level_counts("o")} from orders o group by 1)
            select i.dep_id, i.dep_name, i.prov_id, i.persons,
                   {", ".join(f"coalesce(lev.{name}, 0) as {name}" for name in roles.LEVELS)}
            from integrated i left join lev on lev.dep_id = i.dep_id""",
        "libraries_since": f"""
            with {_LINES},
            lib as (select dep_id, count(*) as n from lines
                    where l_returnflag = 'R' and l_shipdate >= timestamp '1998-01-01' group by 1)
            select c_custkey as dep_id, coalesce(n, 0) as libraries
            from customer left join lib on lib.dep_id = c_custkey""",
        "domain_frequency": f"""
            with {_DOMAINS} select domain, count(distinct doc_id) as n from domains group by 1""",
        "rank_provinces": f"""
            with {_INTEGRATED},
            bars as (
              select n_nationkey as prov_id, n_name as prov_name,
                     cast(coalesce(sum(libraries), 0) as bigint) as libraries
              from nation left join integrated i on i.prov_id = n_nationkey group by 1, 2)
            select *, rank() over (order by libraries desc) as place from bars""",
        "bars_libraries_province": f"""
            with {_INTEGRATED}
            select n_nationkey as prov_id, n_name as prov_name,
                   cast(coalesce(sum(libraries), 0) as bigint) as libraries
            from nation left join integrated i on i.prov_id = n_nationkey group by 1, 2""",
        "scatter_schools_population": f"""
            with {_INTEGRATED}
            select o_custkey as dep_id, o_orderpriority as level_id, count(*) as schools,
                   any_value(persons) as persons
            from orders join integrated on dep_id = o_custkey group by 1, 2""",
        "schools_per_department": f"with {_COUNTS} select * from counts",
        "top_email_domain": f"""
            with {_DOMAINS} select domain, count(distinct doc_id) as n from domains
            group by 1 order by n desc, domain limit 1""",
        "top_domain_per_group": f"""
            with {_DOMAINS},
            freq as (select lang, domain, count(distinct doc_id) as n from domains group by 1, 2)
            select lang, domain, n from freq
            qualify row_number() over (partition by lang order by n desc, domain) = 1""",
        "boxplot_quartiles": f"""
            with {_COUNTS}
            select prov_id, quantile_cont(schools, 0.25) as q1, quantile_cont(schools, 0.5) as median,
                   quantile_cont(schools, 0.75) as q3
            from counts group by 1""",
        "boxplot_whiskers": f"""
            with {_FENCES}
            select c.prov_id, min(schools) as low, max(schools) as high
            from counts c join fences f on f.prov_id = c.prov_id
            where schools between f.low and f.high group by 1""",
        "boxplot_outliers": f"""
            with {_FENCES}
            select c.prov_id, dep_id, schools
            from counts c join fences f on f.prov_id = c.prov_id
            where schools < f.low or schools > f.high""",
        "rate_quartiles": f"""
            with {_RATE_FENCES}
            select prov_id, round(q1, 6) as q1, round(median, 6) as median, round(q3, 6) as q3 from box""",
        "rate_whiskers": f"""
            with {_RATE_FENCES}
            select prov_id, round(min(rate), 6) as low, round(max(rate), 6) as high
            from rates join box using (prov_id)
            where rate between q1 - (q3 - q1) * 1.5 and q3 + (q3 - q1) * 1.5 group by 1""",
        "rate_outliers": f"""
            with {_RATE_FENCES}
            select prov_id, dep_id, round(rate, 6) as schools_per_1000
            from rates join box using (prov_id)
            where rate < q1 - (q3 - q1) * 1.5 or rate > q3 + (q3 - q1) * 1.5""",
        "price_quartiles": """
            select l_returnflag, round(quantile_cont(l_extendedprice, 0.25), 6) as q1,
                   round(quantile_cont(l_extendedprice, 0.5), 6) as median,
                   round(quantile_cont(l_extendedprice, 0.75), 6) as q3
            from lineitem group by 1""",
        "discover_references": _references_sql(KEY_COLUMNS, {t: t for t in KEY_COLUMNS}, 1.0),
        "discover_broken_references": _references_sql(
            {"orders": ["o_orderkey"], "part": ["p_partkey"], "lines": ["l_orderkey", "l_partkey"]},
            {"orders": "orders", "part": "part", "lines": """
              (select case when l_orderkey % 20 = 0 then -l_orderkey else l_orderkey end as l_orderkey,
                      case when l_partkey % 5 = 0 then -l_partkey else l_partkey end as l_partkey from lineitem)"""},
            0.9,
        ),
        "discover_rules_part": _rules_sql("part", RULE_TABLES["part"]),
        "discover_rules_lineitem": _rules_sql("lineitem", RULE_TABLES["lineitem"]),
        "synthesized_tables": f"""
            with flat as ({_FLAT})
            select 'c_custkey' as table_name, 'c_custkey,c_name,n_nationkey' as column_names, count(*) as n_rows
              from (select distinct c_custkey, c_name, n_nationkey from flat)
            union all select 'n_nationkey', 'n_nationkey,n_name,r_regionkey', count(*)
              from (select distinct n_nationkey, n_name, r_regionkey from flat)
            union all select 'r_regionkey', 'r_regionkey,r_name', count(*)
              from (select distinct r_regionkey, r_name from flat)""",
        "recombined_tables": _FLAT,
        "email_domain": """
            select doc_id, nullif(lower(regexp_extract(
              text, '@([A-Za-z0-9.-]+[.][A-Za-z]{2,})', 1)), '') as domain from documents""",
        "founding_year": """
            select o_orderkey, cast(year(o_orderdate) as bigint) as year from orders""",
        "per_thousand": f"""
            with {_RATES}
            select dep_id, round(s, 6) as schools_per_1000, round(l, 6) as libraries_per_1000
            from rates""",
        "log10_safe": f"with {_RATES} select * from logs",
        "loglog_points": f"""
            with {_RATES} select * from logs
            where log_schools is not null and log_libraries is not null""",
        "loglog_excluded": f"""
            with {_RATES}
            select count(*) filter (where log_schools is not null and log_libraries is not null)
                     as n_shown,
                   count(*) filter (where log_schools is null or log_libraries is null) as n_excluded
            from logs""",
        "loglog_fit": f"""
            with {_RATES},
            exact as (select log10(s) as x, log10(l) as y from rates where s > 0 and l > 0)
            select count(*) as n, round(regr_slope(y, x), 6) as slope,
                   round(regr_intercept(y, x), 6) as intercept, round(regr_r2(y, x), 6) as r2
            from exact""",
        "relationship_spearman": f"""
            with {_INTEGRATED},
            ranked as (
              select rank() over (order by schools) + (count(*) over (partition by schools) - 1) / 2.0 as a,
                     rank() over (order by libraries) + (count(*) over (partition by libraries) - 1) / 2.0 as b
              from integrated)
            select count(*) as n, round(corr(a, b), 6) as rho from ranked""",
        "mine_formats": r"""
            with texts as (
              select 'schools' as register, 'founded' as column_name,
                     case when o_orderkey % 50 = 0 then 's/d' when o_orderkey % 3 = 0 then strftime(o_orderdate, '%d/%m/%Y')
                          when o_orderkey % 3 = 1 then strftime(o_orderdate, '%Y-%m-%d') else strftime(o_orderdate, '%Y') end as value
              from orders
              union all
              select 'schools', 'code', case when o_orderkey % 40 = 0 then 'N/A' else o_orderstatus || '-' || (o_orderkey % 7000) end from orders
              union all
              select 'libraries', 'opened',
                     case when l_orderkey % 30 = 0 then '99/99/9999' when l_orderkey % 2 = 0 then strftime(l_shipdate, '%Y.%m.%d')
                          else strftime(l_shipdate, '%-d/%-m/%Y') end
              from lineitem
              union all select 'libraries', 'flag', l_returnflag from lineitem),
            shaped as (
              select register, column_name, value,
                     regexp_replace(regexp_replace(regexp_replace(value, '\p{Nd}', '9', 'g'), '\p{Ll}', 'a', 'g'), '[\p{Lu}\p{Lt}\p{Lo}\p{Lm}]', 'A', 'g') as p0
              from texts where value is not null),
            wider as (
              select *, regexp_replace(regexp_replace(regexp_replace(p0, '9+', '9+', 'g'), 'a+', 'a+', 'g'), 'A+', 'A+', 'g') as p1,
                     count(*) over (partition by register, column_name) as total,
                     count(*) over (partition by register, column_name, p0) as n0
              from shaped),
            kinds as (
              select register, column_name, p0, count(distinct value) as different from shaped group by all),
            most as (select register, column_name, max(different) as most from kinds group by all),
            judged as (
              select w.*, regexp_replace(p1, '([9aA][+])+', 'w+', 'g') as p2,
                     different = 1 and most > 1 and n0 >= total * 0.005 as is_placeholder,
                     n0 >= total * 0.02 or (different = 1 and most > 1 and n0 >= total * 0.005) as ok0
              from wider w join kinds using (register, column_name, p0) join most using (register, column_name)),
            one as (
              select *, not ok0 and count(*) filter (where not ok0) over (partition by register, column_name, p1) >= total * 0.02 as ok1
              from judged),
            two as (
              select *, not ok0 and not ok1 and count(*) filter (where not ok0 and not ok1)
                     over (partition by register, column_name, p2) >= total * 0.02 as ok2
              from one)
            select register, column_name, cast(case when ok0 then 0 when ok1 then 1 when ok2 then 2 else 3 end as bigint) as level,
                   case when ok0 then p0 when ok1 then p1 when ok2 then p2 else '*' end as pattern,
                   count(*) as n_rows, count(distinct value) as n_values, min(value) as example, is_placeholder
            from two group by all""",
        "relationship_kendall": f"""
            with {_INTEGRATED},
            pairs as (
              select sign(a.schools - b.schools) as x, sign(a.libraries - b.libraries) as y
              from integrated a join integrated b on a.dep_id < b.dep_id)
            select (select count(*) from integrated) as n,
                   round(cast(sum(x * y) as double)
                         / nullif(sqrt(cast(sum(x * x) as double)) * sqrt(cast(sum(y * y) as double)), 0), 6) as tau
            from pairs""",
        "relationship_interval": f"""
            with {_RATES},
            points as (select dep_id, log10(s) as x, log10(l) as y from rates where s > 0 and l > 0),
            digests as (
              select x, y, four, md5('7:' || dep_id || ':' || four) as digest
              from points, unnest(range(50)) as t(four)),
            draws as (
              select x, y, four * 4 + nth as replicate, cast('0x' || substr(digest, cast(1 + 8 * nth as bigint), 8) as bigint) as u
              from digests, unnest(range(4)) as t(nth)),
            weighted as (
              select x, y, replicate, {" + ".join(f"(u >= {upto})::int" for upto in relationship.POISSON_UPTO)} as w from draws),
            sums as (
              select replicate, cast(sum(w) as double) as n, sum(w * x) as a, sum(w * y) as b,
                     sum(w * x * x) as aa, sum(w * y * y) as bb, sum(w * x * y) as ab
              from weighted group by replicate),
            found as (
              select 'r' as statistic, (n * ab - a * b) / nullif(sqrt((n * aa - a * a) * (n * bb - b * b)), 0) as value from sums
              union all select 'slope', (n * ab - a * b) / nullif(n * aa - a * a, 0) from sums)
            select statistic, count(value) as n_replicates, round(quantile_cont(value, 0.025), 6) as low,
                   round(quantile_cont(value, 0.975), 6) as high
            from found group by statistic""",
        "relationship_corr": f"""
            with {_INTEGRATED}
            select count(*) as n, round(covar_pop(schools, libraries)
                   / nullif(stddev_pop(schools) * stddev_pop(libraries), 0), 6) as r
            from integrated""",
    }
