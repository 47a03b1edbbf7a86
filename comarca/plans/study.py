"""The whole study from model tables: every question and the data of every chart."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from comarca.operators import departments, distribution, mail, relationship
from comarca.operators.cleaning import filter_since
from comarca.plans.checks import check_model, unknown_keys
from comarca.plans.model import DATE_FORMATS, SENTINELS, build_model, founding_dates, losses
from comarca.plans.model import recover_codes, store_model, unplaced
from comarca.sources import write_model

# Fixed value: libraries are counted from this founding year on.
SINCE_YEAR = 1950


def study(
    model: Mapping[str, DataFrame],
    levels: Mapping[str, str],
    bands: Mapping[str, str] | None = None,
    since: int = SINCE_YEAR,
    keep: Callable[[str, DataFrame], DataFrame] = lambda name, df: df,
) -> dict[str, DataFrame]:
    """Results by name, from the tables of ``build_model``.

    ``levels`` and ``bands`` map a result column to the level or age band it counts.
    A school with several levels counts once in each and once in the total.
    ``keep`` may store a result that others start from and give back the stored
    table; by default nothing is stored and all results are lazy.
    """
    prov, dep = model["provinces"], model["departments"]
    people = model["population"]
    schools = departments.as_facts(model["schools"], "schools")
    by_level = departments.as_facts(
        model["schools"].join(model["school_levels"], "school_id"), "schools", "level_id"
    )
    libraries = departments.as_facts(model["libraries"], "libraries")
    by_province = departments.as_facts(model["libraries"], "libraries", "prov_id")
    bars = departments.libraries_per_province(prov, dep, by_province)
    recent = departments.as_facts(filter_since(model["libraries"], "founded", since), "libraries")
    integrated = keep(
        "integrate_departments", departments.integrate(dep, people, schools, libraries)
    )
    counts = integrated.select("prov_id", "dep_id", "schools")
    domains = mail.library_domains(model["libraries"], "lib_id", "email", "dep_id")
    return {
        "summary_population_levels": departments.summary(dep, people, by_level, levels, bands),
        "summary_totals": departments.totals(
            dep, people, schools, by_level.withColumnRenamed("schools", "level_schools"), libraries
        ),
        "libraries_since": departments.libraries_since(dep, recent),
        "integrate_departments": integrated,
        "top_email_domain": mail.top_domain(domains),
        "top_domain_per_department": mail.top_domain_per_group(
            domains.dropna(subset=["dep_id"]), "dep_id"
        ),
        "bars_libraries_province": bars,
        "rank_provinces": departments.rank_provinces(bars),
        "scatter_schools_population": departments.scatter(dep, people, by_level),
        "schools_per_department": counts,
        "boxplot_quartiles": distribution.quartiles(counts, "prov_id", "schools"),
        "boxplot_whiskers": distribution.whiskers(counts, "prov_id", "schools"),
        "boxplot_outliers": distribution.outliers(counts, "prov_id", "schools"),
        "loglog_points": relationship.loglog_points(integrated),
        "loglog_excluded": relationship.loglog_excluded(integrated),
        "loglog_fit": relationship.loglog_fit(relationship.loglog_points(integrated)),
        "relationship_spearman": relationship.relationship_spearman(
            integrated, "schools", "libraries"
        ),
        "relationship_kendall": relationship.relationship_kendall(integrated, "schools", "libraries"),
        "relationship_interval": relationship.relationship_interval(
            relationship.loglog_points(integrated), "dep_id", "log_schools", "log_libraries"
        ),
        "relationship_corr": relationship.relationship_corr(
            relationship.rates(integrated), "schools_per_1000", "libraries_per_1000"
        ),
    }


def run_study(
    spark: SparkSession,
    registers: Mapping[str, DataFrame],
    levels: Mapping[str, str],
    directory: str,
    bands: Mapping[str, str] | None = None,
    since: int = SINCE_YEAR,
    date_formats: Sequence[str] = DATE_FORMATS,
    **cleaning,
) -> dict[str, DataFrame]:
    """From raw registers to stored results, below ``directory``.

    Model tables go to ``model/`` and results to ``results/``, each as Parquet
    and CSV. ``cleaning`` are the code widths and placeholders of ``build_model``. A stage reads what the one before has written, so a lost executor
    costs the tasks of one stage and nothing is cleaned or counted twice.
    """
    registers, recovered = recover_codes(registers, **cleaning)
    model = build_model(registers, levels, date_formats=date_formats, **cleaning)
    stored = store_model(spark, model, f"{directory}/model")
    results: dict[str, DataFrame] = {}

    def keep(name: str, df: DataFrame) -> DataFrame:
        if name not in results:
            results[name] = write_model(df, f"{directory}/results", name)
        return results[name]

    keep("recovered_codes", recovered)
    keep("unplaced", unplaced(registers, **cleaning))
    keep("losses", losses(registers, date_formats=date_formats, **cleaning))
    sentinels = cleaning.get("sentinels", SENTINELS)
    keep("founding_dates", founding_dates(registers, since, sentinels, date_formats))
    keep("unknown_keys", unknown_keys(stored))
    keep("model_checks", check_model(stored))
    for name, df in study(stored, levels, bands, since, keep).items():
        keep(name, df)
    return results
