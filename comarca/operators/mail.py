"""Mail domains of libraries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from comarca.functions import email_domains


def library_domains(libs: DataFrame, lib_id: str, mail: str, *keep: str) -> DataFrame:
    """Distinct (library, domain) rows; libraries without an address have none.

    Values without an ``@`` are passed over before the pattern is tried.
    """
    return (
        libs.where(F.col(mail).contains("@"))
        .select(lib_id, *keep, F.explode(email_domains(F.col(mail))).alias("domain"))
        .withColumn("domain", F.lower("domain"))
        .distinct()
    )


def domain_frequency(domains: DataFrame, *group: str) -> DataFrame:
    return domains.groupBy(*group, "domain").agg(F.count(F.lit(1)).alias("n"))


def top_domain(domains: DataFrame) -> DataFrame:
    """The most frequent domain; the first by name among equals."""
    return domain_frequency(domains).orderBy(F.desc("n"), F.asc("domain")).limit(1)


def top_domain_per_group(domains: DataFrame, group: str) -> DataFrame:
    """The most frequent domain of each group; the first by name among equals.

    Spark cuts each task to the leading row per group before it shuffles, so a
    group with very many domains does not gather in one task.
    """
    first = Window.partitionBy(group).orderBy(F.desc("n"), F.asc("domain"))
    return (
        domain_frequency(domains, group)
        .withColumn("_rank", F.row_number().over(first))
        .where("_rank = 1")
        .select(group, "domain", "n")
    )
