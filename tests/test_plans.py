"""What the plans must look like for the queries to hold on large tables."""

import re

import pytest

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"
QUERIES = entry.library_queries()
NEVER_READS_ROWS_TWICE = {"integrate_departments": 3, "summary_population_levels": 3}


@pytest.fixture(scope="module")
def plan(spark):
    """Physical plans as text, planned as if no side were small enough to broadcast by itself."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield lambda name: QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


# These order sums of provinces, or distinct counts, in one task: neither grows with the registers.
ORDERS_SUMS = {"rank_provinces", "relationship_spearman", "relationship_kendall"}
SLOW = ("build_model", "check_model", "scan_csv", "scan_csv_latin1", "sink_model_csv")
# These return the rules they have found, a row each, and no plan of the search.
SLOW += ("discover_rules_part", "discover_rules_lineitem")


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SLOW)))
def test_no_python_and_no_cross_join(plan, name):
    text = plan(name)
    for node in ("Python", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in text


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SLOW)))
def test_only_partial_aggregates_gather_in_one_task(plan, name):
    lines = plan(name).splitlines()
    for i, line in enumerate(lines):
        if "SinglePartition" in line and name not in ORDERS_SUMS:
            assert "partial_" in lines[i + 1], lines[i + 1]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SLOW)))
def test_no_broadcast_is_hinted(plan, name):
    assert "BroadcastExchange" not in plan(name)


@pytest.mark.parametrize("name", ["join_lookup", "boxplot_outliers", "check_normal_forms"])
def test_no_job_runs_before_the_query_returns(spark, name):
    spark.sparkContext.setJobGroup(f"lazy-{name}", name)
    QUERIES[name](spark, SF_DIR)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup(f"lazy-{name}")


@pytest.mark.parametrize("name", sorted(NEVER_READS_ROWS_TWICE))
def test_each_table_is_scanned_once(plan, name):
    assert len(re.findall("FileScan parquet", plan(name))) == NEVER_READS_ROWS_TWICE[name]


@pytest.mark.parametrize("name", ["filter_since", "libraries_since"])
def test_date_range_reaches_the_scan(plan, name):
    assert "GreaterThanOrEqual(l_sh" in plan(name)


def test_only_needed_columns_are_read(plan):
    text = plan("integrate_departments")
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double,l_returnflag:string>" in text
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in text
    assert "ReadSchema: struct<o_custkey:bigint>" in plan("schools_per_department")


@pytest.mark.parametrize("name", ["integrate_departments", "libraries_since", "bars_libraries_province"])
def test_facts_are_summed_before_they_are_joined(plan, name):
    """Lines reach the join as one row per order, summed in part before the shuffle."""
    lines = plan(name).splitlines()
    scan = next(i for i, line in enumerate(lines) if "l_orderkey" in line and "FileScan" in line)
    above = [line for line in lines[:scan] if "HashAggregate" in line or "Exchange" in line][-3:]
    assert "HashAggregate" in above[0] and "Exchange" in above[1] and "partial_" in above[2]


def test_top_domain_takes_the_head_of_each_task(plan):
    assert "TakeOrderedAndProject" in plan("top_email_domain")
    text = plan("top_domain_per_group")
    before, after = text.index("Final"), text.index("Partial")
    assert "WindowGroupLimit" in text and "Exchange" in text[before:after]
