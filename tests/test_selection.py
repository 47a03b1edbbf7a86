import math
import random

import numpy as np
import pytest

from comarca.operators.distribution import quartiles
from comarca.operators.selection import group_quantiles, value_outliers, value_quartiles, value_whiskers


def groups():
    """A group with two thirds of all rows, one of equal values, tiny ones, NULLs, odd numbers."""
    rng = random.Random(2)
    rows = [("large", rng.gauss(0, 3) * 10 ** rng.randint(-3, 3)) for _ in range(4000)]
    rows += [("equal", 1.5)] * 700 + [("two values", float(i % 2)) for i in range(601)]
    rows += [("one", 7.25), ("pair", 1.0), ("pair", 2.0), (None, 3.0), (None, 4.0), (None, 9.0)]
    rows += [("nothing", None)] * 3 + [("signs", v) for v in (-0.0, 0.0, -1e300, 1e300, 5e-324)]
    rows += [("with null", v) for v in (None, 1.0, None, 2.0, 4.0)]
    return rows


def by_group(rows):
    out = {}
    for g, v in rows:
        if v is not None:
            out.setdefault(g, []).append(v)
    return out


@pytest.mark.parametrize("quantiles", [(0.25, 0.5, 0.75), (0.0, 0.1, 0.999, 1.0), (0.5, 0.5)])
def test_quantiles_are_exact(spark, quantiles):
    df = spark.createDataFrame(groups(), "g string, v double").repartition(7)
    got = {r.g: r.q for r in group_quantiles(df, "g", "v", quantiles).collect()}
    want = {g: np.quantile(vs, quantiles) for g, vs in by_group(groups()).items()}
    assert set(got) == set(want)
    for g, q in want.items():
        assert all(math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-300) for a, b in zip(got[g], q, strict=True)), g


def test_equals_the_histogram_on_counts(spark):
    rows = [(i % 5, (i * i) % 23) for i in range(1000)]
    df = spark.createDataFrame(rows, "p int, v bigint")
    assert sorted(value_quartiles(df, "p", "v").collect()) == sorted(quartiles(df, "p", "v").collect())


def test_whiskers_and_outliers_part_the_rows(spark):
    df = spark.createDataFrame([(g, v, i) for i, (g, v) in enumerate(groups())], "g string, v double, i int")
    ends = {r.g: (r.low, r.high) for r in value_whiskers(df, "g", "v").collect()}
    beyond = {(r.g, r.i): r.v for r in value_outliers(df, "g", "v").collect()}
    for i, (g, v) in enumerate(groups()):
        if v is not None:
            low, high = ends[g]
            assert ((g, i) in beyond) == (not low <= v <= high)


def test_no_task_holds_a_large_group(spark):
    """A group of all rows lies in many ranges, and windows over it see a row per range."""
    df = spark.range(20_000).selectExpr("'all' as g", "sqrt(id) as v")
    found = group_quantiles(df, "g", "v")
    assert found.collect()[0].q[1] == pytest.approx((math.sqrt(9999) + math.sqrt(10000)) / 2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_by" in plan and "percentile" not in plan


def test_empty(spark):
    assert group_quantiles(spark.createDataFrame([], "g string, v double"), "g", "v").count() == 0
