import random

from comarca.operators import modelling


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_dimension_has_each_value_once(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", None), (None, None)], "k string, v string")
    assert sorted(map(str, rows_any(modelling.dim_extract(df, ["k", "v"])))) == sorted(
        map(str, [("a", "x"), ("b", None)])
    )


def rows_any(df):
    return [tuple(r) for r in df.collect()]


def test_bridge_keeps_only_set_flags(spark):
    df = spark.createDataFrame(
        [(1, "X", "1"), (2, None, " "), (3, "", "0"), (4, "0", "si")], "id int, a string, b string"
    )
    assert rows(modelling.bridge(df, "id", {"a": "A", "b": "B"}, "level")) == [
        (1, "A"), (1, "B"), (4, "B")
    ]


def test_1nf_takes_the_delimiter_literally(spark):
    df = spark.createDataFrame([(1, "a|b|c", "x"), (2, "abc", "x|y"), (3, None, "x")], "id int, m string, n string")
    assert rows(modelling.check_1nf(df, ["id"], ["m", "n"], "|")) == [(1, "m", 3), (2, "n", 2)]
    wide = spark.createDataFrame([(1, "a; b; "), (2, "a;b"), (3, "")], "id int, m string")
    assert rows(modelling.check_1nf(wide, ["id"], ["m"], "; ")) == [(1, "m", 3)]


def test_key_must_be_unique_and_without_null(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 1), (None, 5)], "a int, b int")
    got = {tuple(r) for r in modelling.check_key(df, ["a", "b"]).collect()}
    assert got == {(2, 1, 2), (None, 5, 1)}


def test_fd_counts_null_as_a_value(spark):
    df = spark.createDataFrame([(1, "x"), (1, "x"), (2, "x"), (2, None), (3, None)], "a int, b string")
    assert rows(modelling.check_fd(df, ["a"], ["b"])) == [(2, 2)]


def test_normal_forms_name_the_broken_form(spark):
    # key (school, level); a name that hangs on the school alone breaks 2NF, a
    # province name that hangs on the province code breaks 3NF.
    df = spark.createDataFrame(
        [
            (1, "p", "one", 10, "ten"), (1, "s", "one", 10, "ten"),
            (2, "p", "two", 20, "twenty"), (3, "p", "two", 20, "twenty"), (4, "p", "four", 10, "ten"),
        ],
        "school int, level string, name string, prov int, prov_name string",
    )
    report = modelling.check_normal_forms(df, ["school", "level"], ["name", "prov", "prov_name"])
    broken = {(r.lhs, r.rhs): r.breaks for r in report.collect()}
    assert broken[("school", "name")] == "2NF"
    assert broken[("prov", "prov_name")] == "3NF"
    assert broken[("prov_name", "prov")] == "3NF"
    assert broken[("level", "name")] is None
    assert broken[("prov", "name")] is None
    assert len(broken) == 2 * 3 + 3 * 2


def test_candidate_keys_break_no_form(spark):
    df = spark.createDataFrame([(1, "a", 10), (2, "b", 10)], "id int, code string, x int")
    report = modelling.check_normal_forms(df, ["id"], ["code", "x"])
    assert {r.breaks for r in report.collect()} == {None}


def test_foreign_key_reports_both_sides(spark):
    child = spark.createDataFrame([(1,), (1,), (7,), (7,), (None,)], "k int")
    parent = spark.createDataFrame([(1,), (2,)], "id int")
    assert rows(modelling.check_foreign_key(child, "k", parent, "id")) == [
        (2, "childless", 1), (7, "orphan", 2)
    ]


def profile(table, columns, dependencies):
    out = set()
    for lhs, rhs in dependencies:
        groups = {}
        for row in table:
            cells = dict(zip(columns, row))
            groups.setdefault(tuple(cells[c] for c in lhs), []).append(tuple(cells[c] for c in rhs))
        several = sum(len(set(values)) > 1 for values in groups.values())
        repeated = sum(len(values) > 1 for values in groups.values())
        out.add((",".join(lhs), ",".join(rhs), len(groups), several, repeated))
    return out


def test_profile_equals_brute_force(spark):
    rng = random.Random(3)
    table = [(rng.choice([None, 1, 2, 3]), rng.choice([None, "", "x", "y"]), i // 3, rng.random() > 0.5) for i in range(90)]
    df = spark.createDataFrame(table, "a int, b string, c int, d boolean")
    dependencies = [(["a"], ["b"]), (["a"], ["d"]), (["a", "b"], ["c"]), (["c"], ["a", "b"]), (["b"], ["a"]), (["c"], ["c"])]
    got = {tuple(r) for r in modelling.fd_profile(df, dependencies).collect()}
    assert got == profile(table, "abcd", dependencies)


def test_profile_deals_rows_out_before_it_groups_them(spark):
    """One task reads the rows; else it would keep a group for each row and dependency."""
    df = spark.range(1000).coalesce(1).selectExpr("id as a", "id % 7 as b", "id % 3 as c")
    groups = modelling.fd_profile(df, [(["a"], ["b"]), (["b"], ["c"])])
    plan = groups._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.rindex("HashAggregate(keys=[test"):]
    assert "REPARTITION_BY_NUM" in below
    assert "array" not in below.split("\n")[0]
    assert {tuple(r) for r in groups.collect()} == {("a", "b", 1000, 0, 0), ("b", "c", 7, 7, 7)}
