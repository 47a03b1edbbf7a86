"""Department questions against brute force, with one key that holds a third of all rows."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from comarca.operators import departments, distribution, joins, mail, relationship

LEVELS = {"initial": "i", "primary": "p", "secondary": "s"}


@pytest.fixture(scope="module")
def world():
    """60 departments in 5 provinces; the first of each kind is hot, the last has nothing."""
    rnd = random.Random(7)
    dep = [(d, f"d{d}", 0 if d < 20 else 1 + d % 4) for d in range(60)] + [(99, "alone", 9)]
    pick = lambda: 0 if rnd.random() < 1 / 3 else rnd.randrange(58)
    schools = [(i, pick(), rnd.choice("ips")) for i in range(3000)]
    libs = [(i, pick()) for i in range(900)]
    people = [(pick(), rnd.choice("ips"), rnd.randrange(50)) for i in range(2000)]
    prov = [(p, f"p{p}") for p in (0, 1, 2, 3, 4, 9)]
    return dep, schools, libs, people, prov


@pytest.fixture(scope="module")
def frames(spark, world):
    dep, schools, libs, people, prov = world
    return (
        spark.createDataFrame(dep, "dep_id long, dep_name string, prov_id int"),
        spark.createDataFrame(schools, "school_id long, dep_id long, level_id string").repartition(6),
        spark.createDataFrame(libs, "lib_id long, dep_id long").repartition(6),
        spark.createDataFrame(people, "dep_id long, band string, persons long").repartition(6),
        spark.createDataFrame(prov, "prov_id int, prov_name string"),
    )


@pytest.fixture(scope="module")
def facts(frames):
    dep, schools, libs, people, _ = frames
    return (
        dep,
        people,
        departments.as_facts(schools, "schools", "level_id"),
        departments.as_facts(libs, "libraries"),
    )


@pytest.fixture(scope="module")
def truth(world):
    dep, schools, libs, people, _ = world
    persons = Counter()
    for d, _, n in people:
        persons[d] += n
    return persons, Counter(d for _, d, _ in schools), Counter(d for _, d in libs)


def test_integrate_counts_every_fact_once(facts, world, truth):
    dep, people, schools, libs = facts
    persons, n_schools, n_libs = truth
    got = {r.dep_id: r for r in departments.integrate(dep, people, schools, libs).collect()}
    assert len(got) == len(world[0])
    for d, name, prov in world[0]:
        r = got[d]
        assert (r.dep_name, r.prov_id, r.persons, r.schools, r.libraries) == (
            name, prov, persons[d], n_schools[d], n_libs[d]
        )


def test_integrate_is_the_same_without_broadcast(spark, facts):
    def run():
        return sorted(tuple(r) for r in departments.integrate(*facts).collect())

    with_broadcast = run()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert run() == with_broadcast
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_summary_by_level_and_band(facts, world, truth):
    dep, people, schools, _ = facts
    bands = {"people_i": "i", "people_s": "s"}
    got = {r.dep_id: r for r in departments.summary(dep, people, schools, LEVELS, bands).collect()}
    level = Counter((d, l) for _, d, l in world[1])
    band = Counter()
    for d, b, n in world[3]:
        band[d, b] += n
    assert len(got) == len(world[0])
    for d, _, _ in world[0]:
        r = got[d]
        assert (r.persons, r.people_i, r.people_s) == (truth[0][d], band[d, "i"], band[d, "s"])
        assert (r.initial, r.primary, r.secondary) == tuple(level[d, v] for v in "ips")
        assert r.initial + r.primary + r.secondary == truth[1][d]


def test_scatter_has_a_point_per_department_and_level(facts, world, truth):
    dep, people, schools, _ = facts
    got = {(r.dep_id, r.level_id): (r.schools, r.persons) for r in departments.scatter(dep, people, schools).collect()}
    level = Counter((d, l) for _, d, l in world[1])
    assert got == {k: (n, truth[0][k[0]]) for k, n in level.items()}


def test_province_totals_equal_department_totals(frames, facts, truth, world):
    got = {
        r.prov_id: r.libraries
        for r in departments.libraries_per_province(frames[4], facts[0], facts[3]).collect()
    }
    want = Counter({p: 0 for p, _ in world[4]})
    for d, _, p in world[0]:
        want[p] += truth[2][d]
    assert got == dict(want)
    assert sum(got.values()) == 900


def test_libraries_since_keeps_departments_without_any(facts, truth, world):
    got = {r.dep_id: r.libraries for r in departments.libraries_since(facts[0].select("dep_id"), facts[3]).collect()}
    assert got == {d: truth[2][d] for d, _, _ in world[0]}
    assert got[99] == 0


def test_roll_up_places_facts_through_a_lookup(spark, truth, world):
    lookup = spark.createDataFrame([(i, d) for i, d, _ in world[1]], "school_id long, dep_id long")
    hot = [(0, 1)] * 500 + [(i % 3000, 2) for i in range(1000)]
    rows = spark.createDataFrame(hot, "school_id long, libraries long").repartition(5)
    got = departments.population(
        joins.roll_up(rows, "school_id", lookup, ["libraries"]).withColumnRenamed("libraries", "persons")
    )
    dep_of = {i: d for i, d, _ in world[1]}
    want = Counter()
    for school, n in hot:
        want[dep_of[school]] += n
    assert {r.dep_id: r.persons for r in got.collect()} == dict(want)


# Box plots


@pytest.fixture(scope="module")
def counts(facts):
    return departments.schools_per_department(facts[0], facts[2])


@pytest.fixture(scope="module")
def groups(world, truth):
    by_province = defaultdict(list)
    for d, _, p in world[0]:
        by_province[p].append((truth[1][d], d))
    return by_province


def fences(values, k=1.5):
    q1, q3 = np.percentile(values, [25, 75])
    return q1 - k * (q3 - q1), q3 + k * (q3 - q1)


def test_quartiles_are_exact(counts, groups):
    got = {r.prov_id: (r.q1, r.median, r.q3) for r in distribution.quartiles(counts, "prov_id", "schools").collect()}
    assert set(got) == set(groups)
    for p, members in groups.items():
        assert got[p] == pytest.approx(tuple(np.percentile([n for n, _ in members], [25, 50, 75])))
        assert got[p][0] <= got[p][1] <= got[p][2]
    assert got[9] == (0.0, 0.0, 0.0)


def test_whiskers_end_at_the_last_value_inside(counts, groups):
    got = {r.prov_id: (r.low, r.high) for r in distribution.whiskers(counts, "prov_id", "schools").collect()}
    for p, members in groups.items():
        values = [n for n, _ in members]
        low, high = fences(values)
        inside = [n for n in values if low <= n <= high]
        assert got[p] == (min(inside), max(inside))


@pytest.mark.parametrize("threshold", ["10m", "-1"])
def test_outliers_broadcast_or_not(spark, counts, groups, threshold):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    got = {(r.prov_id, r.dep_id, r.schools) for r in distribution.outliers(counts, "prov_id", "schools").collect()}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    want = set()
    for p, members in groups.items():
        low, high = fences([n for n, _ in members])
        want |= {(p, d, n) for n, d in members if not low <= n <= high}
    assert got == want
    assert any(d == 0 for _, d, _ in want)


def test_lookup_keeps_rows_without_a_match(spark):
    keys = [None if i % 7 == 0 else 0 if i % 3 == 0 else i % 5 for i in range(300)]
    big = spark.createDataFrame(list(enumerate(keys)), "id long, k int")
    dim = spark.createDataFrame([(0, "a"), (1, "b")], "k int, name string")
    names = {0: "a", 1: "b"}
    got = {(r.id, r.k, r.name) for r in joins.lookup_join(big, dim, "k").collect()}
    assert got == {(i, k, names.get(k)) for i, k in enumerate(keys)}


# Mail


@pytest.fixture(scope="module")
def libraries(spark):
    return spark.createDataFrame(
        [
            (1, "a@x.com; b@X.com", "n"), (1, "a@x.com; b@X.com", "n"), (2, "c@y.org", "n"),
            (3, "c@y.org, d@x.com", "s"), (4, None, "s"), (5, "nothing", "s"), (6, "e@z.net", "s"),
        ],
        "lib_id int, email string, area string",
    )


def test_each_library_counts_once_per_domain(libraries):
    domains = mail.library_domains(libraries, "lib_id", "email")
    got = {r.domain: r.n for r in mail.domain_frequency(domains).collect()}
    assert got == {"x.com": 2, "y.org": 2, "z.net": 1}
    assert sum(got.values()) == domains.count()


def test_first_by_name_wins_a_tie(libraries):
    assert mail.top_domain(mail.library_domains(libraries, "lib_id", "email")).first() == ("x.com", 2)
    per_area = mail.top_domain_per_group(
        mail.library_domains(libraries, "lib_id", "email", "area"), "area"
    )
    assert {tuple(r) for r in per_area.collect()} == {("n", "x.com", 1), ("s", "x.com", 1)}


# Relationship


@pytest.fixture(scope="module")
def points(spark):
    return spark.createDataFrame(
        [(1, 1000, 10, 1), (2, 1000, 20, 3), (3, 0, 5, 5), (4, 500, 5, 0), (5, 100, 0, 0), (6, 2000, 9, 9)],
        "dep_id long, persons long, schools long, libraries long",
    )


def test_loglog_leaves_out_what_an_axis_cannot_show(points):
    got = {r.dep_id: r for r in relationship.loglog_points(points).collect()}
    assert set(got) == {1, 2, 6}
    assert got[2].log_schools == pytest.approx(math.log10(20))
    assert relationship.loglog_excluded(points).first() == (3, 3)


def test_correlation(points):
    x, y = [10, 20, 5, 5, 0, 9], [1, 3, 5, 0, 0, 9]
    got = relationship.relationship_corr(points, "schools", "libraries").first()
    assert (got.n, got.r) == (6, pytest.approx(np.corrcoef(x, y)[0, 1]))


def test_correlation_of_a_constant_is_null(spark):
    df = spark.range(0, 1000, 1, 7).selectExpr("0.1D + 0 * id as x", "cast(id as double) as y")
    assert relationship.relationship_corr(df, "x", "y").first() == (1000, None)
    assert relationship.relationship_corr(df.where("y < 0"), "x", "y").first() == (0, None)


def test_totals_of_every_grain(spark):
    dep = spark.createDataFrame([(1, "a", 10), (2, "b", 10), (3, "c", 20), (4, "d", 30)], "dep_id int, dep_name string, prov_id int")
    people = spark.createDataFrame([(1, 100), (1, 50), (2, None), (9, 1000)], "dep_id int, persons bigint")
    schools = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (9, 1)], "dep_id int, schools bigint")
    by_level = spark.createDataFrame(
        [(1, "x", 1), (1, "y", 1), (2, "x", 1), (9, "x", 1), (3, None, 1)], "dep_id int, level_id string, level_schools bigint"
    )
    libraries = spark.createDataFrame([(3, 2), (None, 5)], "dep_id int, libraries bigint")
    got = {tuple(r) for r in departments.totals(dep, people, schools, by_level, libraries).collect()}
    assert got == {
        ("country", None, None, 4, 150, 3, 2),
        ("province", 10, None, 2, 150, 2, 0), ("province", 20, None, 1, 0, 1, 2), ("province", 30, None, 1, 0, 0, 0),
        ("level", None, "x", None, None, 2, None), ("level", None, "y", None, None, 1, None),
        ("province and level", 10, "x", None, None, 2, None), ("province and level", 10, "y", None, None, 1, None),
    }
