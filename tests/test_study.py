"""From raw CSV registers with edge rows to stored results."""

import csv

import pytest

from comarca.__main__ import read_register, run
from comarca.plans.model import build_model, losses, unplaced
from comarca.sources import CORRUPT, scan_csv

LEVELS = {"initial": "Initial", "primary": "Primary"}
CODES = [
    ("pc", "pn", "dc", "dn"),
    ("2", " Córdoba ", "7", "Comuna  1"), ("02", "CORDOBA", "007", "comuna 1"), ("2", "Córdoba", "14", "Ñuble"),
    ("6", "La Pampa", "1", "Sólo"), ("2007", "Too long", "1", "never"),
]
POPULATION = [
    ("pc", "dc", "n", "age"),
    ("2", "7", "1000", "young"), ("2", "7", "500", "old"), ("02", "014", "S/D", "old"), ("02", "014", "2000", "young"),
    ("6", "1", "0", "old"), ("x", "1", "77", "old"),
]
SCHOOLS = [
    ("id", "pc", "dc", "ini", "pri"),
    ("s1", "2", "7", "X", "X"), ("s2", "2", "7", "", "1"), ("s3", "2", "14", "S/D", "0"), ("s4", "6", "1", "1", ""),
    ("s5", "", "1", "X", "X"),
]
LIBRARIES = [
    ("id", "pc", "dc", "since", "mail", "remark"),
    ("l1", "2", "7", "1950-01-01", "a@B.com", 'says "hi"'), ("l2", "2", "7", "31/12/1949", "c@b.com; d@e.org", "x, y"),
    ("l3", "2", "14", "unknown", "S/D", ""), ("l4", "2", "14", "01/02/1999", "no address", ""),
    ("l5", "99", "", "1990-01-01", "z@z.net", ""), ("l6", "9", "999", "S/D", "", ""), ("l6", "9", "999", "S/D", "", ""),
]
NAMES = {
    "codes": {"pc": "prov_code", "pn": "prov_name", "dc": "dep_code", "dn": "dep_name"},
    "population": {"pc": "prov_code", "dc": "dep_code", "n": "persons", "age": "band"},
    "schools": {"id": "school_code", "pc": "prov_code", "dc": "dep_code", "ini": "initial", "pri": "primary"},
    "libraries": {"id": "lib_code", "pc": "prov_code", "dc": "dep_code", "since": "founded", "mail": "email"},
}


@pytest.fixture(scope="module")
def settings(tmp_path_factory):
    folder = tmp_path_factory.mktemp("raw")
    sources = {}
    for name, rows in zip(NAMES, (CODES, POPULATION, SCHOOLS, LIBRARIES)):
        path = folder / f"{name}.csv"
        with path.open("w", newline="") as out:
            csv.writer(out, lineterminator="\n").writerows(rows)
        sources[name] = {"path": str(path), "header": list(rows[0]), "columns": NAMES[name]}
    return {
        "output": str(tmp_path_factory.mktemp("study")),
        "registers": sources,
        "levels": LEVELS,
        "bands": {"young": "young"},
    }


@pytest.fixture(scope="module")
def registers(spark, settings):
    return {name: read_register(spark, source) for name, source in settings["registers"].items()}


@pytest.fixture(scope="module")
def results(spark, settings):
    return run(spark, settings)


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_model_tables(registers):
    model = build_model(registers, LEVELS)
    assert rows(model["provinces"]) == {("02", "cordoba"), ("06", "la pampa")}
    assert rows(model["departments"]) == {
        ("02007", "comuna 1", "02"), ("02014", "nuble", "02"), ("06001", "solo", "06")
    }
    assert rows(model["levels"]) == {("Initial",), ("Primary",)}
    assert rows(model["schools"]) == {
        ("s1", "02007"), ("s2", "02007"), ("s3", "02014"), ("s4", "06001")
    }
    assert rows(model["school_levels"]) == {
        ("s1", "Initial"), ("s1", "Primary"), ("s2", "Primary"), ("s4", "Initial")
    }
    assert [str(r.founded) for r in model["libraries"].orderBy("lib_id").collect()] == [
        "1950-01-01", "1949-12-31", "None", "1999-02-01", "1990-01-01", "None"
    ]


def test_rows_without_a_department_are_counted(registers):
    assert rows(unplaced(registers)) == {
        ("codes", 5, 1), ("population", 6, 1), ("schools", 5, 1), ("libraries", 7, 1)
    }


def test_what_the_results_cannot_show_is_reported(results):
    assert rows(results["unplaced"]) == {
        ("codes", 5, 1), ("population", 6, 1), ("schools", 5, 1), ("libraries", 7, 1)
    }
    assert rows(results["founding_dates"]) == {(3, 1, 1, 2)}
    assert rows(results["unknown_keys"]) == {
        ("libraries", "dep_id", "09999", 1), ("libraries", "prov_id", "09", 1), ("libraries", "prov_id", "99", 1)
    }
    broken = {(r.table_name, r.rule): r.n_violations for r in results["model_checks"].collect()}
    assert len(broken) == 15
    assert {k: n for k, n in broken.items() if n} == {
        ("libraries", "dep_id in departments"): 1, ("libraries", "prov_id in provinces"): 2
    }


def test_integrated(results):
    assert rows(results["integrate_departments"]) == {
        ("02007", "comuna 1", "02", 1500, 2, 2),
        ("02014", "nuble", "02", 2000, 1, 2),
        ("06001", "solo", "06", 0, 1, 0),
    }


def test_summary(results):
    df = results["summary_population_levels"].select("dep_id", "persons", "young", "initial", "primary")
    assert rows(df) == {
        ("02007", 1500, 1000, 1, 2), ("02014", 2000, 2000, 0, 0), ("06001", 0, 0, 1, 0)
    }


def test_counts_and_charts(results):
    since = results["libraries_since"].select("dep_id", "libraries")
    assert rows(since) == {("02007", 1), ("02014", 1), ("06001", 0)}
    assert rows(results["bars_libraries_province"]) == {("02", "cordoba", 4), ("06", "la pampa", 0)}
    assert rows(results["scatter_schools_population"]) == {
        ("02007", "Initial", 1, 1500), ("02007", "Primary", 2, 1500), ("06001", "Initial", 1, 0)
    }
    assert rows(results["boxplot_quartiles"]) == {("02", 1.25, 1.5, 1.75), ("06", 1.0, 1.0, 1.0)}
    assert rows(results["boxplot_whiskers"]) == {("02", 1, 2), ("06", 1, 1)}
    assert rows(results["boxplot_outliers"]) == set()
    assert rows(results["loglog_excluded"]) == {(2, 1)}


def test_semicolons_latin_letters_and_bare_years(spark, settings, tmp_path):
    changed = dict(settings, output=str(tmp_path / "out"), registers={}, date_formats=["yyyy"], sentinels=["", "?"])
    years = {"1950-01-01": "1950", "31/12/1949": "1949", "01/02/1999": "?"}
    for name, lines in zip(NAMES, (CODES, POPULATION, SCHOOLS, LIBRARIES)):
        path = tmp_path / f"{name}.csv"
        with path.open("w", newline="", encoding="latin-1") as out:
            csv.writer(out, delimiter=";", lineterminator="\n").writerows([[years.get(v, v) for v in r] for r in lines])
        changed["registers"][name] = dict(settings["registers"][name], path=str(path), separator=";", encoding="ISO-8859-1")
    results = run(spark, changed)
    assert rows_by_department(results["libraries_since"]) == {"02007": 1, "02014": 0, "06001": 0}
    assert {r.dep_name for r in results["libraries_since"].collect()} == {"comuna 1", "nuble", "solo"}
    assert rows(results["losses"]) >= {("libraries", "unreadable", 1), ("codes", "placed", 4), ("codes", "unplaced", 1)}


def rows_by_department(df):
    return {r.dep_id: r.libraries for r in df.collect()}


def test_losses_add_up(results):
    total = {}
    for r in results["losses"].collect():
        total[r.register] = total.get(r.register, 0) + r.n_rows
    assert total == {"codes": 5, "population": 6, "schools": 5, "libraries": 7}
    assert ("population", "unreadable", 1) not in rows(results["losses"])  # S/D is a placeholder
    assert ("libraries", "unknown department", 2) in rows(results["losses"])


def test_domains(results):
    assert rows(results["top_email_domain"]) == {("b.com", 2)}
    assert rows(results["top_domain_per_department"]) == {("02007", "b.com", 2)}


def test_relationship(results):
    row = results["relationship_corr"].first()
    assert (row.n, row.r) == (2, pytest.approx(1.0))


def test_results_are_also_csv(spark, results):
    stored = results["integrate_departments"].inputFiles()[0]
    folder = stored.removeprefix("file://").rsplit("/", 2)[0]
    back = scan_csv(spark, f"{folder}/integrate_departments.csv", results["integrate_departments"].schema)
    assert rows(back.drop(CORRUPT)) == rows(results["integrate_departments"])


def registers_of(spark, population, schools=(), libraries=()):
    text = lambda names: ", ".join(f"{n} string" for n in names.split())
    return {
        "codes": spark.createDataFrame([("2", "Córdoba", "7", "Uno"), ("2", "Córdoba", "8", "Dos")], text("prov_code prov_name dep_code dep_name")),
        "population": population,
        "schools": spark.createDataFrame(list(schools), text("school_code prov_code dep_code initial primary")),
        "libraries": spark.createDataFrame(list(libraries), text("lib_code prov_code dep_code founded email")),
    }


def test_population_rows_are_told_apart_by_all_columns(spark):
    """Two age rows of equal size are two; a row that is there twice is one and the other is counted."""
    people = [("2", "7", "100", "0-4"), ("2", "7", "100", "5-9"), ("2", "7", "50", "10-14"), ("2", "7", "50", "10-14"), ("2", "8", "S/D", "0-4")]
    found = registers_of(spark, spark.createDataFrame(people, "prov_code string, dep_code string, persons string, age string"))
    assert rows(build_model(found, LEVELS)["population"]) == {("02007", 250), ("02008", None)}
    counted = {(r.register, r.reason): r.n_rows for r in losses(found).collect()}
    assert counted == {("codes", "placed"): 2, ("population", "placed"): 4, ("population", "duplicate"): 1}


def test_losses_say_what_the_model_does(spark):
    people = spark.createDataFrame([("2", "7", "1")], "prov_code string, dep_code string, persons string")
    schools = [("a", "2", "7", "X", None), ("a", "2", "7", "X", None), ("a", "2", "8", "X", None), ("b", "2", "-", "X", None), ("c", "3", "1", "X", None)]
    libraries = [("l", "2", "-", "1950-01-01", None), ("m", "2", "8", "in May", None), ("n", "-", "-", None, None), ("m", "2", "8", "in May", None)]
    found = registers_of(spark, people, schools, libraries)
    counted = {(r.register, r.reason): r.n_rows for r in losses(found).collect()}
    assert {k[1]: n for k, n in counted.items() if k[0] == "schools"} == {"placed": 1, "duplicate": 1, "conflict": 1, "unplaced": 1, "unknown department": 1}
    assert {k[1]: n for k, n in counted.items() if k[0] == "libraries"} == {"province only": 1, "unreadable": 1, "unplaced": 1, "duplicate": 1}
    model = build_model(found, LEVELS)
    used = {"placed", "unreadable", "province only", "unknown department"}
    for name in ("schools", "libraries"):
        assert model[name].count() == sum(n for (register, reason), n in counted.items() if register == name and reason in used)
