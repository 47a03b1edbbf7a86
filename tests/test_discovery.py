import random
from itertools import combinations

import pytest

from comarca.operators import discovery
from comarca.operators.discovery import Rules, discover_references, discover_rules
from comarca.operators.synthesis import closure, decompose, minimal_cover, recombine, synthesize


def brute_rules(rows, columns, largest):
    def determines(x, a):
        seen = {}
        return all(seen.setdefault(tuple(r[i] for i in x), r[a]) == r[a] for r in rows)

    if not rows:
        return set(), set()
    keys, found = [], []
    for size in range(largest + 1):
        for x in combinations(range(len(columns)), size):
            if any(set(k) <= set(x) for k in keys):
                continue
            if len({tuple(r[i] for i in x) for r in rows}) == len(rows):
                keys.append(x)
                continue
            for a in set(range(len(columns))) - set(x):
                if determines(x, a) and not any(b == a and set(y) < set(x) for y, b in found):
                    found.append((x, a))
    name = lambda x: tuple(columns[i] for i in x)
    return {name(k) for k in keys}, {(name(x), columns[a]) for x, a in found}


def relation(seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        city = rng.choice(["a", "b", "c", "d", None])
        year = rng.randint(1, 6)
        rows.append((i // 2, i % 2, city, {"a": "N", "b": "N"}.get(city, "S"), year, year % 3, "fixed", rng.choice([None, 1.5, 2.5])))
    return rows


COLUMNS = ["number", "part", "city", "side", "year", "rest", "same", "other"]
TYPES = "number int, part int, city string, side string, year int, rest int, same string, other double"


@pytest.mark.parametrize("n, probe", [(60, 20_000), (60, 7), (1, 5), (2, 5), (0, 5)])
def test_rules_equal_brute_force(spark, n, probe):
    rows = relation(n + probe, n)
    found = discover_rules(spark.createDataFrame(rows, TYPES), largest=3, probe_rows=probe)
    keys, dependencies = brute_rules(rows, COLUMNS, 3)
    assert set(found.keys) == keys and set(found.dependencies) == dependencies
    assert len(found.dependencies) == len(dependencies)


@pytest.mark.parametrize("cells", [1_000_000, 40])
def test_rows_dealt_out_by_a_column_equal_brute_force(spark, monkeypatch, cells):
    """With few cells allowed in a task only even columns deal rows out, and the other sets go on their own."""
    monkeypatch.setattr(discovery, "EVERY_VALUE", 2)
    monkeypatch.setattr(discovery, "TASK_CELLS", cells)
    rows = relation(3, 150)
    found = discover_rules(spark.createDataFrame(rows, TYPES), largest=3, probe_rows=7)
    keys, dependencies = brute_rules(rows, COLUMNS, 3)
    assert set(found.keys) == keys and set(found.dependencies) == dependencies


def test_rows_are_dealt_out_once_for_all_sets(spark, monkeypatch):
    rows = relation(4, 150)
    df = spark.createDataFrame(rows, TYPES)
    sets = [s for s in combinations(COLUMNS[:6], 3) if "city" in s]  # city has NULL
    wanted = {s: set(COLUMNS) - set(s) for s in sets}
    dealt = []
    one = type(df).repartition
    monkeypatch.setattr(type(df), "repartition", lambda self, *by: dealt.append((self.count(), by)) or one(self, *by))
    assert discovery._tested(df, wanted, "city", 4) == discovery._tested(df, wanted)
    assert dealt == [(150, (4, "_lead"))]


def test_repeated_rows_leave_no_key(spark):
    df = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "a int, b string")
    found = discover_rules(df)
    assert found.keys == [] and set(found.dependencies) == {(("a",), "b"), (("b",), "a")}


def test_null_and_value_swapped_are_different(spark):
    df = spark.createDataFrame([(None, 1), (1, None), (1, 1)], "a int, b int")
    assert discover_rules(df).keys == [("a", "b")]


def test_references(spark):
    child = spark.createDataFrame([(1, "x"), (2, "x"), (2, None), (None, "q")], "id int, code string")
    parent = spark.createDataFrame([("1", 5), ("2", 5), ("3", 6)], "key string, n int")
    nothing = spark.createDataFrame([(None,)], "v string")
    tables = {"child": child, "parent": parent, "nothing": nothing}
    columns = {"child": ["id", "code"], "parent": ["key", "n"], "nothing": ["v"]}
    rows = {tuple(r) for r in discover_references(tables, columns).collect()}
    assert rows == {("child", "id", "parent", "key", 2, 0, True)}
    rows = {tuple(r) for r in discover_references(tables, columns, 0.6).collect()}
    assert rows == {("child", "id", "parent", "key", 2, 0, True), ("parent", "key", "child", "id", 3, 1, False)}


def test_cover_and_closure():
    given = [(("a",), "b"), (("b",), "c"), (("a",), "c"), (("a", "b"), "d")]
    assert closure("a", given) == set("abcd")
    assert minimal_cover(given) == [(("a",), "b"), (("b",), "c"), (("a",), "d")]


def test_tables_of_a_textbook_relation():
    rules = Rules(list("abcdef"), [("a", "b")], [(("a",), "c"), (("c",), "d"), (("d",), "c")])
    tables = {t.key: t.columns for t in synthesize(rules)}
    assert tables == {("a", "b"): ("a", "b", "e", "f"), ("a",): ("a", "c"), ("c",): ("c", "d")}


def test_no_key_keeps_all_columns_that_nothing_determines():
    tables = synthesize(Rules(list("abc"), [], [(("a",), "b")]))
    assert [t.columns for t in tables] == [("a", "c"), ("a", "b")]


@pytest.mark.parametrize("seed", range(6))
def test_join_is_lossless(spark, seed):
    """Whatever holds by chance in few rows: the tables joined are the rows, no more and no less."""
    rows = relation(seed, 6 + 9 * seed)
    df = spark.createDataFrame(rows, TYPES)
    tables = synthesize(discover_rules(df, largest=3))
    again = recombine(decompose(df, tables), tables).select(*COLUMNS)
    assert sorted(map(repr, map(tuple, again.collect()))) == sorted(map(repr, set(rows)))
