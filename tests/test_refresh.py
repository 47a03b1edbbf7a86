import random

import pytest
from pyspark.sql import functions as F

from comarca.operators.refresh import changed_keys, fingerprints, first_state, read_state, refresh, store_state

COLUMNS = "key string, place int, amount bigint, note string"
BY, MEASURES = ["place"], ["n", "amount"]


def clean(register):
    return register.where("note is null or note <> 'void'").select("key", "place", F.lit(1).cast("bigint").alias("n"), "amount")


def delivery(seed):
    """Rows of 60 keys, some several times, some without a key, a place, an amount or a note."""
    rng = random.Random(0)
    found = [
        (rng.choice([None, *map(str, range(60))]), rng.choice([None, *range(8)]), rng.choice([None, *range(100)]), rng.choice([None, "void", ""]))
        for _ in range(200)
    ]
    later = random.Random(seed)
    if seed:
        found = [r for r in found if later.random() > 0.1]
        found = [(r[0], later.randrange(9), *r[2:]) if later.random() < 0.1 else r for r in found]
        found = [(*r[:3], None if r[3] == "" else "") if later.random() < 0.1 and r[3] != "void" else r for r in found]
        found += [(str(later.randrange(50, 90)), later.randrange(12), later.randrange(100), None) for _ in range(20)]
        later.shuffle(found)
    return found


def content(state):
    return [sorted(map(str, map(tuple, df.select(*sorted(df.columns)).collect()))) for df in (state.marks, state.facts, state.sums)]


def test_a_refresh_equals_a_rebuild_through_several_deliveries(spark, tmp_path):
    state = first_state(spark.createDataFrame(delivery(0), COLUMNS), "key", BY, MEASURES, clean)
    store_state(state, str(tmp_path / "0"), "orders")
    for nth, seed in enumerate((1, 1, 2), 1):
        state = read_state(spark, str(tmp_path / str(nth - 1)), "orders")
        register = spark.createDataFrame(delivery(seed), COLUMNS)
        state = store_state(refresh(state, register, "key", BY, MEASURES, clean), str(tmp_path / str(nth)), "orders")
        assert content(state) == content(first_state(register, "key", BY, MEASURES, clean))
    nothing = refresh(state, spark.createDataFrame([], COLUMNS), "key", BY, MEASURES, clean)
    assert content(nothing) == [[], [], []]


def test_changes(spark):
    old = [("a", 1, 1, "x"), ("a", 1, 1, "x"), ("b", 1, 1, "x"), ("c", 1, None, "x"), ("d", 1, 1, None), (None, 1, 1, "x"), ("e", 1, 1, "x")]
    new = [("a", 1, 1, "x"), ("b", 1, 1, "x"), ("c", 1, 0, "x"), ("d", 1, 1, ""), (None, 1, 1, "y"), ("f", 1, 1, "x")]
    state = first_state(spark.createDataFrame(old, COLUMNS), "key", BY, MEASURES, clean)
    marks = fingerprints(spark.createDataFrame(new, COLUMNS).select("note", "amount", "key", "place"), "key")
    assert {tuple(r) for r in changed_keys(state, marks, "key").collect()} == {
        ("a", "changed"), ("c", "changed"), ("d", "changed"), (None, "changed"), ("e", "withdrawn"), ("f", "new")
    }


def test_only_changed_rows_are_cleaned(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(register):
        count = F.udf(lambda key: seen.add(1) is None, "boolean")
        return clean(register.where(count.asNondeterministic()("key")))

    before = delivery(0)
    state = first_state(spark.createDataFrame(before, COLUMNS), "key", BY, MEASURES, clean)
    after = [(k, p, 1000 if k == "7" else a, t) for k, p, a, t in before]
    result = refresh(state, spark.createDataFrame(after, COLUMNS), "key", BY, MEASURES, counted).sums
    assert result.count() == 9
    assert 0 < seen.value <= 2 * sum(k == "7" for k, *_ in before)


def test_an_empty_first_delivery(spark):
    state = first_state(spark.createDataFrame([], COLUMNS), "key", BY, MEASURES, clean)
    register = spark.createDataFrame(delivery(1), COLUMNS)
    assert content(refresh(state, register, "key", BY, MEASURES, clean)) == content(first_state(register, "key", BY, MEASURES, clean))
