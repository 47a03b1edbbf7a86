"""Sums kept up to date from one delivery of a register to the next.

A register is delivered whole, but few of its rows are new. Each key has a fingerprint of its rows; only
the keys whose fingerprint has changed are cleaned again, their old facts are taken off the stored sums
and the new ones added. Sums are of whole numbers, so adding and taking off leaves no rest.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from comarca.sources import read_model, store


@dataclass(frozen=True)
class State:
    """What is kept between deliveries.

    ``marks``: (key, n_rows, mark, mark2); ``facts``: the key, the columns of ``by`` and the measures of every
    cleaned row; ``sums``: the measures per ``by``, and n_facts, how many facts they come from.
    """

    marks: DataFrame
    facts: DataFrame
    sums: DataFrame


def fingerprints(register: DataFrame, key: str) -> DataFrame:
    """(key, n_rows, mark, mark2): two sums of 64-bit hashes of all columns, whatever the order of the rows.

    A key may have several rows, and all rows with no key count as one key. The columns are taken by
    name, so their order does not matter either.
    """
    columns = sorted(register.columns)
    # A hash passes over NULLs, so where they are is hashed as well.
    present = F.concat(*[F.when(F.col(c).isNull(), "0").otherwise("1") for c in columns])
    hashed = register.select(
        key,
        F.xxhash64(present, *columns).cast("decimal(20,0)").alias("_one"),
        F.xxhash64(*reversed(columns), F.lit("second"), present).cast("decimal(20,0)").alias("_two"),
    )
    return hashed.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("_one").alias("mark"), F.sum("_two").alias("mark2")
    )


def _summed(facts: DataFrame, by: Sequence[str], measures: Sequence[str]) -> DataFrame:
    return facts.groupBy(*by).agg(*[F.sum(m).alias(m) for m in measures], F.sum("n_facts").alias("n_facts"))


def _cleaned(rows: DataFrame, key: str, by: Sequence[str], measures: Sequence[str], clean) -> DataFrame:
    return clean(rows).select(key, *by, *[F.coalesce(F.col(m), F.lit(0)).alias(m) for m in measures])


def _only(rows: DataFrame, keys: DataFrame, key: str, how: str) -> DataFrame:
    named = keys.select(F.col(key).alias("_key"))
    return rows.join(named, rows[key].eqNullSafe(named["_key"]), how)


def first_state(
    register: DataFrame, key: str, by: Sequence[str], measures: Sequence[str], clean: Callable[[DataFrame], DataFrame]
) -> State:
    """The state after a first delivery.

    ``clean`` makes facts (key, by, measures) of register rows, those of a key from its rows alone; a NULL measure counts as 0.
    """
    facts = _cleaned(register, key, by, measures, clean)
    sums = _summed(facts.withColumn("n_facts", F.lit(1).cast("bigint")), by, measures)
    return State(fingerprints(register, key), facts, sums)


def changed_keys(state: State, marks: DataFrame, key: str) -> DataFrame:
    """(key, change): keys that are ``new``, ``changed`` or ``withdrawn`` since the state was made."""
    names = ("n_rows", "mark", "mark2")
    old = state.marks.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in names])
    both = marks.join(old, marks[key].eqNullSafe(old["_key"]), "full")
    is_other = F.lit(False)
    for c in names:
        is_other |= ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    change = F.when(F.col("_n_rows").isNull(), "new").when(F.col("n_rows").isNull(), "withdrawn").otherwise("changed")
    # A side without the key has no rows of it; the key itself may be NULL on both.
    return both.where(is_other).select(
        F.when(F.col("n_rows").isNull(), F.col("_key")).otherwise(F.col(key)).alias(key), change.alias("change")
    )


def refresh(
    state: State,
    register: DataFrame,
    key: str,
    by: Sequence[str],
    measures: Sequence[str],
    clean: Callable[[DataFrame], DataFrame],
    keep: Callable[[str, DataFrame], DataFrame] = lambda name, df: df,
) -> State:
    """The state after another whole delivery; equal to ``first_state`` of it.

    Rows of unchanged keys are only hashed: neither cleaned nor summed. Groups of which no fact
    is left go, others keep a sum of 0. NULL keys and NULL groups are kept like others. ``keep`` may store
    what is used more than once: ``marks``, ``changed`` and ``fresh``.
    """
    marks = keep("marks", fingerprints(register, key))
    changed = keep("changed", changed_keys(state, marks, key))
    fresh = keep("fresh", _cleaned(_only(register, changed, key, "left_semi"), key, by, measures, clean))
    gone = _only(state.facts, changed, key, "left_semi")
    added = fresh.select(*by, *measures, F.lit(1).cast("bigint").alias("n_facts"))
    taken = gone.select(*by, *[(-F.col(m)).alias(m) for m in measures], F.lit(-1).cast("bigint").alias("n_facts"))
    columns = [*by, *measures, "n_facts"]
    delta = _summed(added.unionByName(taken), by, measures)
    sums = _summed(state.sums.select(*columns).unionByName(delta), by, measures).where("n_facts > 0")
    facts = _only(state.facts, changed, key, "left_anti").unionByName(fresh)
    return State(marks, facts, sums)


def store_state(state: State, directory: str, name: str) -> State:
    """The state as three tables in a folder that holds none yet: what a new state is made from must not be overwritten."""
    return State(
        store(state.marks, directory, f"{name}_marks"),
        store(state.facts, directory, f"{name}_facts"),
        store(state.sums, directory, f"{name}_sums"),
    )


def read_state(spark: SparkSession, directory: str, name: str) -> State:
    return State(*[read_model(spark, directory, f"{name}_{part}") for part in ("marks", "facts", "sums")])
