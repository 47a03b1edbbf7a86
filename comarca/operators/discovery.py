"""What a set of tables does not say about itself: its references, its keys and its dependencies."""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from comarca.sources import store, work_folder

# Rows that may refute a key or a dependency before all rows are asked.
PROBE_ROWS = 5_000
# Of so many values of a column one is asked with all its rows, before all values are.
EVERY_VALUE = 128
# Rows times sets of columns that one task groups.
TASK_CELLS = 500_000


def discover_references(
    tables: Mapping[str, DataFrame], columns: Mapping[str, Sequence[str]], least_share: float = 1.0
) -> DataFrame:
    """Columns whose values all occur in another column: inclusion dependencies.

    Returns (child_table, child_column, parent_table, parent_column, n_values, n_missing,
    parent_is_key): the child's distinct values, how many of them the parent lacks, and whether the
    parent has each of its values once, as a key has. With ``least_share`` below 1 a reference may lack
    some values. NULL refers to nothing. Values are compared as text. A column without values
    refers to everything, so it is no child. At most 63 columns.

    Each table is read once. All values of all columns go through one shuffle, summed per column in part
    before it; what is left are the different sets of columns that have a value in common.
    """
    named = [(t, c) for t in tables for c in columns[t]]
    if len(named) > 63:
        raise ValueError("more than 63 columns")
    place = {pair: i for i, pair in enumerate(named)}
    cells = []
    for t, df in tables.items():
        own = [F.struct(F.lit(place[t, c]).alias("at"), F.col(c).cast("string").alias("value")) for c in columns[t]]
        cells.append(df.select(F.inline(F.array(*own))))
    values = reduce(DataFrame.unionByName, cells).where("value is not null")
    counted = values.groupBy("value").agg(
        *[F.count_if(F.col("at") == i).alias(f"n{i}") for i in range(len(named))]
    )
    have = F.filter(F.array(*[F.when(F.col(f"n{i}") > 0, F.lit(i)) for i in range(len(named))]), lambda i: i.isNotNull())
    often = F.filter(F.array(*[F.when(F.col(f"n{i}") > 1, F.lit(i)) for i in range(len(named))]), lambda i: i.isNotNull())
    sets = counted.groupBy(have.alias("have"), often.alias("often")).agg(F.count(F.lit(1)).alias("n"))
    # Pairs of columns, out of at most one row per set of columns.
    pairs = (
        sets.select("n", "have", "often", F.explode("have").alias("child"))
        .select("n", "child", "often", F.explode("have").alias("parent"))
        .groupBy("child", "parent")
        .agg(F.sum("n").alias("n_both"), F.max(F.array_contains("often", F.col("parent"))).alias("_repeats"))
    )
    own = pairs.where("child = parent").select("child", F.col("n_both").alias("n_values"), F.col("_repeats").alias("repeats"))
    is_key = own.select(F.col("child").alias("parent"), (~F.col("repeats")).alias("parent_is_key"))
    names = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(c).alias("c")) for t, c in named])
    return (
        pairs.where("child != parent")
        .join(own.select("child", "n_values"), "child")
        .join(is_key, "parent")
        .where(F.col("n_both") >= F.col("n_values") * least_share)
        .select(
            names[F.col("child")]["t"].alias("child_table"),
            names[F.col("child")]["c"].alias("child_column"),
            names[F.col("parent")]["t"].alias("parent_table"),
            names[F.col("parent")]["c"].alias("parent_column"),
            "n_values",
            (F.col("n_values") - F.col("n_both")).alias("n_missing"),
            "parent_is_key",
        )
    )


@dataclass
class Rules:
    """The minimal keys of a table, and the minimal dependencies of sets of columns that hold no key."""

    columns: list[str]
    keys: list[tuple[str, ...]] = field(default_factory=list)
    dependencies: list[tuple[tuple[str, ...], str]] = field(default_factory=list)

    def frame(self, spark: SparkSession) -> DataFrame:
        """(kind, determinant, dependent): a row per rule; a key's dependent is ``*``, a constant's determinant is empty."""
        rows = [("key", ",".join(k), "*") for k in self.keys]
        rows += [("dependency", ",".join(x), a) for x, a in self.dependencies]
        return spark.createDataFrame(rows, "kind string, determinant string, dependent string")

    def determined(self, given: Sequence[str]) -> set[str]:
        """The columns not among ``given`` that a part of it determines, without keys."""
        have = set(given)
        return {a for x, a in self.dependencies if a not in have and have.issuperset(x)}

    def is_minimal(self, given: Sequence[str]) -> bool:
        """Whether ``given`` holds no key and no column that its others determine."""
        have = set(given)
        if any(have.issuperset(k) for k in self.keys):
            return False
        return not any(a in have and have.issuperset(x) for x, a in self.dependencies)


Wanted = Mapping[tuple[str, ...], set[str]]


def _tested(
    df: DataFrame, wanted: Wanted, lead: str | None = None, tasks: int = 1
) -> dict[tuple[str, ...], tuple[int, set[str]]]:
    """For each set of columns the rows of its largest group, and which of the columns asked for it determines.

    One aggregation for all sets, over rows of fixed width: the set, 128 bits of its values, and 64 bits
    of each column asked for. A group has one value of a column if the smallest and the largest agree.
    Numbers per set are all that comes back.

    With ``lead``, a column of every set, the table's own rows are dealt out by it to ``tasks`` tasks, and
    each task groups what it has by all sets: a row is moved once, not once per set.
    """
    sets = [(s, sorted(rest)) for s, rest in wanted.items()]
    slots = max(len(rest) for _, rest in sets)
    used = sorted({c for s, rest in sets for c in (*s, *rest)})
    own = []
    if lead:
        own = ["_lead"]
        df = df.select(F.hash(lead).alias("_lead"), *used).repartition(tasks, "_lead")
    # A hash passes over NULL, so whether there is one is hashed too.
    halves = [F.xxhash64(F.lit(salt), c, F.col(c).isNull()).alias(f"{c} {salt}") for c in used for salt in (0, 1)]

    def half(s: Sequence[str], salt: int):
        return F.xxhash64(F.lit(len(s)), *[F.col(f"`{c} {salt}`") for c in s])

    cells = []
    for i, (s, rest) in enumerate(sets):
        asked = [F.col(f"`{c} 0`") for c in rest] + [F.lit(0).cast("bigint")] * (slots - len(rest))
        named = [v.alias(f"v{j}") for j, v in enumerate(asked)]
        cells.append(F.struct(F.lit(i).alias("i"), half(s, 0).alias("x"), half(s, 1).alias("y"), *named))
    groups = df.select(*own, *halves).select(*own, F.inline(F.array(*cells))).groupBy(*own, "i", "x", "y").agg(
        F.count(F.lit(1)).alias("n"),
        *[f(f"v{j}").alias(f"{name}{j}") for j in range(slots) for f, name in ((F.min, "low"), (F.max, "high"))],
    )
    verdicts = groups.groupBy("i").agg(
        F.max("n").alias("n"), *[F.bool_and(F.col(f"low{j}") == F.col(f"high{j}")).alias(f"one{j}") for j in range(slots)]
    )
    found = {}
    for row in verdicts.collect():
        s, rest = sets[row["i"]]
        found[s] = row["n"], {c for j, c in enumerate(rest) if row[f"one{j}"]}
    return found


def _spread(rows: DataFrame) -> DataFrame:
    """A few rows out of one task over all."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


class _Probes:
    """Some rows of a table, by which most rules are refuted before all rows are asked.

    A few thousand rows refute what few values decide. For the rest two rows must agree in columns of many
    values, so for each column all rows of some of its values are kept, chosen by hash. What these leave is
    asked of more values of a column, and last of all rows.
    """

    def __init__(self, df: DataFrame, columns: Sequence[str], n_rows: int, probe_rows: int):
        self.rows, self.columns, self.n_rows, self.size = df, columns, n_rows, probe_rows
        every = F.lit(max(1, n_rows // probe_rows))
        chosen = [F.when(F.pmod(F.xxhash64(c), every) == 0, F.lit(i)) for i, c in enumerate(columns)]
        lead = F.explode(F.filter(F.array(*chosen), lambda i: i.isNotNull())).alias("_lead")
        spark = df.sparkSession
        self.alike = store(df.select(lead, *columns), work_folder(spark), "alike")
        self.any = store(_spread(df.limit(probe_rows)), work_folder(spark), "any")
        values = df.agg(*[F.approx_count_distinct(c) for c in columns]).first()
        self.n_values = dict(zip(columns, values))
        # About the share of the rows that a column's most frequent value has; it only decides how rows are dealt out.
        cells = [F.struct(F.lit(i).alias("i"), F.hash(c).alias("x")) for i, c in enumerate(columns)]
        counts = df.sample(min(1.0, 20 * probe_rows / n_rows), seed=0).select(F.inline(F.array(*cells))).groupBy("i", "x").count()
        shares = counts.groupBy("i").agg((F.max("count") / F.sum("count")).alias("share")).collect()
        self.share = dict.fromkeys(columns, 1.0) | {columns[row["i"]]: row["share"] for row in shares}

    def left(self, wanted: Wanted) -> Wanted:
        """The sets that may still be a key or determine one of the columns they are asked for."""
        wanted = self._after(self.any, wanted)
        left = {}
        for c, part in self._by_lead(wanted).items():
            rows = self.alike.where(F.col("_lead") == self.columns.index(c)).drop("_lead")
            left |= self._after(_spread(rows.limit(4 * self.size)), part)  # a frequent value can be in it
        if self.n_rows < 4 * self.size * EVERY_VALUE:
            return left
        out = {}
        for c, part in self._by_lead(left).items():
            out |= self._after(self.rows.where(F.pmod(F.xxhash64(c), F.lit(EVERY_VALUE)) == 0), part)
        return out

    def settled(self, wanted: Wanted) -> dict[tuple[str, ...], tuple[int, set[str]]]:
        """What all rows say of the sets, as ``_tested`` gives it."""
        least = int(self.rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        found = {}
        for lead, part in self._dealt(wanted).items():
            found |= _tested(self.rows, part, lead, max(least, self.n_rows * len(part) // TASK_CELLS))
        return found

    def _by_lead(self, wanted: Wanted) -> dict[str, Wanted]:
        """The sets by their column of most values."""
        out: dict[str, dict] = {}
        for s, rest in wanted.items():
            out.setdefault(max(s, key=self.n_values.__getitem__), {})[s] = rest
        return out

    def _dealt(self, wanted: Wanted) -> dict[str | None, Wanted]:
        """The sets by few columns that deal the rows out evenly; under None those that have no such column."""
        left, out = dict(wanted), {}
        while left:
            cells = self.n_rows * len(left)
            in_sets = Counter(c for s in left for c in s if self.share[c] * cells <= 4 * TASK_CELLS)
            lead = max(in_sets, key=lambda c: (in_sets[c], self.n_values[c]), default=None)
            out[lead] = {s: left.pop(s) for s in list(left) if lead is None or lead in s}
        return out

    def _after(self, rows: DataFrame, wanted: Wanted) -> Wanted:
        if not wanted:
            return {}
        found = _tested(rows, wanted)
        out = {}
        for s, rest in wanted.items():
            most, holds = found.get(s, (0, rest))
            if most <= 1 or rest & holds:
                out[s] = rest & holds if most > 1 else rest
        return out


def discover_rules(
    df: DataFrame, columns: Sequence[str] | None = None, largest: int = 3, probe_rows: int = PROBE_ROWS
) -> Rules:
    """Minimal keys of up to ``largest`` columns, and minimal dependencies of as many columns on another.

    NULL counts as a value. Rows that repeat as a whole leave a table without a key. Columns with
    one value depend on nothing. An empty table has no rules. At most 63 columns.

    The lattice of column sets is searched level by level. A set that holds a key, or a column that its
    others determine, cannot be minimal and is left out with all above it. The others of a level are
    tested together: first on some rows, which can only refute, then what is left on all rows, so the
    full test is made for little more than the rules that hold. For that the rows are dealt out by a
    few columns, not once per set. Values of a set are told apart by 128-bit hashes.
    """
    columns = list(columns or df.columns)
    if len(columns) > 63:
        raise ValueError("more than 63 columns")
    rules = Rules(columns)
    df = df.select(*columns)
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if df.rdd.getNumPartitions() < tasks:  # every level reads all rows: a table out of few files is dealt anew once
        df = store(_spread(df), work_folder(df.sparkSession), "rows")
    n_rows, constant = _tested(df, {(): set(columns)}).get((), (0, set()))
    if not n_rows:
        return rules
    if n_rows == 1:
        rules.keys.append(())
        return rules
    rules.dependencies += [((), c) for c in columns if c in constant]
    free = [c for c in columns if c not in constant]
    probes = _Probes(df, columns, n_rows, probe_rows) if n_rows > probe_rows else None
    for size in range(1, min(largest, len(free)) + 1):
        sets = [s for s in combinations(free, size) if rules.is_minimal(s)]
        wanted = {s: set(free) - set(s) - rules.determined(s) for s in sets}
        if probes:
            wanted = probes.left(wanted)
        if not wanted:
            continue
        found = probes.settled(wanted) if probes else _tested(df, wanted)
        for s, rest in wanted.items():
            most, holds = found[s]
            if most == 1:
                rules.keys.append(s)
            else:
                rules.dependencies += [(s, c) for c in columns if c in rest & holds]
    return rules
