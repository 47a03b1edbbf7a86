"""Tables in third normal form out of the dependencies of a flat one."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from comarca.operators.discovery import Rules
from comarca.operators.modelling import dim_extract

Dependency = tuple[tuple[str, ...], str]


@dataclass(frozen=True)
class Table:
    key: tuple[str, ...]
    columns: tuple[str, ...]


def closure(given: Iterable[str], dependencies: Sequence[Dependency]) -> set[str]:
    """All columns that the given ones determine, themselves included."""
    have, grew = set(given), True
    while grew:
        grew = False
        for x, a in dependencies:
            if a not in have and have.issuperset(x):
                have.add(a)
                grew = True
    return have


def minimal_cover(dependencies: Sequence[Dependency]) -> list[Dependency]:
    """As few dependencies from which all others follow; of equal choices the earlier ones stay."""
    reduced = []
    for x, a in dependencies:
        for c in reversed(x):  # a column on the left that the rest makes up for
            rest = tuple(o for o in x if o != c)
            if a in closure(rest, dependencies):
                x = rest
        if (x, a) not in reduced and a not in x:
            reduced.append((x, a))
    for d in reversed(list(reduced)):
        others = [o for o in reduced if o != d]
        if d[1] in closure(d[0], others):
            reduced = others
    return reduced


def synthesize(rules: Rules) -> list[Table]:
    """The tables to build, the one with a key of the flat table first.

    One table per determinant of a minimal cover; determinants that determine each other share
    one, under the first of them. Without a table that holds a key of the flat table, one with
    just that key (or, if it has none, all columns that no others determine) is added, so that the
    join is lossless. Columns with one value stay where the key is.
    """
    place = {c: i for i, c in enumerate(rules.columns)}
    by_place = lambda names: tuple(sorted(names, key=place.__getitem__))
    given = [(k, c) for k in rules.keys for c in rules.columns if c not in k]
    given += [(x, a) for x, a in rules.dependencies if x]
    given.sort(key=lambda d: (len(d[0]), [place[c] for c in d[0]], place[d[1]]))
    cover = minimal_cover(given)
    tables: dict[frozenset, tuple[tuple[str, ...], set[str]]] = {}
    for x, a in cover:
        reach = frozenset(closure(x, cover))
        key, columns = tables.setdefault(reach, (x, set()))
        columns.update(x, (a,))
    found = [Table(key, by_place(columns)) for key, columns in tables.values()]
    found = [t for t in found if not any(set(t.columns) < set(o.columns) for o in found)]
    all_columns = set(rules.columns)
    rest = rules.columns
    for c in reversed(rules.columns):  # a key of the flat table, if need be all of it
        fewer = [o for o in rest if o != c]
        if closure(fewer, cover) == all_columns:
            rest = fewer
    holds_key = [t for t in found if closure(t.columns, cover) == all_columns]
    if not holds_key:
        holds_key = [Table(tuple(rest), tuple(rest))]
        found = holds_key + found
    return sorted(found, key=lambda t: t not in holds_key)


def decompose(df: DataFrame, tables: Sequence[Table]) -> dict[str, DataFrame]:
    """The rows of each table, named after its key."""
    return {"_".join(t.key): dim_extract(df, t.columns) for t in tables}


def recombine(parts: Mapping[str, DataFrame], tables: Sequence[Table]) -> DataFrame:
    """The flat table again, each row once: every table joined on the columns it shares with those before.

    A NULL meets a NULL.
    """
    waiting = list(zip(tables, parts.values()))
    table, joined = waiting.pop(0)
    have = set(table.columns)
    while waiting:
        at = next((i for i, (t, _) in enumerate(waiting) if have.issuperset(t.key)), None)
        if at is None:  # another determinant of the table stands for its key
            at = next(i for i, (t, _) in enumerate(waiting) if have.intersection(t.columns))
        table, part = waiting.pop(at)
        shared = [c for c in table.columns if c in have]
        renamed = part.select(*[F.col(c).alias(f"_{c}" if c in shared else c) for c in table.columns])
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in shared]
        joined = joined.join(renamed, same).drop(*[f"_{c}" for c in shared])
        have.update(table.columns)
    return joined
