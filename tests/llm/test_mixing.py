import re
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest

from comarca.llm.mixing import cycle_weights, fit_budget, mix_sources, mixed, source_targets
from tests.llm import data


@pytest.mark.parametrize("seed", range(30))
def test_fit_is_as_near_as_can_be(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.choice(np.arange(0, 40), rng.integers(1, 6), replace=False)
    counts = rng.integers(1, 5, len(sizes))
    budget = int(rng.integers(0, (sizes * counts).sum() + 3))
    take = fit_budget(sizes, counts, budget)
    assert (0 <= take).all() and (take <= counts).all()
    reach = {0}
    for s, c in zip(sizes, counts):
        reach = {r + k * int(s) for r in reach for k in range(c + 1)}
    spread = [c * budget // max(1, int((sizes * counts).sum())) for c in counts]
    left = budget - int(sum(s * t for s, t in zip(sizes, spread)))
    reach = {0}
    for s, c, t in zip(sizes, counts, spread):
        reach = {r + k * int(s) for r in reach for k in range(c - (t if s else 0) + 1)}
    best = max((r for r in reach if r <= left), default=0)
    assert int((sizes * take).sum()) == min(budget, int((sizes * counts).sum())) - (left - best if (sizes * counts).sum() > budget else 0)


def test_large_budgets_are_met():
    sizes, counts = np.array([3, 700, 90_000, 5001]), np.array([10**6, 10**6, 5, 10**5])
    for budget in (10**9 + 1, 123_456_789):
        assert abs(int((sizes * fit_budget(sizes, counts, budget)).sum()) - budget) < 3


def test_targets():
    got = source_targets({"a": 10, "b": 100, None: 40}, {"a": 3, "b": 1, None: 2}, Fraction(3, 2), 2)
    assert got == {"a": 20, None: 80, "b": 125}


def test_mix(spark):
    got = mix_sources(data.frame(spark)).collect()
    found = data.rows()
    assert sorted(r.doc_id is None or r.doc_id for r in got) == sorted(r[0] is None or r[0] for r in found)
    size, taken = defaultdict(int), defaultdict(int)
    by_text = defaultdict(set)
    for r in found:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
        size[r[3]] += n
        by_text[r[0]].add(n)
    for r in got:
        assert r.size in by_text[r.doc_id] and r.taken == r.copies * r.size and 0 <= r.copies <= 2
        assert r.source_size == size[r.source]
        taken[r.source] += r.taken
    names = sorted(size, key=lambda s: (s is None, s or ""))
    targets = source_targets(size, dict(zip(names, cycle_weights(names))), Fraction(3, 2), 2)
    assert {r.source: r.target for r in got} == {s: float(t) for s, t in targets.items()}
    for s in names:  # but for texts that are too long for what is left
        spare = [r.size for r in got if r.source == s and r.copies < 2 and r.size]
        assert 0 <= targets[s] - taken[s] < min([*spare, 10**9]) or targets[s] - taken[s] < 1


def test_reruns_and_partitions_agree(spark):
    rows = lambda df: sorted((r.doc_id or -1, r.size, r.taken) for r in df.collect())
    docs = data.frame(spark, [(i, "w " * (i % 4), None, f"s{i % 2}", 0) for i in range(500)])
    assert rows(mix_sources(docs)) == rows(mix_sources(docs.repartition(11)))


def test_one_length_for_all(spark):
    found = [(i, "one two", None, "s" if i % 3 else "t", 0) for i in range(3000)]
    got = mix_sources(data.frame(spark, found)).collect()
    assert abs(sum(r.taken for r in got) - 9000) <= 8


def test_rows_of_the_mix(spark):
    docs = data.frame(spark, [(i, "one two", None, f"s{i % 3}", 0) for i in range(90)])
    got = mixed(docs)
    assert got.columns == docs.columns
    counts = {r.doc_id: r["count"] for r in got.groupBy("doc_id").count().collect()}
    want = {r.doc_id: r.copies for r in mix_sources(docs).collect() if r.copies}
    assert counts == want


def test_empty_and_wordless_tables(spark):
    assert mix_sources(data.empty(spark)).collect() == []
    got = mix_sources(data.frame(spark, [(1, None, None, None, 0), (2, " ", None, "s", 0)])).collect()
    assert [(r.size, r.target, r.taken) for r in got] == [(0, 0.0, 0)] * 2
