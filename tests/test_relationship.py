import hashlib
import itertools
import math
import random

import numpy as np
import pytest

from comarca.operators.relationship import POISSON_UPTO, relationship_interval, relationship_kendall

SCHEMA = "dep_id long, a long, b long, weight string, bit string"


def frame(spark, pairs):
    return spark.createDataFrame([(i, *p, "w", "b") for i, p in enumerate(pairs)], SCHEMA)


def tau_b(pairs):
    both = [p for p in pairs if None not in p]
    signs = [((a > c) - (a < c), (b > d) - (b < d)) for (a, b), (c, d) in itertools.combinations(both, 2)]
    span = math.sqrt(sum(x * x for x, _ in signs)) * math.sqrt(sum(y * y for _, y in signs))
    return len(both), sum(x * y for x, y in signs) / span if span else None


@pytest.mark.parametrize("seed, values", [(1, 4), (2, 25), (3, 10_000)])
def test_kendall_equals_all_pairs(spark, seed, values):
    rng = random.Random(seed)
    pairs = [(a := rng.randrange(values), a // 2 + rng.randrange(values)) for _ in range(120)] + [(None, 1), (2, None)]
    pairs += [(1, 1)] * 60
    n, tau = relationship_kendall(frame(spark, pairs), "a", "b").first()
    assert n == 180 and tau == pytest.approx(tau_b(pairs)[1], abs=1e-12)


def test_kendall_of_few_rows(spark):
    pairs = [[], [(1, 2)], [(1, 2), (1, 3)], [(1, 2), (2, 3)], [(1, 3), (2, 2)]]
    found = [tuple(relationship_kendall(frame(spark, p), "a", "b").first()) for p in pairs]
    assert found == [(0, None), (1, None), (2, None), (2, 1.0), (2, -1.0)]


def draws(key, replicate, seed=7):
    digest = hashlib.md5(f"{seed}:{key}:{replicate // 4}".encode()).hexdigest()
    u = int(digest[replicate % 4 * 8 :][:8], 16)
    return sum(u >= upto for upto in POISSON_UPTO)


def test_interval_equals_repeated_rows(spark):
    rng = random.Random(5)
    pairs = [(a := rng.randrange(100), 3 * a + rng.randrange(90)) for _ in range(80)] + [(None, 1)]
    r, slope = [], []
    for replicate in range(30):
        rows = [p for i, p in enumerate(pairs[:80]) for _ in range(draws(i, replicate))]
        x, y = np.array(rows, float).T
        r.append(np.corrcoef(x, y)[0, 1])
        slope.append(np.polyfit(x, y, 1)[0])
    df = frame(spark, pairs)
    got = {row[0]: row[1:] for row in relationship_interval(df, "dep_id", "a", "b", replicates=30, level=0.9).collect()}
    for name, values in (("r", r), ("slope", slope)):
        assert got[name][0] == 30
        assert got[name][1:] == pytest.approx(np.quantile(values, [0.05, 0.95]), abs=1e-9)
    again = relationship_interval(df.repartition(7), "dep_id", "a", "b", replicates=30, level=0.9).collect()
    assert {row[0]: [round(v, 9) for v in row[1:]] for row in again} == {k: [round(v, 9) for v in row] for k, row in got.items()}


def test_interval_of_nothing_and_of_constants(spark):
    assert relationship_interval(frame(spark, []), "dep_id", "a", "b", 10).collect() == []
    got = {row[0]: tuple(row[1:]) for row in relationship_interval(frame(spark, [(3, i) for i in range(9)]), "dep_id", "a", "b", 10).collect()}
    assert got == {"r": (0, None, None), "slope": (0, None, None)}


def test_draws_have_mean_and_variance_one():
    found = np.array([draws(key, replicate) for key in range(200) for replicate in range(100)])
    assert abs(found.mean() - 1) < 0.03 and abs(found.var() - 1) < 0.05
