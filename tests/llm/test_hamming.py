import numpy as np
import pytest

from comarca.llm.hamming import nearest_codes, sign_code


def brute(rows, queries, k):
    rows = {r for r in rows if None not in r}
    out = set()
    for q, code in {q for q in queries if None not in q}:
        near = sorted((bin((code ^ c) & (1 << 64) - 1).count("1"), i) for i, c in rows if i != q)[:k]
        out |= {(q, rank, i, d) for rank, (d, i) in enumerate(near, 1)}
    return out


def run(spark, rows, k, only=lambda i: True):
    df = spark.createDataFrame(rows, "vec_id long, code long").selectExpr("*", "1 as id", "2 as query", "3 as salt")
    got = [tuple(r) for r in nearest_codes(df, df.filter("vec_id is null or vec_id % 5 = 0"), k).select(
        "query_id", "rank", "neighbor_id", "distance").collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(rows, [r for r in rows if r[0] is None or r[0] % 5 == 0], k)


@pytest.mark.parametrize("k", [1, 4])
@pytest.mark.parametrize("flips", [3, 20, 64])
def test_equals_brute_force(spark, k, flips):
    rng = np.random.default_rng(flips)
    centres = rng.integers(-(1 << 63), 1 << 63, 3)
    rows = []
    for i in range(150):
        code = int(centres[i % 3])
        for b in rng.integers(0, 64, rng.integers(0, flips)):
            code ^= 1 << int(b) if b < 63 else -(1 << 63)
        rows.append((i, code))
    run(spark, rows, k)


def test_many_equal_codes_ties_nulls_and_repeats(spark):
    rows = [(i, 5) for i in range(60)] + [(100 + i, 5 ^ 1 << i) for i in range(9)] + [(200, -1), (200, -1), (None, 5), (205, None)]
    run(spark, rows, 4)


def test_fewer_rows_than_asked_for(spark):
    run(spark, [(0, 1), (5, -1), (7, 0)], 10)


def test_empty(spark):
    run(spark, [], 3)


def test_signs(spark):
    rows = [(1, [0.5, -1.0, 0.0, 2.0]), (2, None), (3, [-1.0] * 63 + [1.0]), (4, [])]
    df = spark.createDataFrame(rows, "i int, v array<float>")
    got = {r.i: r.code for r in df.select("i", sign_code(df.v).alias("code")).collect()}
    assert got == {1: 0b1001, 2: None, 3: -(1 << 63), 4: 0}
