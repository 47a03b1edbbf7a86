import hashlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from comarca.llm.common import LOWER, UPPER
from comarca.llm.exact import content_hash, drop_exact, exact_groups
from comarca.llm.queries import oracle_sql
from tests.llm import data

LOW = str.maketrans(UPPER, LOWER)


def brute(rows, pick):
    groups = defaultdict(list)
    for r in rows:
        groups[(r[1] or "").translate(LOW)].append(r[0])
    out = []
    for text, ids in groups.items():
        named = [i for i in ids if i is not None]
        keep = pick(named) if named else None
        sha = hashlib.sha256(text.encode()).hexdigest()
        out += [(i, keep, len(ids), i == keep, sha) for i in ids]
    return sorted(out, key=repr)


@pytest.mark.parametrize("hash_of", [content_hash, lambda c: F.substring(F.md5(c), 1, 1)], ids=["md5", "colliding"])
@pytest.mark.parametrize("keep", ["min", "max"])
def test_equals_brute_force(spark, keep, hash_of):
    got = [tuple(r) for r in exact_groups(data.frame(spark), keep, hash_of=hash_of).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()]
    want = brute([r[:2] for r in data.rows()], min if keep == "min" else max)
    assert sorted(got, key=repr) == want


def test_null_and_empty_are_one_group(spark):
    got = exact_groups(data.frame(spark, [(1, None, None, None, 0), (2, "", None, None, 0)])).collect()
    assert {(r.doc_id, r.keep_id, r.group_size) for r in got} == {(1, 1, 2), (2, 1, 2)}


def test_a_group_of_half_the_rows(spark):
    found = [(i, "Same" if i % 2 else f"text {i}", None, None, 0) for i in range(3000)]
    got = {r.doc_id: r for r in exact_groups(data.frame(spark, found), "max").collect()}
    assert len(got) == 3000 and got[5].keep_id == 2999 and got[5].group_size == 1500 and got[4].kept


def test_dropping_keeps_columns_and_each_text_once(spark):
    docs = data.frame(spark)
    got = drop_exact(docs)
    assert got.columns == docs.columns
    texts = [(r.text or "").translate(LOW) for r in got.collect()]
    assert sorted(texts) == sorted({(r[1] or "").translate(LOW) for r in data.rows()})


def test_empty_table(spark):
    assert exact_groups(data.empty(spark)).collect() == []
    assert drop_exact(data.empty(spark)).collect() == []


def test_repeated_rows_equal_the_sql(spark):
    """Rows under one id, equal or differing in case, all count and come back."""
    found = [(1, "A text", "en", "s", 0), (1, "A text", "en", "s", 0), (1, "a TEXT", "en", "s", 0), (2, "a text", "en", "s", 0), (3, "b", "en", "s", 0)]
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", [r[:2] for r in found])
    want = con.execute(oracle_sql()["op10_exact_dedup"]).fetchall()
    got = [tuple(r) for r in exact_groups(data.frame(spark, found), "max").select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()]
    assert sorted(got) == sorted(want) and len(got) == 5
    assert drop_exact(data.frame(spark, found)).count() == 2
