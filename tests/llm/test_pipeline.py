import math
import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from comarca.llm.common import LOWER, UPPER
from comarca.llm.mixing import cycle_weights, source_targets
from comarca.llm.queries import oracle_sql, queries
from tests import compare
from tests.llm import data
from tests.llm.test_jaccard import brute as similar

LOW = str.maketrans(UPPER, LOWER)
SF_DIR = "/root/testdata/sf0.001"


def documents(spark, tmp_path, found):
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(found, data.SCHEMA).write.parquet(path)
    return str(tmp_path)


def test_stages_against_brute_force(spark, tmp_path):
    found = [r for i, r in enumerate(data.rows()) if r[0] is not None and r not in data.rows()[:i]]
    sf_dir = documents(spark, tmp_path, found)
    df, after = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, sf_dir)
        path = str(tmp_path / name.replace(" ", "_"))
        df.write.parquet(path)
        df = spark.read.parquet(path)
        after.append(sorted((tuple(r) for r in df.collect()), key=str))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    worded = [r for r in found if any(c.isalpha() for c in r[1] or "")]
    assert after[0] == sorted(worded, key=str)
    first = {}
    for r in sorted(worded):
        first.setdefault(r[1].translate(LOW), r)
    assert after[1] == sorted(first.values(), key=str)
    kept = {name for name, _, c in similar(list(first.values())) if name == str(c)}
    unlike = [r for r in first.values() if str(r[0]) in kept]
    assert after[2] == sorted(unlike, key=str)
    counts = Counter(r[0] for r in after[3])
    assert set(after[3]) <= set(unlike) and max(counts.values()) <= 2
    words = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r[1]))
    size, taken = defaultdict(int), defaultdict(int)
    for r in unlike:
        size[r[3]] += words(r)
        taken[r[3]] += words(r) * counts[r[0]]
    names = sorted(size, key=lambda s: (s is None, s or ""))
    targets = source_targets(size, dict(zip(names, cycle_weights(names))), Fraction(3, 2), 2)
    for s in names:
        spare = [words(r) for r in unlike if r[3] == s and counts[r[0]] < math.ceil(targets[s] / max(size[s], 1))]
        assert 0 <= targets[s] - taken[s] < max(1, *spare, 0)
    assert Counter(r[0] for r in after[4]) == counts
    assert sorted(tuple(r)[0] for r in corpus_pipeline.run(spark, sf_dir).collect()) == sorted(r[0] for r in after[4])


def test_empty_documents(spark, tmp_path):
    assert corpus_pipeline.run(spark, documents(spark, tmp_path, [])).collect() == []


def test_registered():
    numbers = sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries())
    assert numbers == list(range(1, 14))
    assert set(queries()) | {"pipeline"} <= set(entry.queries())
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, name):
    con = compare.database(SF_DIR)
    df = queries()[name](spark, SF_DIR)
    assert compare.spark_types(df) == compare.sql_types(con, oracle_sql()[name])
    got_columns, got = compare.spark_rows(df)
    assert (got_columns, got) == compare.sql_rows(con, oracle_sql()[name])
