import zlib
from collections import Counter, defaultdict

from comarca.llm.sharding import shard_by_bytes
from tests.llm import data


def check(got, found, n_shards):
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in found)
    want = Counter((r[0], len((r[1] or "").encode()) + bool(True), zlib.crc32((r[1] or "").encode())) for r in found)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    shards = defaultdict(list)
    for r in got:
        shards[r.shard].append(r)
    for rows in shards.values():
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
    line = sorted(got, key=lambda r: (r.shard, r.slot))
    ids = [-1 if r.doc_id is None else r.doc_id for r in line]
    assert ids == sorted(ids)
    total, at = sum(r.size for r in got), 0
    for r in line:
        assert r.shard == n_shards * (2 * at + r.size) // (2 * total)
        at += r.size


def test_contiguous_and_cut_at_equal_targets(spark):
    for n in (1, 3, 8):
        check(shard_by_bytes(data.frame(spark), n).collect(), data.rows(), n)


def test_near_equal_bytes(spark):
    found = [(i * 7 % 2000, "x" * (i % 50), None, None, 0) for i in range(2000)]
    sizes = Counter()
    for r in shard_by_bytes(data.frame(spark, found), 8).collect():
        sizes[r.shard] += r.size
    assert len(sizes) == 8 and max(sizes.values()) - min(sizes.values()) <= 2 * 51


def test_one_id_for_a_third_of_the_rows(spark):
    found = [(7 if i % 3 == 0 else i, f"t{i}", None, None, 0) for i in range(900)]
    check(shard_by_bytes(data.frame(spark, found), 8).collect(), found, 8)


def test_empty_table(spark):
    assert shard_by_bytes(data.empty(spark)).collect() == []
