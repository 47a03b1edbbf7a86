import heapq
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from comarca.llm import byte_bpe
from comarca.llm.byte_bpe import ChunkEncoder
from comarca.llm.common import tokenizer_file
from comarca.llm.huffman import Code, code_lengths, encoded_ids
from tests.llm import data

PATH = tokenizer_file("byte_bpe_50k.json")


def huffman_cost(counts):
    heap, cost = [c for c in counts if c], 0
    heapq.heapify(heap)
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        cost += a
        heapq.heappush(heap, a)
    return cost


def best_limited(counts, bits):
    """Smallest cost of a prefix code with so many bits at most, by trying all sums of lengths."""
    counts = sorted((c for c in counts if c), reverse=True)
    best = {(0, 0): 0}
    for c in counts:
        fresh = {}
        for (space, last), cost in best.items():
            for length in range(max(1, last), bits + 1):
                used = space + (1 << bits - length)
                if used <= 1 << bits:
                    key = used, length
                    fresh[key] = min(fresh.get(key, 1 << 60), cost + c * length)
        best = fresh
    return min(best.values())


@pytest.mark.parametrize("seed", range(20))
def test_lengths_are_best(seed):
    rng = np.random.default_rng(seed)
    counts = rng.integers(0, 1000, rng.integers(2, 9)) ** rng.integers(1, 3)
    counts[0] += 1
    counts[1] += 1
    assert (counts * code_lengths(counts, 18)).sum() == huffman_cost(counts.tolist())
    assert (counts * code_lengths(counts, 3)).sum() == best_limited(counts.tolist(), 3)


def test_few_symbols():
    assert code_lengths(np.zeros(5, int)).sum() == 0
    assert code_lengths(np.array([0, 3, 0])).tolist() == [0, 1, 0]
    with pytest.raises(ValueError):
        code_lengths(np.ones(5, int), 2)


def test_codes_are_canonical_and_prefix_free():
    lengths = code_lengths(np.array([50, 20, 20, 5, 5, 1, 0, 1]))
    code = Code(lengths)
    texts = sorted((int(n), i, format(int(code.codes[i]), f"0{n}b")) for i, n in enumerate(lengths) if n)
    values = [int(t.ljust(30, "0"), 2) for _, _, t in texts]
    assert values == sorted(values)
    assert not any(a != b and b.startswith(a) for _, _, a in texts for _, _, b in texts)


@pytest.mark.parametrize("n", [0, 1, 6, 7, 8, 1000, 40_001])
def test_blocks_round_trip(n):
    rng = np.random.default_rng(n)
    counts = (1e6 / np.arange(1, 3000) ** 1.5).astype(int) + 1
    code = Code(code_lengths(counts))
    ids = rng.choice(len(counts), n, p=counts / counts.sum())
    payload, checkpoints = code.encode(ids, 7)
    assert len(checkpoints) == 8 * -(-n // 7)
    assert (code.decode(payload, checkpoints, n, 7) == ids).all()


def test_chunks_equal_the_library():
    texts = [r[1] or "" for r in data.rows()] + ["a  b", "a \nb", " a", "a\xa0 b", "x \x85y", "it 's 've", "\n \n"]
    for literal in (False, True):
        whole = Tokenizer.from_file(PATH)
        whole.encode_special_tokens = literal
        got = ChunkEncoder(PATH, literal).encode(texts)
        want = [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]
        assert [np.frombuffer(g, "<u2").tolist() for g in got] == want


def test_chunks_are_forgotten_and_learnt_again(monkeypatch):
    monkeypatch.setattr(byte_bpe, "CACHE_CHUNKS", 5)
    monkeypatch.setattr(byte_bpe, "SLICE_CHARS", 100)
    texts = [r[1] or "" for r in data.rows()][:30]
    whole = Tokenizer.from_file(PATH)
    got = ChunkEncoder(PATH).encode(texts)
    assert [np.frombuffer(g, "<u2").tolist() for g in got] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def expected(found):
    whole, out, start = Tokenizer.from_file(PATH), [], 0
    for r in sorted(found, key=lambda r: (r[0] is not None, r[0])):
        ids = whole.encode(r[1] or "", add_special_tokens=False).ids + [0]
        out.append((r[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_files_give_the_ids_back(spark):
    found = [r for i, r in enumerate(data.rows()) if r[0] is not None and r not in data.rows()[:i]]
    got = [tuple(r) for r in encoded_ids(data.frame(spark, found), PATH).select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    assert sorted(got) == expected(found)


def test_repeated_rows_and_null_ids(spark):
    found = data.rows()
    got = [tuple(r) for r in encoded_ids(data.frame(spark, found), PATH).select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    pick = lambda rows: Counter((r[0], r[2], r[3]) for r in rows)
    assert pick(got) == pick(expected(found))
    line = sorted(got, key=lambda r: r[1])
    assert [r[1] for r in line] == np.cumsum([0, *(r[2] for r in line[:-1])]).tolist()
    assert [r[0] or -1 for r in line] == sorted(r[0] or -1 for r in line)


def test_empty_table(spark):
    assert encoded_ids(data.empty(spark), PATH).collect() == []
