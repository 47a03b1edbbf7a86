import hashlib
import random
import re
from collections import Counter

import pytest

from comarca.llm.anchors import without_repeated_passages
from tests.llm.data import empty, frame, rows, words


def brute(found, window):
    texts = [(r[0], re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in found]
    seen = Counter(tuple(t[i : i + window]) for _, t in texts for i in range(len(t) - window + 1))
    out = []
    for doc, t in texts:
        gone = set()
        for i in range(len(t) - window + 1):
            if seen[tuple(t[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = " ".join(w for i, w in enumerate(t) if i not in gone)
        spans = sum(1 for i in gone if i - 1 not in gone)
        out.append((doc, len(t), len(gone), spans, hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=repr)


def run(spark, found, window, **options):
    got = without_repeated_passages(frame(spark, found), window, keep_text=True, **options)
    columns = "doc_id", "n_words", "n_removed", "n_spans", "kept_sha256", "kept_text"
    return sorted((tuple(r) for r in got.select(*columns).collect()), key=repr)


@pytest.mark.parametrize("window, block_bytes", [(35, 3_000_000), (35, 4000), (6, 500)])
def test_equals_brute_force(spark, window, block_bytes):
    assert run(spark, rows(), window, block_bytes=block_bytes) == brute(rows(), window)


def passages():
    """Copies of one passage at every offset to the reference blocks, within one text too, and runs just too short."""
    rng = random.Random(5)
    passage, short = words(rng, 35), words(rng, 34)
    texts = [f"{words(rng, n)} {passage} {words(rng, 50)}" for n in range(40)]
    texts += [f"{words(rng, n)} {short} {words(rng, 50)}" for n in range(1, 20)]
    texts += [f"{passage} {words(rng, 9)} {passage}", "la " * 36, "le " * 35]
    return [(i, t, "en", "s", 0) for i, t in enumerate(texts)]


def test_every_offset(spark):
    want = brute(passages(), 35)
    assert run(spark, passages(), 35, block_bytes=3000) == want
    assert all(r[2] > 0 for r in want if r[0] < 40 or r[0] > 58)


def test_empty(spark):
    assert without_repeated_passages(empty(spark)).count() == 0
