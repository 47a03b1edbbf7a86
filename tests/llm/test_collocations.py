import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from comarca.llm.collocations import collocations, tile_counts
from tests.llm.data import empty, frame, rows, words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(found, min_count, top):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, *_ in found:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            ws = re.findall("[^ \t]+", piece)
            n[lang] += len(ws)
            for m in range(1, 6):
                f[lang].update(tuple(ws[i : i + m]) for i in range(len(ws) - m + 1))
    out = []
    for lang, counts in f.items():
        often = {p: a for p, a in counts.items() if len(p) > 1 and a >= min_count}
        held = set()
        for p, a in often.items():
            held |= {p[i : i + m] for m in range(2, len(p)) for i in range(len(p) - m + 1) if 100 * a >= 100 * counts[p[i : i + m]]}
        scored = []
        for p, a in often.items():
            if p not in held:
                cut = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-cut[0], -a, " ".join(p).encode(), counts[p[: cut[1]]], counts[p[cut[1] :]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def texts():
    rng = random.Random(11)
    vocabulary = [words(rng, 1) for _ in range(60)]
    fixed = ["in spite of the fact", "Ño Ñandú año", "of the", "ab ab ab"]
    out = []
    for i in range(300):
        parts = [rng.choice(fixed) if rng.random() < 0.2 else rng.choice(vocabulary) for _ in range(rng.randint(0, 60))]
        text = "".join(p + rng.choice([" "] * 6 + ["\t", "  ", ", ", ".", "\n", "\r\n", "\xa0"]) for p in parts)
        out.append((i, text.title() if i % 9 == 0 else text, rng.choice(["en", "de", None]), "s", 0))
    return out


@pytest.mark.parametrize("min_count, top, size", [(5, 2000, 8_000_000), (2, 50, 2000), (12, 2000, 300)])
def test_equals_brute_force(spark, min_count, top, size):
    found = texts() + rows()
    got = collocations(frame(spark, found), min_count, top=top, unit_bytes=size)
    assert sorted(tuple(r) for r in got.collect()) == brute(found, min_count, top)


def test_nothing_frequent(spark):
    assert collocations(frame(spark, rows()[:3]), 1000).count() == 0


def test_empty(spark):
    assert collocations(empty(spark)).count() == 0


@pytest.mark.parametrize("size", [10, 5000, 200_000])
def test_tiles(size):
    """Dense and sparse tiles, with and without weights, ids far apart."""
    rng = np.random.default_rng(size)
    left, right = rng.integers(0, 40, size), rng.integers(0, 1500, size)
    left[::7] += 1 << 33
    right[::5] += 1 << 35
    n = rng.integers(1, 9, size)
    for weights in (None, n):
        tiles, of, cell, total, pair = tile_counts(left, right, weights)
        want = Counter()
        for i, j, w in zip(left.tolist(), right.tolist(), (n if weights is not None else np.ones(size, int)).tolist()):
            want[i, j] += w
        got = ((tiles[of] >> 32) << 4 | cell >> 10), ((tiles[of] & 0xFFFFFFFF) << 10 | cell & 1023)
        assert dict(zip(zip(got[0].tolist(), got[1].tolist()), total.tolist())) == want
        assert (got[0][pair] == left).all() and (got[1][pair] == right).all()
