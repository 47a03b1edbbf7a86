import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from comarca.llm import repeats, shared
from comarca.llm.repeats import repeated_windows, without_repeats
from tests.llm import data


def brute(texts, length):
    raws = [(t or "").encode() for t in texts]
    counts = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for raw in raws:
        gone = np.zeros(len(raw) + 1, bool)
        for i in range(len(raw) - length + 1):
            if counts[raw[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def check(spark, found, length=200):
    got = without_repeats(data.frame(spark, found), length)
    got = [(str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()]
    want = [(str(r[0]), *w) for r, w in zip(found, brute([r[1] for r in found], length))]
    assert sorted(got) == sorted(want)


def test_all_awkward_rows(spark):
    check(spark, data.rows())


def test_passages_that_only_texts_without_an_id_share(spark):
    rng = random.Random(9)
    passage, other = data.words(rng, 70), data.words(rng, 70)
    some = lambda: data.words(rng, 20)
    found = [(1, f"{some()} {passage} {some()}", None, None, 0), (None, f"{passage} {some()}", None, None, 0)]
    found += [(None, f"{some()} {other}", None, None, 0), (None, f"{other} {some()}", None, None, 0), (2, some(), None, None, 0)]
    found += [found[1], (3, f"{some()} {other}", None, None, 0)]
    check(spark, found)


@pytest.mark.parametrize("length", [32, 100, 255])
def test_passages_of_about_that_length(spark, length, monkeypatch):
    monkeypatch.setattr(shared, "FLUSH_TOKENS", 20)
    monkeypatch.setattr(repeats, "SLICE_BYTES", 3000)
    rng = random.Random(length)
    some = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    shared_parts = [some(length + rng.randint(-3, 5)) for _ in range(8)]
    found = []
    for i in range(60):
        parts = [rng.choice([some(rng.randint(0, 200)), rng.choice(shared_parts)]) for _ in range(rng.randint(1, 5))]
        found.append((i, "".join(parts), None, None, 0))
    check(spark, found, length)


def test_a_passage_in_every_text_and_runs_of_one_character(spark):
    rng = random.Random(4)
    passage = data.words(rng, 60)
    found = [(i, data.words(rng, rng.randint(0, 30)) + passage + data.words(rng, 10), None, None, 0) for i in range(80)]
    found += [(100, "z" * 201, None, None, 0), (101, "z" * 199, None, None, 0), (102, "q" * 200, None, None, 0), (103, "\0" * 300, None, None, 0)]
    check(spark, found)


def test_only_snippets_that_agree_beside_the_anchor_are_sorted():
    rng = random.Random(2)
    some = lambda n: bytes(rng.choices(range(97, 123), k=n))
    anchor, before, after = some(32), some(100), some(120)
    tail = before[-60:] + anchor + after[:108]
    snippets = [(some(168) + anchor + some(168), 168), (some(90) + tail, 150), (some(40) + tail + some(20), 100)]
    snippets += [(some(130) + anchor + after[:70], 130), (before[-84:] + anchor + some(84), 84), (before + anchor + some(90), 100)]
    assert repeats.alike_snippets(snippets) == [1, 2, 4, 5]
    twins = repeated_windows([s for s, _ in snippets])
    assert [bool(t.any()) for t in twins] == [False, True, True, False, False, False]


def test_windows_that_overlap_themselves():
    assert [w.tolist() for w in repeated_windows([b"aaaaa", b"bcd", b"abcd", b"xbc"], 3)] == [
        [True] * 3, [True], [False, True], [False]]


def test_empty_table(spark):
    assert without_repeats(data.empty(spark)).collect() == []
    check(spark, [(1, None, None, None, 0), (2, "", None, None, 0)])
