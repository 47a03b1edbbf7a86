import random
import re
from collections import defaultdict

import pytest

from comarca.llm import shared
from comarca.llm.common import LOWER, UPPER
from comarca.llm.components import components
from comarca.llm.jaccard import drop_similar, similar_groups
from comarca.llm.shingles import shingle_sets
from tests.llm import data

LOW = str.maketrans(UPPER, LOWER)


def shingles(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(LOW)) if x]
    if len(w) < 5:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def brute(found):
    sets = [(r[0], shingles(r[1])) for r in found]
    root = list(range(len(sets)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[max(top(i), top(j))] = min(top(i), top(j))
    smallest = defaultdict(lambda: None)
    for i, (name, _) in enumerate(sets):
        if name is not None:
            smallest[top(i)] = min(name, smallest[top(i)] if smallest[top(i)] is not None else name)
    return sorted(((str(name), len(s), smallest[top(i)] if s else name) for i, (name, s) in enumerate(sets)), key=str)


def got(df):
    rows = df.select("doc_id", "n_shingles", "component_id").collect()
    return sorted(((str(r.doc_id), r.n_shingles, r.component_id) for r in rows), key=str)


def test_equals_brute_force(spark):
    assert got(similar_groups(data.frame(spark))) == brute(data.rows())


def edited(rng, words, share):
    return [rng.choice(["x", "y", "z"]) + w if rng.random() < share else w for w in words]


@pytest.mark.parametrize("seed", range(3))
def test_near_copies_at_the_threshold_and_a_passage_in_most(spark, seed, monkeypatch):
    monkeypatch.setattr(shared, "FLUSH_TOKENS", 500)
    rng = random.Random(seed)
    passage = data.words(rng, 80)
    found = []
    for base in range(12):
        words = data.words(rng, rng.choice([6, 12, 40, 150])).split()
        for _ in range(rng.randint(1, 12)):
            text = " ".join(edited(rng, words, rng.choice([0, 0.01, 0.03, 0.05])))
            found.append((len(found), f"{text} {passage}" if rng.random() < 0.5 else text, None, None, 0))
    assert got(similar_groups(data.frame(spark, found))) == brute(found)


def test_short_texts_at_the_threshold(spark):
    found = [(i, " ".join("abcdefghij"[j] for j in range(10) if i >> j & 1), None, None, 0) for i in range(200)]
    assert got(similar_groups(data.frame(spark, found))) == brute(found)


def test_one_row_of_each_group_stays(spark):
    docs = data.frame(spark)
    kept = drop_similar(docs)
    assert kept.columns == docs.columns
    want = {name for name, n, c in brute(data.rows()) if str(c) == name}
    assert {str(r.doc_id) for r in kept.collect()} == want


def test_empty_tables(spark):
    assert similar_groups(data.empty(spark)).collect() == []
    found = [(1, None, None, None, 0), (2, " \n", None, None, 0)]
    assert got(similar_groups(data.frame(spark, found))) == [("1", 0, 1), ("2", 0, 2)]


def test_shingles_of_all_texts():
    texts = [r[1] for r in data.rows()]
    for text, hashes in zip(texts, shingle_sets(texts)):
        assert len(hashes) == len(shingles(text))
    sets = {shingles(t): h.tobytes() for t, h in zip(texts, shingle_sets(texts))}
    assert len(set(sets.values())) == len(sets)


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(110)] + [(i, i + 1) for i in range(300, 340)] + [(500, i) for i in range(400, 490)]
    root = {}

    def top(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = top(a), top(b)
        root[max(x, y)] = min(x, y)
    want = {(i, top(i)) for i in root if top(i) != i}
    assert {tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()} == want


def test_texts_without_an_id_link_others(spark):
    rng = random.Random(3)
    words = data.words(rng, 60).split()
    changed = lambda some, at: [*some[:at], "other", *some[at + 1 :]]
    middle = changed(words, 30)
    chain = [words, middle, changed(middle, 40)]
    assert [r[2] for r in brute([(1, " ".join(chain[0]), 0), (9, " ".join(chain[2]), 0)])] == [1, 9]
    alone = data.words(rng, 60).split()
    found = [(1, " ".join(chain[0])), (None, " ".join(chain[1])), (9, " ".join(chain[2])), (None, " ".join(chain[1]).upper())]
    found += [(None, " ".join(alone)), (None, " ".join(changed(alone, 20))), (None, " ".join(alone)), (None, None), (None, " "), (4, "a b")]
    docs = data.frame(spark, [(*r, None, f"s{i}", 0) for i, r in enumerate(found)])
    assert got(similar_groups(docs)) == brute(found)
    assert {r.component_id for r in similar_groups(docs).collect() if r.doc_id in (1, 9)} == {1}
    kept = drop_similar(docs)
    assert kept.columns == docs.columns
    stays = [(r.doc_id, r.text) for r in kept.collect()]
    assert sorted(map(str, [s for s in stays if s[0] is not None])) == sorted(map(str, [found[0], found[9]]))
    unnamed = [t for name, t in stays if name is None]
    assert len(unnamed) == 3 and sorted(map(str, unnamed))[0] == " " and None in unnamed
    assert set(unnamed) - {None, " "} < {found[4][1], found[5][1]}


def test_shingles_of_many_texts_take_little_memory():
    import tracemalloc

    rng = random.Random(8)
    texts = [data.words(rng, 400) for _ in range(1500)]
    for _ in shingle_sets(texts[:300]):  # the powers that are kept
        pass
    tracemalloc.start()
    n = sum(len(s) for s in shingle_sets(texts))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n > 500_000 and peak < 40_000_000
