import random
import tracemalloc
import uuid
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from comarca.llm import attention, scoring
from comarca.llm.attention import Vocabulary, _forward, _gradients, log_probabilities, pair_counts, train, windows
from comarca.llm.common import tokenizer_file
from comarca.llm.scoring import LOWER_CASE, language_scores
from tests.llm import data

PATH, END = tokenizer_file("byte_bpe_50k.json"), 50256


def small_model(steps=30, n=60):
    rng = np.random.default_rng(0)
    texts = [np.append(rng.zipf(1.5, rng.integers(0, 100)) % 5000, END) for _ in range(n)]
    words = Vocabulary(np.bincount(np.concatenate(texts), minlength=END + 1))
    return train(texts, words, pair_counts(words, texts, END), END, steps), texts


def test_every_id_has_its_share_of_one():
    model, _ = small_model()
    words = model.words
    by_class = np.zeros((attention.CLASSES, attention.COLUMNS))
    by_class[words.classes, np.arange(attention.COLUMNS)] = 1
    used = by_class.any(1)
    assert np.allclose((np.exp(model.within.astype(float)) @ by_class.T)[:, used], 1, atol=1e-3)
    rest = np.bincount(words.column, np.exp(words.rest.astype(float)), attention.COLUMNS)
    assert np.allclose(rest, 1, atol=1e-3)


def test_windows_score_every_id_once():
    lengths = np.array([1, 31, 32, 33, 56, 57, 200, 5000])
    begin, text, left = windows(lengths)
    seen = Counter()
    ends = np.cumsum(lengths)
    for i, (b, t, n) in enumerate(zip(begin, text, left)):
        opens = i == 0 or text[i - 1] != t
        for place in range(0 if opens else attention.WINDOW - attention.STRIDE, min(attention.WINDOW, n)):
            assert ends[t] - lengths[t] <= b + place < ends[t]
            seen[b + place] += 1
    assert seen == Counter(range(ends[-1]))


def test_scored_ids_of_later_windows_see_nine_ids():
    model, _ = small_model(0)
    columns = np.arange(200)
    _, next_, scored, _ = attention._grid(model, columns, np.array([len(columns)]))
    for row, picked in zip(next_[1:], scored[1:]):
        assert np.flatnonzero(picked)[0] + 1 >= 9  # the id before the window is seen too
    assert sorted(next_[scored]) == columns.tolist()


def test_scores_equal_the_plain_forward_pass():
    model, texts = small_model()
    got = log_probabilities(model, texts)
    for text, score in zip(texts, got):
        columns = model.words.column[text]
        before = np.append(model.words.column[END], columns[:-1])
        total, at = 0.0, 0
        while at < len(text):
            start = 0 if at == 0 else at - (attention.WINDOW - attention.STRIDE)
            inside = slice(start, min(start + attention.WINDOW, len(text)))
            seen = np.zeros((1, attention.WINDOW), np.int64)
            seen[0, : inside.stop - start] = model.words.inputs[before[inside]]
            logits = _forward(model.parts, seen)[-1][0].astype(float)
            for i in range(at, inside.stop):
                row = logits[i - start]
                total += row[model.words.classes[columns[i]]] - np.log(np.exp(row).sum())
                total += model.within[model.words.inputs[before[i]], columns[i]] + model.words.rest[text[i]]
            at = inside.stop
        assert score == pytest.approx(total, rel=1e-4, abs=1e-3)


def test_later_ids_change_nothing_before_them():
    model, _ = small_model()
    seen = np.random.default_rng(1).integers(0, attention.INPUTS, (1, attention.WINDOW))
    other = seen.copy()
    other[0, 20:] = 3
    a, b = _forward(model.parts, seen)[-1], _forward(model.parts, other)[-1]
    assert np.allclose(a[0, :20], b[0, :20], atol=1e-4) and not np.allclose(a[0, 20:], b[0, 20:])


def test_gradients():
    model, _ = small_model(0)
    parts = {k: v.astype(np.float64) for k, v in model.parts.items()}
    rng = np.random.default_rng(2)
    seen = rng.integers(0, attention.INPUTS, (2, attention.WINDOW))
    next_ = rng.integers(0, attention.CLASSES, (2, attention.WINDOW))
    real = rng.random((2, attention.WINDOW)) < 0.8

    def loss():
        logits = _forward(parts, seen)[-1]
        log_p = np.take_along_axis(logits, next_[..., None], 2)[..., 0] - np.log(np.exp(logits).sum(-1))
        return -(log_p * real).sum() / real.sum()

    for name, g in _gradients(parts, seen, next_, real).items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        parts[name][at] += 1e-5
        up = loss()
        parts[name][at] -= 2e-5
        slope = (up - loss()) / 2e-5
        parts[name][at] += 1e-5
        assert g[at] == pytest.approx(slope, rel=1e-2), name


@pytest.mark.parametrize("places", [0, 1, 40, 3000])
def test_sums_in_rounds(places):
    rng = np.random.default_rng(4)
    at, rows = rng.zipf(1.3, places) % 700, rng.normal(size=(places, 5))
    order, runs = attention._rounds(at, 700)
    assert sorted(order) == list(range(places))
    want = np.zeros((700, 5))
    np.add.at(want, at, rows)
    assert np.allclose(attention._round_sums(rows[order], runs, 700), want)


def packed_windows(model, texts):
    columns, lengths = model.words.column[np.concatenate(texts)], np.array([len(t) for t in texts])
    return attention.packed(model.words, columns, lengths, END)


def test_a_step_fills_the_same_arrays_again():
    model, texts = small_model(0)
    batch = attention._unpacked(model.words, np.resize(packed_windows(model, texts), (attention.BATCH, attention.WINDOW + 3)))
    room = attention.Room()
    _gradients(model.parts, *batch, room)
    tracemalloc.start()
    _gradients(model.parts, *batch, room)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4e6  # 8.7 MB before, on windows of sf0.1, given back and faulted in again in every step


def test_fit_is_plain_adam():
    model, texts = small_model(0)
    rows = packed_windows(model, texts)
    rows = rows[np.lexsort(rows.T[::-1])]
    order = np.random.default_rng(7).permutation(len(rows))
    want = {k: v.astype(float) for k, v in model.parts.items()}
    first, second = ({k: np.zeros_like(v) for k, v in want.items()} for _ in range(2))
    for step in range(1, 6):
        at = rows[order[np.arange((step - 1) * attention.BATCH, step * attention.BATCH) % len(rows)]]
        for k, g in _gradients(want, *attention._unpacked(model.words, at)).items():
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            rate = attention.RATE * step / 20 * (1 - step / 101)
            want[k] = want[k] - rate * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    got = attention.fit(model, packed_windows(model, texts)[::-1], 0, 5, 100)
    for k in want:
        assert got[k].dtype == np.float32 and np.allclose(got[k], want[k], atol=1e-4), k


def check(spark, found):
    got = language_scores(data.frame(spark, found), PATH, END).collect()
    words = [(r[1] or "").encode().translate(LOWER_CASE).split() for r in found]
    held = [zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 7 == 2 for r in found]
    counts, ends = Counter(), sum(not h for h in held)
    for w, h in zip(words, held):
        counts.update([] if h else w)
    n = sum(counts.values()) + ends
    bottom = np.log10(n + len(counts) + (ends > 0) + 1)
    want = []
    for r, w, h in zip(found, words, held):
        c = np.array([counts[x] for x in w] + [ends])
        base = np.log10(c + 1).sum() - len(c) * bottom
        want.append((r[0] or -1, h, len(c), int((c > 0).sum()), n, round(float(base), 6)))
    assert sorted((r.doc_id or -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == sorted(want)
    assert all(np.isfinite(r.score) and r.score < 0 for r in got)
    return got


def test_counts_and_baseline(spark, monkeypatch):
    monkeypatch.setattr(scoring, "FLUSH_WORDS", 50)
    monkeypatch.setattr(scoring, "SLICE_BYTES", 400)
    check(spark, data.rows())


def test_better_than_the_baseline_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = language_scores(docs, PATH, END).filter("held_out").selectExpr("sum(score) s", "sum(base_score) b").first()
    assert got.s > got.b


def test_no_training_text_and_empty_table(spark):
    only = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 7 == 2)
    check(spark, [(only, "a b", None, None, 0)])
    assert language_scores(data.empty(spark), PATH, END).collect() == []


def test_weights_learn_from_every_window(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(scoring, "SLICE_BYTES", 3000)
    monkeypatch.setattr(scoring, "STEPS", 20)
    monkeypatch.setattr(scoring, "BATCH", 1)  # more windows than steps take: several shards, each window in one round
    found = [(i, data.words(random.Random(i), 600), None, None, 0) for i in range(8)]
    tokens = scoring._tokenized(data.frame(spark, found).select(F.col("doc_id").alias("id"), "text"), PATH, 7, 2)
    texts = [np.append(np.frombuffer(bytes(r.ids), "<u2"), END) for r in tokens.filter("not held_out").collect()]
    assert max(map(len, texts)) > 1024
    words = Vocabulary(np.bincount(np.concatenate(texts), minlength=END + 1))
    want = Counter(r.tobytes() for t in texts for r in attention.packed(words, words.column[t], np.array([len(t)]), END))

    def noted(model, rows, *steps):
        np.save(tmp_path / uuid.uuid4().hex, rows)
        return model.parts

    monkeypatch.setattr(scoring, "fit", noted)
    scoring._fitted(tokens, 2, words, pair_counts(words, texts, END), END)
    runs = [np.load(f) for f in tmp_path.iterdir()]
    assert len(runs) > 2 * attention.ROUNDS
    assert Counter(r.tobytes() for rows in runs for r in rows) == want
