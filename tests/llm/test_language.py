import random
import zlib

import pytest

from comarca.llm.language import WINDOW, CrossParser, drop_unidentified, identify, labelled_sample, suffix_automaton
from tests.llm import data


def test_automaton_reads_all_substrings_and_no_other():
    rng = random.Random(1)
    text = [rng.randrange(3) for _ in range(60)]
    states = suffix_automaton(text)

    def reads(piece):
        at = 0
        for c in piece:
            if c not in states[at]:
                return False
            at = states[at][c]
        return True

    has = lambda piece: any(text[i : i + len(piece)] == piece for i in range(len(text)))
    for _ in range(500):
        i = rng.randrange(60)
        assert reads(text[i : i + rng.randrange(10)])
        piece = [rng.randrange(3) for _ in range(rng.randrange(8))]
        assert reads(piece) == has(piece)


def phrases(parser, lang, sample, text):
    known = parser._symbols([sample])[0].tolist()
    joined = "".join(map(chr, known))
    symbols = "".join(map(chr, parser._symbols([text])[0].tolist()))
    count = 0
    for at in range(0, len(symbols), WINDOW):
        count, piece = count + 1, ""
        for c in symbols[at : at + WINDOW]:
            if piece + c in joined:
                piece += c
            else:
                count += 1
                piece = c if c in joined else ""
    return count


def test_phrases_equal_brute_force():
    rng = random.Random(2)
    samples = {lang: data.words(rng, 40, lang) for lang in data.SYLLABLES}
    parser = CrossParser(samples)
    texts = [data.words(rng, n, lang) for n in (1, 5, 80, 400) for lang in samples] + ["", "12", "Ünder! the", "中 the"]
    got = parser.phrases(texts)
    for row, text in zip(got, texts):
        want = [phrases(parser, lang, samples[lang], text) for lang in parser.languages]
        assert row.tolist() == want


def training(n=400):
    rng = random.Random(5)
    return [(i, data.words(rng, 60, lang := rng.choice(["en", "de"])), lang, "s", 0) for i in range(n)]


def test_held_out_accuracy(spark):
    found = training()
    got = {r.doc_id: r for r in identify(data.frame(spark, found)).collect()}
    held = [r for r in found if got[r[0]].held_out]
    assert 50 < len(held) < 150
    assert sum(got[r[0]].lang_pred == r[2] for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_odd_rows(spark):
    found = training(80) + [(1000, None, "en", "s", 0), (1001, "", None, "s", 0), (1002, "12 ?", "en", "s", 0), (None, "the thing", None, None, 0), (0, training(1)[0][1], "en", "s", 0)]
    got = identify(data.frame(spark, found)).collect()
    assert len(got) == len(found)
    by_id = {r.doc_id: r for r in got}
    for i in (1000, 1001, 1002):
        assert (by_id[i].lang_pred, by_id[i].score) == ("und", 0.0)
    assert by_id[None].lang_pred == "en"
    docs = data.frame(spark, found)
    kept = drop_unidentified(docs)
    assert kept.columns == docs.columns and kept.count() == len(found) - 3


@pytest.mark.parametrize("found", [[], [(1, "the thing", None, None, 0)]])
def test_nothing_to_learn_from(spark, found):
    got = identify(data.frame(spark, found)).collect()
    assert [(r.doc_id, r.lang_pred, r.score) for r in got] == [(r[0], "und", 0.0) for r in found]


@pytest.mark.parametrize("labelled", ["none", "held out"])
def test_unlabelled_documents_with_a_letter_stay(spark, labelled):
    texts = ["the thing", "12 ?", None, "", "日本語", "1 a", "\n\t ", "é"]
    ids = range(len(texts))
    found = [(i, t, None, "s", 0) for i, t in zip(ids, texts)]
    if labelled == "held out":
        only = next(i for i in range(100, 1000) if zlib.crc32(str(i).encode()) % 4 == 2)
        found.append((only, "all labelled rows are held out", "en", "s", 0))
    docs = data.frame(spark, found)
    kept = drop_unidentified(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [r[0] for r in found if any(c.isalpha() for c in r[1] or "")]


def test_unlabelled_documents_get_the_predicted_language(spark):
    found = training(160)
    found = [(i, t, None if i % 5 == 0 else lang, s, n) for i, t, lang, s, n in found] + [(2000, "12 ?", None, "s", 0)]
    truth = {r[0]: r[2] for r in training(160)}
    kept = {r.doc_id: r.lang for r in drop_unidentified(data.frame(spark, found), fill_labels=True).collect()}
    assert set(kept) == set(truth)
    assert all(kept[r[0]] == r[2] for r in found if r[2])
    assert sum(kept[i] == lang for i, lang in truth.items()) >= 0.98 * len(truth)


def test_only_wanted_languages(spark):
    docs = data.frame(spark, training(160))
    truth = {r[0]: r[2] for r in training(160)}
    kept = [r.doc_id for r in drop_unidentified(docs, languages=["de"]).collect()]
    assert sum(truth[i] == "de" for i in kept) >= 0.98 * len(kept) > 0
    assert len(kept) >= 0.98 * sum(v == "de" for v in truth.values())
    assert drop_unidentified(docs, least_score=1.01).count() == 0


@pytest.mark.parametrize("few, chars", [(2, 300), (3, 60)])
@pytest.mark.parametrize("rare", ["en", "de"])
def test_a_language_with_few_or_short_labelled_texts(spark, rare, few, chars):
    found, labelled = [], 0
    for i, text, lang, source, n in training(300):
        if zlib.crc32(str(i).encode()) % 4 != 2 and lang == rare:
            labelled += 1
            text, lang = text[:chars], lang if labelled <= few else None
        found.append((i, text, lang, source, n))
    truth = {r[0]: r[2] for r in training(300)}
    got = [r for r in identify(data.frame(spark, found)).collect() if r.held_out]
    for lang in ("en", "de"):
        right = [r.lang_pred == lang for r in got if truth[r.doc_id] == lang]
        assert len(right) > 20 and sum(right) >= 0.98 * len(right)


def test_a_common_header_does_not_fill_the_samples(spark):
    header = "this is the same notice in front of all pages of the site whatever the language of the page is " * 4
    found = [(i, header + t + " " + t + " " + t, *rest) for i, t, *rest in training(200)]
    samples = labelled_sample(data.frame(spark, found))
    assert all(len(set(s.split("\n"))) > 40 for s in samples.values())
    got = identify(data.frame(spark, found)).collect()
    truth = {r[0]: r[2] for r in found}
    held = [r.lang_pred == truth[r.doc_id] for r in got if r.held_out]
    assert sum(held) >= 0.98 * len(held)
