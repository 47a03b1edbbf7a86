import random
import time
import zlib

import numpy as np
import pytest

from comarca.llm import viterbi
from comarca.llm.common import tokenizer_file
from comarca.llm.viterbi import LITERAL, SPACE, PieceModel, sentencepiece_ids
from tests.llm import data

PATH = tokenizer_file("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return PieceModel(PATH, True)


def best_score(model, text):
    """Best sum of scores over all segmentations, one character after the other."""
    known = {model_piece: score for model_piece, score in _scores(model).items()}
    text = SPACE + text.replace(SPACE, LITERAL).replace(" ", SPACE)
    best = [0.0] + [-np.inf] * len(text)
    for end in range(1, len(text) + 1):
        for begin in range(max(0, end - model.longest), end):
            if text[begin:end] in known:
                best[end] = max(best[end], best[begin] + known[text[begin:end]])
        best[end] = max(best[end], best[end - 1] + model.unknown_score)
    return best[-1]


def _scores(model):
    out = {}
    for length, ids in model.ids.items():
        for i, s in zip(ids.tolist(), model.scores[length].tolist()):
            out[model.out[i].decode().replace(" ", SPACE)] = s
    return out


def test_best_segmentation(model):
    rng = random.Random(1)
    alphabet = "abcde the ing  ß.\n中▁🙂"
    scores = {i: s for length in model.ids for i, s in zip(model.ids[length].tolist(), model.scores[length].tolist())}
    by_bytes = set(model.bytes.values())
    for _ in range(200):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 25)))
        ids = np.frombuffer(model.encode([text])[0], model.dtype)
        assert model.decode(ids) == text
        if not by_bytes & set(ids.tolist()):
            assert sum(scores[i] for i in ids.tolist()) == pytest.approx(best_score(model, text))


def test_same_as_the_library_for_a_model_with_these_scores(model):
    proto = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    from sentencepiece import SentencePieceProcessor

    spec = proto.ModelProto()
    spec.ParseFromString(open(PATH, "rb").read())
    spec.trainer_spec.model_type = 1
    for length in model.ids:
        for i, s in zip(model.ids[length].tolist(), model.scores[length].tolist()):
            spec.pieces[i].score = s
    library = SentencePieceProcessor(model_proto=spec.SerializeToString())
    rng = random.Random(2)
    texts = [data.words(rng, 30, lang) for lang in data.SYLLABLES for _ in range(30)]
    same = [np.frombuffer(raw, model.dtype).tolist() == library.encode(t) for raw, t in zip(model.encode(texts), texts)]
    assert sum(same) >= 0.97 * len(texts)  # the library adds in single precision and settles ties otherwise


def test_file_scores_of_a_merge_model():
    model = PieceModel(PATH, False)
    ids = np.frombuffer(model.encode(["the thing"])[0], model.dtype)
    assert model.decode(ids) == "the thing"


def test_split_keeps_runs_of_spaces_together():
    for text in ["", " ", "a", " a", "a ", "  a   b  ", "a b"]:
        words = PieceModel.split(text)
        assert "".join(SPACE + w for w in words).replace(SPACE, " ")[1:] == text


def test_caches_and_slices(model, monkeypatch):
    texts = [r[1] or "" for r in data.rows()]
    want = model.encode(texts)
    monkeypatch.setattr(viterbi, "CACHE_WORDS", 10)
    monkeypatch.setattr(viterbi, "SLICE_CHARS", 50)
    monkeypatch.setattr(viterbi, "GRID_CELLS", 40)
    assert PieceModel(PATH, True).encode(texts) == want


def test_documents(spark):
    found = data.rows()
    docs = data.frame(spark, found)
    got = sentencepiece_ids(docs, PATH)
    assert set(got.columns) == set(docs.columns) - {"text"} | {"tokens", "n_tokens", "decoded_crc32", "round_trip"}
    rows = got.collect()
    assert all(r.round_trip and r.n_tokens == len(r.tokens) and r.a == "clash" for r in rows)
    want = sorted((r[0] or -1, zlib.crc32((r[1] or "").encode())) for r in found)
    assert sorted((r.doc_id or -1, r.decoded_crc32) for r in rows) == want
    assert sentencepiece_ids(data.empty(spark), PATH).collect() == []


@pytest.mark.parametrize("alphabet", ["abcdeing", "日本語中文字学校生国", "a", "ab中ß🙂.\n" + LITERAL, "㐀"])
def test_a_word_of_any_length_is_segmented_the_same_alone(model, alphabet, monkeypatch):
    monkeypatch.setattr(viterbi, "PLACES", 100)
    rng = random.Random(6)
    for n in (1, 2, 99, 100, 101, 700):
        word = SPACE + "".join(rng.choice(alphabet) for _ in range(n))
        assert model.segment_long(word) == model.segment([word])[0]


@pytest.mark.parametrize("alphabet", ["abcdefghijklmnop", "日本語中文字学校生国"])
def test_long_text_without_spaces(model, alphabet):
    rng = random.Random(7)
    text = "".join(rng.choice(alphabet) for _ in range(100_000))
    begin = time.process_time()
    ids = np.frombuffer(model.encode([text])[0], model.dtype)
    assert time.process_time() - begin < 2
    assert model.decode(ids) == text
