import hashlib
import random
from collections import Counter
from itertools import product as all_pairs
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import sentencepiece
from tokenizers import Tokenizer

from comarca.llm import alignment, blocks
from comarca.llm.alignment import Csr, aligned_tokens, product, tokenizer_pair
from comarca.llm.common import tokenizer_file
from tests.llm.data import empty, frame, rows, words

A, B = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")


def whole(text, byte_level, pieces, decode):
    """(id, begin, end) of the tokens of a whole text, by each library; nothing if the bytes differ."""
    raw = b" " + text.encode()
    out = []
    for ids, bytes_of in ((byte_level.encode(" " + text, add_special_tokens=False).ids, decode[0]),
                          (pieces.encode(text), decode[1])):
        at, tokens = 0, []
        for i in ids:
            tokens.append((i, at, at + len(bytes_of(i))))
            at += len(bytes_of(i))
        if not text or b"".join(bytes_of(i) for i in ids) != raw:
            return [], []
        out.append(tokens)
    return out


def brute(found):
    byte_level, pieces = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    byte_level.encode_special_tokens = True
    pair = tokenizer_pair(A, B)
    decode = (lambda i: pair.a_bytes.of_id[i], lambda i: pair.b_bytes.of_id[i])
    docs = [(r[0], *whole(r[1] or "", byte_level, pieces, decode)) for r in found]
    links = []
    for _, a, b in docs:
        by_end = {t[2]: t[0] for t in b}
        links.append([(t[0], by_end[t[2]]) for t in a if t[2] in by_end])
    counts = Counter(p for own in links for p in own)
    top = {}
    for (_, y), n in counts.items():
        top[y] = max(top.get(y, 0), n)
    out = []
    for (doc, a, b), own in zip(docs, links):
        ends = sorted({t[2] for t in a} & {t[2] for t in b})
        groups = [[[t[0] for t in side if lo < t[2] <= hi] for side in (a, b)] for lo, hi in zip([0, *ends], ends)] if len(a) < 3000 else None
        written = None if groups is None else ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        out.append((
            doc, len(a), len(b), len(ends), len(own), sum(counts[p] == top[p[1]] for p in own), sum(counts[p] for p in own),
            written and hashlib.sha256(written.encode()).hexdigest(),
            sum(min(x[2], y[2]) > max(x[1], y[1]) for x, y in all_pairs(a, b)) if len(a) < 800 else None,
            sum(len(x) * len(y) for x, y in groups) if groups is not None else None,
        ))
    return out


def check(spark, found):
    got = sorted((tuple(r) for r in aligned_tokens(frame(spark, found), A, B).collect()), key=repr)
    want = sorted(brute(found), key=repr)
    key = lambda r: (repr(r[0]), r[1:7])
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert tuple(x for x, y in zip(g, w) if y is not None) == tuple(y for y in w if y is not None), (g, w)
        assert g[1] or g[1:7] == (0,) * 6 and g[7] == ""


def test_equals_brute_force(spark):
    check(spark, rows())


def test_awkward_texts(spark):
    texts = ["a  b", " a", "a ", "a\n b", "a \nb", "\n", "tab\tin", "nbsp\xa0x y", "\x1c a", "<s> </s> <unk> <0x41> <|endoftext|>",
             "ﬁ ﬀ ① Å Å", "日本語のテキスト です", "🙂🙂 👩‍👩‍👧", "▁x", "x ▁ y", "it's we'll DON'T", "0123456789 12.5%", "\x00 z", "a\r\nb", "﻿bom",
             "    indented\n        twice", "word" * 300, "é" * 400, "ab " * 50]
    check(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts)])


def test_products():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 2, (9, 13)), rng.integers(0, 2, (13, 7))
    left, right = (Csr.of_rows(*np.nonzero(m), *m.shape) for m in (a, b))
    got = np.zeros((9, 7), int)
    for i, j, v in product(left, right):
        got[i, j] = v
    assert (got == a @ b).all()
    back = right.transposed().transposed()
    assert (back.columns == right.columns).all() and (back.start == right.start).all()


def test_chunks_align_as_whole_texts(spark):
    rng = random.Random(9)
    pair = tokenizer_pair(A, B)
    for _ in range(50):
        text = words(rng, 40, "de") + rng.choice([" ", "  ", ". ", "\n"]) + words(rng, 40)
        parts = pair.chunks(text)
        assert pair.pieces.encode(text) == [i for p in parts for i in pair.pieces.encode(p)]


def test_empty(spark):
    assert aligned_tokens(empty(spark), A, B).count() == 0


def blocks_of(monkeypatch, texts):
    """Blocks of a task that gets these texts, made in this process, each with the pair of tokenizers after it."""
    monkeypatch.setattr(alignment, "stored", lambda found: found)
    monkeypatch.setattr(blocks, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    align = alignment._aligned(SimpleNamespace(mapInArrow=lambda f, schema: f), A, B)
    tokenizer_pair.cache_clear()
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["id", "text"])
    for found in align([batch]):
        yield found.to_pylist()[0], tokenizer_pair(A, B)


def test_remembered_chunks_are_bounded(monkeypatch):
    rng = random.Random(4)
    texts = [" ".join(["often", *("".join(rng.choices("abcdefghij", k=90)) for _ in range(20)), "often"]) for _ in range(300)]
    whole = [doc for block, _ in blocks_of(monkeypatch, texts) for doc in block["docs"]]
    for name, limit in (("BLOCK_BYTES", 20_000), ("CACHE_BYTES", 300_000), ("KEPT_BYTES", 100_000)):
        monkeypatch.setattr(alignment, name, limit, raising=False)
    parts, most = [], 0
    for block, pair in blocks_of(monkeypatch, texts):
        parts += block["docs"]
        most = max(most, sum(map(len, pair.number)) + sum(map(len, pair.groups)))
        assert "often" in pair.number and len(pair.groups) == len(pair.number) == len(pair.fine)
    assert parts == whole
    assert most < 600_000, most  # all of them: over 2,000,000


def test_blocks_take_two_bytes_a_link(monkeypatch):
    texts = ["one and two and three of them"] * 200 + [None, "", "naïve 🙂 text"]
    ((block, _),) = blocks_of(monkeypatch, texts)
    links = sum(doc["n_links"] for doc in block["docs"])
    assert links == sum(pair["n"] for pair in block["pairs"]) > 1000
    assert sum(len(v) for v in block.values() if isinstance(v, bytes)) == 2 * links
