"""Small documents with every awkward case, and empty tables."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# Names that operators use inside.
CLASHING = ["id", "x", "n", "a", "b", "key", "size", "part", "row", "h", "norm", "sha", "token", "block", "_hot", "_salt"]

SYLLABLES = {
    "en": "the ing on and er of th ea re st sh ble".split(),
    "de": "ung sch und ein ver ge keit lich ü ß pf tz".split(),
}


def words(rng: random.Random, n: int, lang: str = "en") -> str:
    parts = SYLLABLES[lang]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n))


def rows() -> list[tuple]:
    """Copies, near copies, shared passages, repeated rows, nulls, empty, short, odd and long texts."""
    rng = random.Random(3)
    passage = words(rng, 70)
    texts = [words(rng, rng.randint(1, 300), rng.choice(["en", "de"])) for _ in range(60)]
    base = words(rng, 200)
    near = base.split()
    near[100] = "changed"
    far = base.split()
    far[::9] = ["other"] * len(far[::9])
    texts += [base, base.upper(), " ".join(near), " ".join(far), base.replace(" ", " \n\t ")]
    texts += [words(rng, 40) + " " + passage + " " + words(rng, 40) for _ in range(6)]
    texts += [passage + " " + passage, "x" * 700, "ab " * 500, "one", "one two", "one two three four five", "A", "a"]
    texts += [None, None, "", " ", "\n\t ", "1234 !! 5678", "  two  spaces ", "▁mark▁ \xa0nbsp\xa0 x", "日本語 🙂 текст", "<|endoftext|> it's"]
    texts += [words(rng, 20_000), "é" * 5000]
    out = [
        (i, t, rng.choice(["en", "de"]) if t and i % 7 else None, rng.choice(["s1", "s2", "S", None]), len(t or ""))
        for i, t in enumerate(texts)
    ]
    out += [out[3], out[3], out[64], (None, "no id at all", "en", "s1", 12), (None, base, "en", None, 1)]
    return out


def frame(spark, found: list[tuple] | None = None):
    df = spark.createDataFrame(rows() if found is None else found, SCHEMA).repartition(5)
    return df.selectExpr("*", *[f"'clash' as {name}" for name in CLASHING])


def empty(spark):
    return frame(spark, [])
