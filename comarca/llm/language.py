"""Language identification by cross-parsing against labelled text."""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from comarca.llm.common import slices, training_remainder

UNKNOWN = "und"
# The bounded sample a classifier is fitted on: texts per language, and characters of each.
SAMPLE_TEXTS = 48
SAMPLE_CHARS = 300
# Symbols that advance together; a text is parsed in windows of so many symbols.
WINDOW = 256
SLICE_CHARS = 2_000_000

_MISS = 1 << 30
_GAP, _OTHER = 0, 1  # between words; a letter that no sample has


def labelled_sample(
    docs: DataFrame,
    texts: int = SAMPLE_TEXTS,
    chars: int = SAMPLE_CHARS,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> dict[str, str]:
    """At most ``texts`` excerpts of ``chars`` characters for each language of the labelled rows.

    Rows, and the place in a text where its excerpt begins, are chosen by hashes of id and text. The counts of all rows per language give the share
    of hashes to look at, so that no more than a few hundred rows per language are sorted.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.filter("text is not null and lang is not null")
    counts = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return {}
    spark = docs.sparkSession
    shares = spark.createDataFrame(
        [(lang, min(1.0, 4 * texts / n)) for lang, n in counts.items()], "lang string, share double"
    )
    h = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 31))
    begin = F.pmod(F.xxhash64(F.lit("begin"), "id", "text"), F.greatest(F.char_length("text") - (chars - 1), F.lit(1))).cast("int") + 1
    first = F.row_number().over(Window.partitionBy("lang").orderBy("h", "id"))
    picked = (
        rows.withColumn("h", h)
        .join(F.broadcast(shares), "lang")  # a row per language, made on the driver
        .filter(F.col("h") < F.col("share") * (1 << 31))
        .withColumn("nth", first)
        .filter(F.col("nth") <= texts)
        .select("lang", "nth", F.substring("text", begin, F.lit(chars)).alias("text"))
    )
    found: dict[str, list[str]] = {}
    for r in sorted(picked.collect(), key=lambda r: (r.lang, r.nth)):
        found.setdefault(r.lang, []).append(r.text)
    return {lang: "\n".join(parts) for lang, parts in found.items()}


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the smallest automaton that reads every substring of ``symbols``; state 0 starts."""
    following, link, length, last = [{}], [-1], [0], 0
    for c in symbols:
        new = len(following)
        following.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in following[p]:
            following[p][c] = new
            p = link[p]
        if p >= 0:
            q = following[p][c]
            if length[q] != length[p] + 1:
                copy = len(following)
                following.append(dict(following[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and following[p].get(c) == q:
                    following[p][c] = copy
                    p = link[p]
                link[q] = copy
                q = copy
            link[new] = q
        last = new
    return following


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


class CrossParser:
    """Counts, for each language, the phrases a text falls into when read with that language's sample.

    A phrase is the longest piece that occurs in the sample; a text is parsed in windows of ``WINDOW`` symbols, each of
    which starts a phrase in every language. In a sample of m symbols phrases of a text of its own language
    are expected to be log m long, over the entropy, so a count times log m is the measure that samples of different
    sizes have in common. One table holds the automata of
    all languages side by side; an entry is the row of the next state, with a bit set where
    the phrase ends and the symbol starts another one.
    """

    def __init__(self, samples: dict[str, str]):
        self.languages = sorted(samples)
        alphabet = sorted({c for s in samples.values() for c in s.lower() if c.isalpha()})
        self.symbol = np.where(_letters(), _OTHER, _GAP).astype(np.uint16)
        self.symbol[[ord(c) for c in alphabet]] = np.arange(2, 2 + len(alphabet))
        self.pad = 2 + len(alphabet)
        width, tables, self.start, rows = self.pad + 1, [], [], 0
        self.weight = []
        for lang in self.languages:
            symbols, _ = self._symbols([samples[lang]])
            self.weight.append(np.log(max(len(symbols), 2)))
            states = suffix_automaton(symbols.tolist())
            base = rows * width
            table = np.zeros((len(states), width), np.int32)
            begin = np.full(width, base, np.int32)
            for c, to in states[0].items():
                begin[c] = base + to * width
            table[:] = begin | _MISS
            for i, row in enumerate(states):
                for c, to in row.items():
                    table[i, c] = base + to * width
            table[:, self.pad] = base + np.arange(len(states)) * width
            tables.append(table.ravel())
            self.start.append(base)
            rows += len(states)
        self.table = np.concatenate(tables) if tables else np.zeros(0, np.int32)

    def _symbols(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all texts, a run of non-letters as one gap, and how many each text has."""
        lowered = [t.lower() for t in texts]
        sizes = np.fromiter(map(len, lowered), np.int64, len(lowered))
        codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
        symbols = self.symbol[codes]
        keep = symbols != _GAP
        keep[1:] |= symbols[:-1] != _GAP
        ends = np.cumsum(sizes)
        firsts = (ends - sizes)[sizes > 0]
        keep[firsts] = symbols[firsts] != _GAP
        kept = np.concatenate(([0], np.cumsum(keep)))
        return symbols[keep], kept[ends] - kept[ends - sizes]

    def phrases(self, texts: list[str]) -> np.ndarray:
        """A row per text, a column per language; 0 for a text without letters."""
        symbols, sizes = self._symbols(texts)
        windows = -(-sizes // WINDOW)
        lanes, ends = int(windows.sum()), np.cumsum(sizes)
        first = np.cumsum(windows) - windows
        grid = np.full(lanes * WINDOW, self.pad, np.int32)
        grid[np.arange(len(symbols)) + np.repeat(first * WINDOW - (ends - sizes), sizes)] = symbols
        grid = np.ascontiguousarray(grid.reshape(lanes, WINDOW).T)
        state = np.repeat(np.array(self.start, np.int32)[:, None], lanes, 1)
        count = np.ones((len(self.start), lanes), np.int32)
        for column in grid:
            entry = self.table[state + column]
            count += entry >> 30
            state = entry & (_MISS - 1)
        out = np.zeros((len(texts), len(self.start)), np.int64)
        some = windows > 0
        if lanes:
            out[some] = np.add.reduceat(count, first[some], axis=1).T
        return out

    def best(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The language with the fewest normalised phrases, the first by name on a tie, and a score of 0 to 1."""
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        counts = self.phrases(texts) * np.array(self.weight)
        letters = counts[:, 0] > 0
        order = np.sort(counts, axis=1)
        with np.errstate(invalid="ignore"):
            score = order[:, 1] / (order[:, 0] + order[:, 1]) if counts.shape[1] > 1 else np.ones(len(texts))
        at = counts.argmin(1)
        names = [self.languages[i] if ok else UNKNOWN for i, ok in zip(at, letters)]
        return names, np.where(letters, score, 0.0)


@lru_cache(4)
def _parser(samples: tuple[tuple[str, str], ...]) -> CrossParser:
    return CrossParser(dict(samples))


def predict(text: Column, samples: dict[str, str]) -> Column:
    """A struct of lang_pred and score for a text; needs nothing but the text.

    Null texts and texts without a letter are ``und`` with score 0, and so is everything if
    there is no labelled sample. Otherwise the score is the share of the second best
    language's normalised phrases among those of the two best: 0.5 for a tie, 1 if there is one language.
    Texts of any length are read whole. The samples (``SAMPLE_TEXTS`` times ``SAMPLE_CHARS``
    characters per language) travel with the function, each worker builds its automata once.
    """
    key = tuple(sorted(samples.items()))

    @F.pandas_udf("lang_pred string, score double")
    def parsed(texts: pd.Series) -> pd.DataFrame:
        parser, names, scores = _parser(key), [], []
        for run in slices(texts.fillna("").tolist(), SLICE_CHARS):
            found, score = parser.best(run)
            names += found
            scores.append(score)
        return pd.DataFrame({"lang_pred": names, "score": np.concatenate(scores or [np.zeros(0)])})

    # Spark would otherwise run it again for each of the columns made from it.
    return parsed.asNondeterministic()(text)


def lettered(text: Column) -> Column:
    """Whether a text has a letter, as ``predict`` tells letters; false for a null text."""

    @F.pandas_udf("boolean")
    def found(texts: pd.Series) -> pd.Series:
        # Lower-casing comes first, as it does in CrossParser.
        return texts.fillna("").map(lambda t: any(map(str.isalpha, t.lower()))).astype(bool)

    return found(text)


def identify(
    docs: DataFrame,
    divisor: int = 4,
    held_out: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """Predicts the language of every document from a classifier fitted on those not held out.

    Returns id, held_out, lang_pred and score (see ``predict``), a row per input row; repeated
    rows and null ids included. Other columns may have any name.
    """
    held = training_remainder(F.col(id_col), divisor) == held_out
    samples = labelled_sample(docs.filter(~held), id_col=id_col, text_col=text_col, lang_col=lang_col)
    found = docs.select(
        F.col(id_col).alias("id"), held.alias("held_out"), predict(F.col(text_col), samples).alias("p")
    )
    return found.select(F.col("id").alias(id_col), "held_out", "p.lang_pred", "p.score")


def drop_unidentified(
    docs: DataFrame,
    languages: Sequence[str] | None = None,
    least_score: float = 0.0,
    fill_labels: bool = False,
    divisor: int = 4,
    held_out: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """The documents in a wanted language; with ``fill_labels`` a null label becomes the predicted language.

    Null texts and texts without a letter go, and so do texts whose prediction is none of ``languages`` or
    scores less than ``least_score`` (0.5 for a tie); as a default all languages and scores stay. Where
    there is no labelled text to learn from nothing can be predicted: then only texts without a letter
    go, and null labels stay. All other columns are unchanged.
    """
    held = training_remainder(F.col(id_col), divisor) == held_out
    samples = labelled_sample(docs.filter(~held), id_col=id_col, text_col=text_col, lang_col=lang_col)
    if not samples:
        return docs.filter(lettered(F.col(text_col)))
    found = docs.withColumn("_found_language", predict(F.col(text_col), samples))
    predicted = F.col("_found_language")["lang_pred"]
    stays = (predicted != UNKNOWN) & (F.col("_found_language")["score"] >= least_score)
    if languages is not None:
        stays &= predicted.isin(*languages)
    label = F.coalesce(F.col(lang_col), predicted) if fill_labels else F.col(lang_col)
    return found.filter(stays).select(*[label.alias(c) if c == lang_col else F.col(c) for c in docs.columns])
