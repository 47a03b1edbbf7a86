"""Passages that occur again, found from fixed blocks of words that every window is compared to."""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from comarca.llm.blocks import ASKED, BLOCK_BYTES, answered, answers_by_block, asked, recurring, text_blocks
from comarca.llm.common import partitions, stored
from comarca.llm.shingles import mix, powers

WINDOW = 35
# Bytes of a rolling hash that are sent; a false hit costs work only, the window around it is looked at with 128 bits.
HIT_BYTES = 6

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def block_length(window: int) -> int:
    """The longest block of which every window holds a whole one, wherever the window starts."""
    return (window + 1) // 2


class Words:
    """The words of a block's texts one after another, as hashes, with the sums that give any run's hash at once."""

    def __init__(self, texts: list[str]):
        self.raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        raw = np.frombuffer(b" ".join([*self.raw, b""]), np.uint8)
        space = _SPACE[raw]
        before = np.r_[True, space[:-1]]
        starts, ends = np.flatnonzero(~space & before), np.flatnonzero(space & ~before)
        self.counts = np.diff(np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in self.raw)])))
        hashed = []
        for at in range(0, len(starts), 1 << 17):  # in slices, for the sake of memory
            s, e = starts[at : at + (1 << 17)], ends[at : at + (1 << 17)]
            part = raw[s[0] : e[-1]].astype(np.uint64) + np.uint64(1)
            power, inverse = powers(len(part) + 1)
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(part * power[: len(part)], out=sums[1:])
            hashed.append(mix((sums[e - s[0]] - sums[s - s[0]]) * inverse[s - s[0]]))
        self.words = np.concatenate(hashed) if hashed else np.zeros(0, np.uint64)
        self.ends = np.cumsum(self.counts)
        self.firsts = self.ends - self.counts

    def runs(self, n: int, salt: int = 0) -> np.ndarray:
        """A hash of the n words from each place on; those that reach into the next text are of no use."""
        words = self.words if not salt else mix(self.words + np.uint64(salt))
        power, inverse = powers(len(words) + 1)
        sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * power[: len(words)], out=sums[1:])
        many = max(len(words) - n + 1, 0)
        return mix((sums[n : n + many] - sums[:many]) * inverse[:many])

    def fits(self, n: int) -> np.ndarray:
        """Places from which n words of the same text follow."""
        left = np.repeat(self.ends, self.counts) - np.arange(len(self.words))
        return np.flatnonzero(left >= n)

    def offset(self, places: np.ndarray) -> np.ndarray:
        return places - np.repeat(self.firsts, self.counts)[places]


class Probe:
    """The rolling windows of a block's longer texts, as long as a reference block, and which of them are one."""

    def __init__(self, words: Words, window: int):
        self.words, self.window, self.length = words, window, block_length(window)
        long_enough = np.repeat(words.counts >= window, words.counts)
        places = words.fits(self.length)
        self.places = places[long_enough[places]]
        hashed = words.runs(self.length)[self.places] >> np.uint64(64 - 8 * HIT_BYTES)
        self.keys, self.number, times = np.unique(hashed, return_inverse=True, return_counts=True)
        self.several = times > 1
        self.reference = words.offset(self.places) % self.length == 0
        self.indexed = np.zeros(len(self.keys), bool)
        self.indexed[self.number[self.reference]] = True

    def around_hits(self, hit: np.ndarray) -> np.ndarray:
        """The places of all windows around reference blocks that something else hits."""
        live = np.zeros(len(self.words.words) + self.length, bool)
        live[self.places[self.reference & hit[self.number]]] = True
        starts = self.words.fits(self.window)
        return starts[live[starts + -self.words.offset(starts) % self.length]]


class Windows:
    """Whole windows at some places, by 128 bits."""

    def __init__(self, words: Words, window: int, places: np.ndarray):
        self.places = places
        high, low = words.runs(window)[places], words.runs(window, 1)[places]
        order = np.lexsort((low, high))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(high[order]) != 0) | (np.diff(low[order]) != 0)
        self.number = np.empty(len(order), np.int64)
        self.number[order] = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        self.high, self.low = high[order][first], low[order][first]
        self.several = np.diff(np.append(first, len(order))) > 1


def _rows(batch: pa.RecordBatch, *columns: str):
    """Row by row, so that only one block's texts are Python objects."""
    for i in range(batch.num_rows):
        yield [batch.column(c)[i].as_py() for c in columns]


def without_repeated_passages(
    docs: DataFrame,
    window: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
    keep_text: bool = False,
) -> DataFrame:
    """Removes every word covered by a run of ``window`` words that also starts anywhere else.

    Returns id, n_words, n_removed, n_spans (maximal removed runs) and kept_sha256 of the
    words kept, joined by one space; with ``keep_text`` also these words as ``kept_text``.

    - Words are runs of characters other than white space (\\x20, \\x09-\\x0D), unchanged. Windows do not
      cross documents, overlaps count, and all are judged on the input, so both of two equal passages go.
    - Null texts have no words. A text shorter than the window loses nothing. Texts are read whole.
    - Every row counts, also repeated rows and rows with a null id: equal texts remove each other.
    - Only id and text are read, other columns may have any name. An empty table gives no rows.

    Reference blocks of (window + 1) // 2 words are taken from each text one after another, without overlap,
    so every window holds a whole one. All rolling windows of a block's length are sent, once per
    some 3 MB of text, to buckets by their hash, and a reference block is hit if it occurs a second
    time. The hits are extended: the windows of full length around them are sent in the same way,
    by 128 bits, and those that come back as repeated make up the maximal repeats. No pairs are
    made, so a passage in a third of all texts costs a key per 3 MB of text.
    """
    spark = docs.sparkSession
    blocks = text_blocks(docs, id_col, text_col, block_bytes)
    buckets = 4 * partitions(spark)

    def probe(batches):
        for batch in batches:
            for block, texts in _rows(batch, "block", "texts"):
                p = Probe(Words(texts), window)
                yield from asked(block, p.keys, None, p.several, p.indexed, buckets, HIT_BYTES)

    def extend(batches):
        for batch in batches:
            for block, texts, hits in _rows(batch, "block", "texts", "hits"):
                words = Words(texts)
                p = Probe(words, window)
                w = Windows(words, window, p.around_hits(answered(p.keys, hits, buckets, HIT_BYTES)))
                yield from asked(block, w.high, w.low, w.several, np.ones(len(w.high), bool), buckets, 8)

    def remove(batches):
        for batch in batches:
            for ids, texts, hits, repeats in _rows(batch, "ids", "texts", "hits", "repeats"):
                words = Words(texts)
                p = Probe(words, window)
                w = Windows(words, window, p.around_hits(answered(p.keys, hits, buckets, HIT_BYTES)))
                again = w.places[answered(w.high, repeats, buckets, 8)[w.number]]
                yield from _kept(ids, words, again, window, keep_text)

    hits = stored(recurring(blocks.select("block", "texts").mapInArrow(probe, ASKED), HIT_BYTES))
    hits = answers_by_block(hits, "hits")
    around = blocks.select("block", "texts").join(hits.hint("merge"), "block").mapInArrow(extend, ASKED)
    repeats = answers_by_block(stored(recurring(around, 8)), "repeats")
    both = blocks.join(hits.hint("merge"), "block", "left").join(repeats.hint("merge"), "block", "left")
    schema = "id long, n_words long, n_removed long, n_spans long, kept_sha256 string"
    schema += ", kept_text string" if keep_text else ""
    found = both.select("ids", "texts", "hits", "repeats").mapInArrow(remove, schema)
    kind = docs.schema[id_col].dataType
    return found.select(F.col("id").cast(kind).alias(id_col), *found.columns[1:])


def _kept(ids: list, words: Words, again: np.ndarray, window: int, keep_text: bool):
    """A batch of one row per text, given where repeated windows start."""
    size = len(words.words)
    edges = np.zeros(size + 1, np.int64)
    np.add.at(edges, again, 1)
    np.add.at(edges, again + window, -1)
    covered = np.cumsum(edges)[:size] > 0
    begins = covered.copy()
    begins[1:] &= ~covered[:-1]
    begins[words.firsts[words.counts > 0]] = covered[words.firsts[words.counts > 0]]
    total, spans = np.concatenate(([0], np.cumsum(covered))), np.concatenate(([0], np.cumsum(begins)))
    removed = total[words.ends] - total[words.firsts]
    kept = []
    for raw, a, b, n in zip(words.raw, words.firsts.tolist(), words.ends.tolist(), removed.tolist()):
        parts = raw.split()
        kept.append(b" ".join(compress(parts, (~covered[a:b]).tolist()) if n else parts))
    columns = [
        pa.array(ids, pa.int64()),
        pa.array(words.counts.astype(np.int64)),
        pa.array(removed),
        pa.array(spans[words.ends] - spans[words.firsts]),
        pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
    ]
    names = ["id", "n_words", "n_removed", "n_spans", "kept_sha256"]
    if keep_text:
        columns.append(pa.array([k.decode("utf-8", "surrogatepass") for k in kept], pa.string()))
        names.append("kept_text")
    yield pa.RecordBatch.from_arrays(columns, names)
