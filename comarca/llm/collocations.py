"""Phrases whose words stand together more often than chance, from counts of pairs of ranked ids in tiles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from comarca.llm.blocks import bytes_of, gathered, values_of
from comarca.llm.common import partitions, stored
from comarca.llm.shingles import LOWER_CASE, mix

UNKNOWN = "und"
MIN_COUNT = 100
LONGEST = 5
TOP = 2000
# The first of a language are found in so many parts of it before they meet.
TOP_PARTS = 64
# Text of a task that shares one list of words.
UNIT_BYTES = 5_000_000
# A tile is so many bits of left ids by so many of right ids; with this many entries it is counted by address.
LEFT_BITS, RIGHT_BITS = 4, 10
CELL_BITS = LEFT_BITS + RIGHT_BITS
DENSE = 1 << CELL_BITS - 2
_ID_BYTES = 6

_BREAK = b"."
# A-Z in lower case, tabs as spaces, everything that ends a piece as the break.
_PLAIN = bytes(_BREAK[0] if b in b".,;:!?" or 0x0A <= b <= 0x0D else 0x20 if b == 0x09 else LOWER_CASE[b] for b in range(256))


class _Numbers(dict):
    """Numbers words in the order in which they are met; 0 is the break."""

    def __init__(self):
        self[_BREAK] = 0

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


_UNITS = "unit long, lang string, n_words long, codes binary, words array<string>, counts array<long>"


def _units(docs: DataFrame, size: int) -> DataFrame:
    """A row per run of texts of one language in a task: its words, their counts, and all occurrences by number."""

    def pack(batches):
        held: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}
        unit = TaskContext.get().partitionId() << 33
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                raw = (text or "").encode("utf-8", "surrogatepass").translate(_PLAIN)
                held.setdefault(lang, []).append(raw)
                sizes[lang] = sizes.get(lang, 0) + len(raw)
                if sizes[lang] >= size:
                    yield _unit(unit, lang, held.pop(lang))
                    unit, sizes[lang] = unit + 1, 0
        for lang, raws in held.items():
            yield _unit(unit, lang, raws)
            unit += 1

    rows = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), "text")
    return stored(rows.mapInArrow(pack, _UNITS))


def _unit(unit: int, lang: str, raws: list[bytes]) -> pa.RecordBatch:
    numbers, codes = _Numbers(), []
    for raw in raws:
        tokens = (raw + _BREAK).replace(_BREAK, b" . ").split()
        codes.append(np.fromiter(map(numbers.__getitem__, tokens), np.uint32, len(tokens)))
    codes = np.concatenate(codes)
    counts = np.bincount(codes, minlength=len(numbers))[1:]
    words = [w.decode("utf-8", "surrogatepass") for w in numbers][1:]
    values = [[unit], [lang], [int(counts.sum())], [bytes_of(codes.astype(np.uint64), 4)], [words], [counts]]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays(
        [pa.array(v, k) for v, k in zip(values, kinds)], ["unit", "lang", "n_words", "codes", "words", "counts"]
    )


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """The rows with ``id``: their place, from 0, in this order, by prefix sums over ranges; one row per range is broadcast."""
    spark = rows.sparkSession
    sorted_ = rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    placed = stored(sorted_.withColumn("_at", F.monotonically_increasing_id()))
    part, at = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    parts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    first = F.broadcast(parts.select("_part", F.coalesce(before, F.lit(0)).alias("_first")))
    numbered = placed.withColumn("_part", part).join(first, "_part").withColumn("id", F.col("_first") + at)
    return numbered.drop("_part", "_first", "_at")


_STATE = "unit long, at binary, ids binary"


def _state(unit: int, at: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    """Where phrases of one length stand in a unit, and their ids."""
    steps = np.diff(at, prepend=0).astype(np.uint64)
    columns = [pa.array([unit]), pa.array([bytes_of(steps, 4)]), pa.array([bytes_of(ids.astype(np.uint64), _ID_BYTES)])]
    return pa.RecordBatch.from_arrays(columns, ["unit", "at", "ids"])


def _read_state(row: dict) -> tuple[np.ndarray, np.ndarray]:
    at = np.cumsum(values_of(row["at"].as_py(), 4).astype(np.int64))
    return at, values_of(row["ids"].as_py(), _ID_BYTES).astype(np.int64)


def _rows(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            yield {c: batch.column(c)[i] for c in batch.schema.names}


def _numbers(listed, name: str) -> np.ndarray:
    return listed.values.field(name).to_numpy(zero_copy_only=False).astype(np.int64)


def _frequent_words(units: DataFrame, min_count: int) -> DataFrame:
    """(id, lang, n_all, words, n, pre, suf) of words, ranked by frequency within their language."""
    rows = units.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w")).select("lang", "w.words", "w.counts")
    found = rows.groupBy("lang", F.col("words").alias("word")).agg(F.sum("counts").alias("n")).filter(F.col("n") >= min_count)
    totals = units.groupBy("lang").agg(F.sum("n_words").alias("n_all"))
    none = F.array().cast("array<long>")
    words = found.join(totals, "lang").select("lang", "n_all", F.array("word").alias("words"), "n", none.alias("pre"), none.alias("suf"))
    return stored(ranked(words, F.col("lang"), F.desc("n"), F.col("words")))


def _word_places(units: DataFrame, words: DataFrame) -> DataFrame:
    """The first state: occurrences of frequent words. Breaks and other words leave gaps."""
    asked = units.select("unit", "lang", F.posexplode("words").alias("code", "word"))
    known = words.select("lang", F.col("words")[0].alias("word"), "id")
    answered = asked.join(known.hint("merge"), ["lang", "word"], "left")
    # Every word is answered, those that are not frequent with NULL, which a list leaves out.
    answer = F.when(F.col("id").isNotNull(), F.struct("code", "id"))
    found = answered.groupBy("unit").agg(F.collect_list(answer).alias("known"))

    def place(batches):
        for row in _rows(batches):
            codes = values_of(row["codes"].as_py(), 4).astype(np.int64)
            ids = np.full(int(codes.max(initial=0)) + 1, -1, np.int64)
            ids[_numbers(row["known"], "code") + 1] = _numbers(row["known"], "id")
            placed = ids[codes]
            at = np.flatnonzero(placed >= 0)
            yield _state(row["unit"].as_py(), at, placed[at])

    return stored(units.select("unit", "codes").join(found.hint("merge"), "unit").mapInArrow(place, _STATE))


def neighbours(at: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places at which two phrases of one length overlap in all but a word, and their ids."""
    first = np.flatnonzero(np.diff(at) == 1)
    return at[first], ids[first], ids[first + 1]


def tile_counts(left: np.ndarray, right: np.ndarray, n: np.ndarray | None = None):
    """Sums per pair of ids: (tiles, tile of each pair, cell, n, pair of each entry), pairs in order of tile and cell.

    Tiles with many entries are counted by direct address, all others as sorted coordinates.
    """
    tile = (left >> LEFT_BITS) << 32 | right >> RIGHT_BITS
    cell = (left & (1 << LEFT_BITS) - 1) << RIGHT_BITS | right & (1 << RIGHT_BITS) - 1
    tiles, number, entries = np.unique(tile, return_inverse=True, return_counts=True)
    key = number << CELL_BITS | cell
    dense = entries >= DENSE
    address = np.cumsum(dense) - 1  # of a dense tile
    is_dense = dense[number]
    at = address[number[is_dense]] << CELL_BITS | cell[is_dense]
    weights = None if n is None else n[is_dense]
    table = np.bincount(at, weights, int(dense.sum()) << CELL_BITS).astype(np.int64)
    some = np.flatnonzero(table)  # an entry counts 1 or more
    dense_key = np.flatnonzero(dense)[some >> CELL_BITS] << CELL_BITS | some & (1 << CELL_BITS) - 1
    sparse_key, pair = np.unique(key[~is_dense], return_inverse=True)
    sparse_n = np.bincount(pair, None if n is None else n[~is_dense], len(sparse_key)).astype(np.int64)
    keys = np.concatenate((dense_key, sparse_key))
    order = np.argsort(keys, kind="stable")
    of_entry = np.searchsorted(keys, key, sorter=order)
    return tiles, keys[order] >> CELL_BITS, keys[order] & (1 << CELL_BITS) - 1, np.concatenate((table[some], sparse_n))[order], of_entry


def _pair(tile: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    left = (tile >> 32) << LEFT_BITS | cell >> RIGHT_BITS
    return left, (tile & 0xFFFFFFFF) << RIGHT_BITS | cell & (1 << RIGHT_BITS) - 1


_PARTS = ["bucket", "unit", "tiles", "sizes", "cells", "counts"]


def _frequent_pairs(state: DataFrame, min_count: int) -> DataFrame:
    """(unit, pairs): frequent pairs with ids and counts in rows of unit -1; those each unit has in its own rows.

    A bucket ranks its pairs by frequency, and the ranks of all buckets are dealt out in turn: pairs
    fall into buckets by the hash of their tile, so the ids follow the frequency without a sort of all.
    """
    buckets = 4 * partitions(state.sparkSession)

    def count(batches):
        for row in _rows(batches):
            _, left, right = neighbours(*_read_state(row))
            if len(left):
                yield parts_of(row["unit"].as_py(), *tile_counts(left, right)[:4])

    def parts_of(unit, tiles, of, cell, n):
        bucket = (mix(tiles.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket[of], kind="stable")
        of, cell, n = of[order], cell[order], n[order]
        cuts = np.flatnonzero(np.r_[True, np.diff(bucket[of]) != 0])
        rows = []
        for i, j in zip(cuts, np.r_[cuts[1:], len(of)]):
            starts = np.flatnonzero(np.r_[True, np.diff(of[i:j]) != 0])
            sizes = np.diff(np.r_[starts, j - i])
            rows.append((
                int(bucket[of[i]]), unit, tiles[of[i:j][starts]].astype("<i8").tobytes(), bytes_of(sizes, 2),
                bytes_of(cell[i:j], 2), bytes_of(n[i:j], 4),
            ))
        kinds = [pa.int32(), pa.int64()] + [pa.binary()] * 4
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], _PARTS)

    def add(batches):
        for bucket, rows in gathered(batches, _PARTS):
            sizes = [values_of(r[2], 2).astype(np.int64) for r in rows]
            tile = np.concatenate([np.repeat(np.frombuffer(r[1], "<i8"), s) for r, s in zip(rows, sizes)])
            cells = np.concatenate([values_of(r[3], 2).astype(np.int64) for r in rows])
            n = np.concatenate([values_of(r[4], 4).astype(np.int64) for r in rows])
            left, right = _pair(tile, cells)
            tiles, of, cell, total, pair = tile_counts(left, right, n)
            often = np.flatnonzero(total >= min_count)
            often = often[np.argsort(-total[often], kind="stable")]
            ids = np.full(len(total), -1, np.int64)
            ids[often] = np.arange(len(often)) * buckets + bucket
            yield listed(-1, *_pair(tiles[of[often]], cell[often]), ids[often], total[often])
            known, at = ids[pair], 0
            for unit, own in zip((r[0] for r in rows), sizes):
                mine = np.flatnonzero(known[at : at + int(own.sum())] >= 0) + at
                at += int(own.sum())
                if len(mine):
                    yield listed(unit, left[mine], right[mine], known[mine], np.zeros(len(mine), np.int64))

    def listed(unit, *values):
        pairs = pa.StructArray.from_arrays([pa.array(v.astype(np.int64)) for v in values], ["left", "right", "id", "n"])
        lists = pa.ListArray.from_arrays(pa.array([0, len(pairs)], pa.int32()), pairs)
        return pa.RecordBatch.from_arrays([pa.array([unit], pa.int64()), lists], ["unit", "pairs"])

    schema = "bucket int, unit long, tiles binary, sizes binary, cells binary, counts binary"
    dealt = state.mapInArrow(count, schema).repartition(partitions(state.sparkSession), "bucket").sortWithinPartitions("bucket")
    return stored(dealt.mapInArrow(add, "unit long, pairs array<struct<left: bigint, right: bigint, id: bigint, n: bigint>>"))


def _longer(pairs: DataFrame, phrases: DataFrame) -> DataFrame:
    """Phrases a word longer out of frequent pairs of phrases."""
    left = phrases.select(F.col("id").alias("left"), "lang", "n_all", F.col("words").alias("head"), F.col("pre").alias("p"), F.col("n").alias("n_left"))
    right = phrases.select(F.col("id").alias("right"), F.element_at("words", -1).alias("last"), F.col("suf").alias("s"), F.col("n").alias("n_right"))
    found = pairs.filter("unit < 0").select(F.inline("pairs")).join(left, "left").join(right, "right")
    rows = found.select(
        "id", "left", "right", "lang", "n_all", "n", F.concat("head", F.array("last")).alias("words"),
        F.concat("p", F.array("n_left")).alias("pre"), F.concat("s", F.array("n_right")).alias("suf"),
    )
    return stored(rows)


def _longer_places(state: DataFrame, pairs: DataFrame) -> DataFrame:
    """The next state: where the longer frequent phrases stand."""
    known = pairs.filter("unit >= 0").groupBy("unit").agg(F.flatten(F.collect_list("pairs")).alias("known"))

    def place(batches):
        for row in _rows(batches):
            at, left, right = neighbours(*_read_state(row))
            asked_left, asked_right, ids = (_numbers(row["known"], c) for c in ("left", "right", "id"))
            lefts, rights = np.unique(asked_left), np.unique(asked_right)
            i, j = np.searchsorted(lefts, left), np.searchsorted(rights, right)
            i, j = np.minimum(i, len(lefts) - 1), np.minimum(j, len(rights) - 1)
            both = np.flatnonzero((lefts[i] == left) & (rights[j] == right))
            keys = np.searchsorted(lefts, asked_left) * len(rights) + np.searchsorted(rights, asked_right)
            order = np.argsort(keys)
            key = i[both] * len(rights) + j[both]
            found = np.minimum(np.searchsorted(keys, key, sorter=order), len(keys) - 1)
            hit = keys[order][found] == key
            yield _state(row["unit"].as_py(), at[both[hit]], ids[order[found[hit]]])

    return stored(state.join(known.hint("merge"), "unit").mapInArrow(place, _STATE))


def _scored(phrases: DataFrame, longer: DataFrame | None) -> DataFrame:
    """Phrases that no longer one contains each time, with their weakest cut."""
    if longer is not None:
        around = longer.select(F.col("left").alias("id"), F.col("n").alias("m"))
        around = around.unionByName(longer.select(F.col("right").alias("id"), F.col("n").alias("m")))
        most = around.groupBy("id").agg(F.max("m").alias("m"))
        phrases = phrases.join(most, "id", "left").filter("m is null or m < n")
    number = "cast({} as decimal(38,0))".format
    score = f"({number(1000)} * {number('n')} * {number('n_all')}) div ({number('pre[k - 1]')} * {number('suf[size(pre) - k]')})"
    cuts = f"transform(sequence(1, size(pre)), k -> named_struct('score', {score}, 'k', k, 'l', pre[k - 1], 'r', suf[size(pre) - k]))"
    return phrases.withColumn("cut", F.array_min(F.expr(cuts))).select(
        "lang", F.array_join("words", " ").alias("phrase"), F.col("n").alias("a"), "cut.l", "cut.r", F.col("n_all").alias("n"), "cut.score"
    )


def collocations(
    docs: DataFrame,
    min_count: int = MIN_COUNT,
    longest: int = LONGEST,
    top: int | None = TOP,
    text_col: str = "text",
    lang_col: str = "lang",
    unit_bytes: int = UNIT_BYTES,
) -> DataFrame:
    """Phrases of 2 to ``longest`` words with at least ``min_count`` occurrences, by how much they exceed chance.

    Returns, for each language's first ``top`` (all, if None): lang, rank from 1, phrase, a (its
    occurrences), l and r (those of its two parts at the weakest cut), n (words of the language) and
    score, floor(1000 * a * n / (l * r)) at that cut. Order: score, then a, descending, then phrase.

    - A-Z in lower case; texts are split at .,;:!? and \\x0A-\\x0D into pieces, these at spaces and tabs into
      words; phrases do not cross pieces. A null language is ``und``; null texts have no words.
    - Occurrences overlap, and every row counts, also a repeated one. Texts are read whole.
    - Of equal scores of cuts the one after the fewest words counts. Phrases that are part of a
      longer one as frequent as themselves are left out.
    - No id is read, other columns may have any name. An empty table gives no rows.

    Words get ids by frequency within their language. Pairs of neighbouring ids fall into tiles of 16 by 1024
    ids; a task counts a tile with many entries by direct address and the others as sorted
    coordinates, and so does the bucket that adds the tasks' sums. Frequent pairs get ids by frequency
    in turn, and pairs of phrases that overlap in all but a word give the next length. The most frequent
    tile reaches its bucket with at most 16,384 sums per 5 MB of text.
    """
    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    units = _units(rows, unit_bytes)
    phrases = _frequent_words(units, min_count)
    state, found = _word_places(units, phrases), []
    for length in range(2, longest + 1):
        pairs = _frequent_pairs(state, min_count)
        shorter, phrases = phrases, _longer(pairs, phrases)
        if length > 2:
            found.append(_scored(shorter, phrases))
        if length < longest:
            state = _longer_places(state, pairs)
    scored = _scored(phrases, None)
    for more in found:
        scored = scored.unionByName(more)
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    if top is not None:  # the first of each of many parts of a language, before they meet
        part = F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))
        scored = scored.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(TOP_PARTS))).withColumn("nth", part)
        scored = scored.filter(F.col("nth") <= top).drop("salt", "nth")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    scored = scored.withColumn("rank", rank)
    scored = scored if top is None else scored.filter(F.col("rank") <= top)
    return scored.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
