"""Blocks of whole texts, and questions that blocks ask about all others."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from comarca.llm.common import partitions
from comarca.sources import work_folder

BLOCK_BYTES = 3_000_000
# Rows of a batch that become Python's at a time; a text takes up to four bytes a character there.
ROWS = 256


def fresh_blocks(batches: Iterator[pa.RecordBatch], ids: str, texts: str, size: int = BLOCK_BYTES):
    """Yields (block, ids, texts) of about so many bytes, a text never cut; block numbers are unique in the job."""
    block, held_ids, held, so_far = TaskContext.get().partitionId() << 33, [], [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            for i, text in zip(part.column(ids).to_pylist(), part.column(texts).to_pylist()):
                held_ids.append(i)
                held.append(text or "")
                so_far += len(held[-1])
                if so_far >= size:
                    yield block, held_ids, held
                    block, held_ids, held, so_far = block + 1, [], [], 0
    if held:
        yield block, held_ids, held


def text_blocks(docs: DataFrame, id_col: str, text_col: str, size: int = BLOCK_BYTES) -> DataFrame:
    """(block, ids, texts) as a table bucketed by block, so that joins with answers do not move the texts again."""

    def pack(batches):
        for block, ids, texts in fresh_blocks(batches, "id", "text", size):
            columns = [pa.array([block]), pa.array([ids], pa.list_(pa.int64())), pa.array([texts], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, ["block", "ids", "texts"])

    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    blocks = rows.mapInArrow(pack, "block long, ids array<long>, texts array<string>")
    n, name = partitions(spark), f"blocks_{uuid.uuid4().hex}"
    writer = blocks.repartition(n, "block").write.bucketBy(n, "block").option("compression", "zstd")
    writer.option("path", f"{work_folder(spark)}/{name}").saveAsTable(name)
    return spark.table(name)


def bytes_of(values: np.ndarray, keep: int) -> bytes:
    """The lowest bytes of 64-bit values, byte by byte, which compresses better than value by value."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(len(values), 8)[:, :keep].T).tobytes()


def values_of(raw: bytes, keep: int) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(keep, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :keep] = planes.T
    return out.view("<u8").ravel()


def cuts_of(sorted_keys: np.ndarray, buckets: int, bits: int) -> np.ndarray:
    """Where each bucket's keys begin among sorted keys of so many bits; buckets are equal ranges of the keys."""
    borders = [((b << bits) + buckets - 1) // buckets for b in range(buckets)]
    return np.append(np.searchsorted(sorted_keys, np.array(borders, np.uint64)), len(sorted_keys))


def gathered(batches: Iterator[pa.RecordBatch], columns: list[str]):
    """Yields (bucket, rows) of batches sorted by their first column, ``bucket``."""
    at, held = None, []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in columns)):
            if held and row[0] != at:
                yield at, held
                held = []
            at = row[0]
            held.append(row[1:])
    if held:
        yield at, held


ASKED = "bucket int, block long, high binary, low binary, flags binary"
ANSWER = "block long, bucket int, bits binary"
_SEVERAL, _MARKED = 1, 2


def asked(block: int, high: np.ndarray, low: np.ndarray | None, several: np.ndarray, marked: np.ndarray, buckets: int, keep: int):
    """A batch of a block's questions: its distinct keys, sorted, whether it has one several times, and a mark."""
    cuts = cuts_of(high, buckets, 8 * keep)
    flags = (several * _SEVERAL + marked * _MARKED).astype(np.uint8)
    some = np.flatnonzero(np.diff(cuts))
    rows = [
        (int(b), block, bytes_of(high[cuts[b] : cuts[b + 1]], keep),
         b"" if low is None else bytes_of(low[cuts[b] : cuts[b + 1]], 8), flags[cuts[b] : cuts[b + 1]].tobytes())
        for b in some
    ]
    kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    names = ["bucket", "block", "high", "low", "flags"]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names)


def recurring(questions: DataFrame, keep: int) -> DataFrame:
    """(block, bucket, bits): for every key asked about, whether it occurs twice or more in all and is marked anywhere.

    A block asks about a key once, so the most frequent key reaches its bucket once per block.
    Buckets are ranges of hashes: none can be hot.
    """

    def answer(batches):
        for bucket, rows in gathered(batches, ["bucket", "block", "high", "low", "flags"]):
            high = np.concatenate([values_of(r[1], keep) for r in rows])
            flags = np.frombuffer(b"".join(r[3] for r in rows), np.uint8)
            if rows[0][2]:
                low = np.concatenate([values_of(r[2], 8) for r in rows])
                order = np.lexsort((low, high))
                new = np.r_[True, (np.diff(high[order]) != 0) | (np.diff(low[order]) != 0)]
            else:
                order = np.argsort(high, kind="stable")
                new = np.r_[True, np.diff(high[order]) != 0]
            first, sorted_flags = np.flatnonzero(new), flags[order]
            times = np.add.reduceat(1 + (sorted_flags & _SEVERAL).astype(np.int64), first)
            known = (times > 1) & ((np.bitwise_or.reduceat(sorted_flags, first) & _MARKED) > 0)
            out = np.empty(len(order), bool)
            out[order] = known[np.cumsum(new) - 1]
            ends = np.cumsum([len(r[3]) for r in rows])
            bits = [np.packbits(part).tobytes() for part in np.split(out, ends[:-1])]
            columns = [pa.array([r[0] for r in rows]), pa.array([bucket] * len(rows), pa.int32()), pa.array(bits, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["block", "bucket", "bits"])

    dealt = questions.repartition(partitions(questions.sparkSession), "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(answer, ANSWER)


def answers_by_block(answers: DataFrame, name: str) -> DataFrame:
    """(block, name): all answers of a block; there are as many bits as the block has distinct keys."""
    return answers.groupBy("block").agg(F.collect_list(F.struct("bucket", "bits")).alias(name))


def answered(high: np.ndarray, found: list[dict] | None, buckets: int, keep: int) -> np.ndarray:
    """The answers to a block's sorted distinct keys."""
    out = np.zeros(len(high), bool)
    cuts = cuts_of(high, buckets, 8 * keep)
    for part in found or ():
        a, b = cuts[part["bucket"]], cuts[part["bucket"] + 1]
        out[a:b] = np.unpackbits(np.frombuffer(part["bits"], np.uint8), count=b - a)
    return out


