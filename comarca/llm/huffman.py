"""Token ids in canonical, length-limited Huffman code, with blocks that decode on their own."""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from comarca.llm.byte_bpe import chunk_encoder
from comarca.llm.common import partitions, stored

MAX_BITS = 18
# Ids between two bit-offset checkpoints, and ids after which a segment is written out.
BLOCK_IDS = 512
SEGMENT_IDS = 1 << 20
RUN_BLOCKS = 32

SEGMENTS = (
    "row long, n_ids long, doc_ids array<long>, doc_sizes array<long>, checkpoints binary, payload binary"
)


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Lengths of the best prefix code with no code longer than ``max_bits``, by package-merge.

    Zero counts get no code. A single symbol gets one bit.
    """
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << max_bits:
        raise ValueError("more symbols than codes of that length")
    order = used[np.argsort(counts[used], kind="stable")]
    leaf = counts[order].astype(np.float64)
    # Level by level, packages of two; where the leaves stand in each level is enough to count them.
    weights, levels = leaf, []
    for _ in range(max_bits - 1):
        pairs = weights[: len(weights) // 2 * 2].reshape(-1, 2).sum(1)
        merged = np.concatenate((leaf, pairs))
        by_weight = np.argsort(merged, kind="stable")
        levels.append(by_weight < len(leaf))
        weights = merged[by_weight]
    take = 2 * len(leaf) - 2
    depth = np.zeros(len(leaf), np.int64)
    for is_leaf in reversed(levels):
        leaves = int(is_leaf[:take].sum())
        depth[:leaves] += 1
        take = 2 * (take - leaves)
    depth[:take] += 1
    lengths[order] = depth
    return lengths


class Code:
    """Canonical codes by (length, id): the lengths alone define them."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths
        order = np.lexsort((np.arange(len(lengths)), lengths))
        order = order[lengths[order] > 0]
        bits = lengths[order].astype(np.int64)
        self.max_bits = int(bits.max()) if len(bits) else 1
        spans = np.int64(1) << (self.max_bits - bits)
        self.codes = np.zeros(len(lengths), np.uint64)
        self.codes[order] = ((np.cumsum(spans) - spans) >> (self.max_bits - bits)).astype(np.uint64)
        # What each window of max_bits bits begins with: an id, and how long its code is.
        self.ids = np.zeros(1 << self.max_bits, np.uint32)
        self.steps = np.ones(1 << self.max_bits, np.uint8)
        filled = int(spans.sum())
        self.ids[:filled] = np.repeat(order, spans)
        self.steps[:filled] = np.repeat(bits, spans)

    def encode(self, ids: np.ndarray, block: int = BLOCK_IDS) -> tuple[bytes, bytes]:
        """The bits, most significant first, and the bit offset of every block as 8-byte integers."""
        if not len(ids):
            return b"", b""
        blocks = np.add.reduceat(self.lengths[ids], np.arange(0, len(ids), block), dtype=np.int64)
        offsets = np.cumsum(blocks) - blocks
        total = int(offsets[-1] + blocks[-1])
        out = np.zeros((total >> 6) + 2, np.uint64)
        for i in range(0, len(blocks), RUN_BLOCKS):  # short runs stay in the processor's cache
            self._fill(out, int(offsets[i]), ids[i * block : (i + RUN_BLOCKS) * block])
        return out.astype(">u8").tobytes()[: (total + 7) >> 3], offsets.astype("<u8").tobytes()

    def _fill(self, out: np.ndarray, offset: int, ids: np.ndarray) -> None:
        bits = self.lengths[ids].astype(np.int64)
        starts = offset + np.cumsum(bits) - bits
        word, used = starts >> 6, (starts & 63) + bits
        codes = self.codes[ids]
        over = np.flatnonzero(used > 64)  # at most one code in a word reaches into the next
        shift = 64 - used
        shift[over] = 0
        whole = codes << shift.astype(np.uint64)
        whole[over] = codes[over] >> (used[over] - 64).astype(np.uint64)
        firsts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        out[word[firsts]] |= np.bitwise_or.reduceat(whole, firsts)
        out[word[over] + 1] |= codes[over] << (128 - used[over]).astype(np.uint64)

    def decode(self, payload: bytes, checkpoints: bytes, n_ids: int, block: int = BLOCK_IDS) -> np.ndarray:
        """All blocks advance together, an id each per step."""
        raw = np.frombuffer(payload + bytes(8), np.uint8).astype(np.uint32)
        windows = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
        at = np.frombuffer(checkpoints, "<u8").astype(np.int64)
        out = np.zeros((block, len(at)), np.uint32)
        mask, room = np.uint32((1 << self.max_bits) - 1), 32 - self.max_bits
        for i in range(block):
            if i == n_ids - (len(at) - 1) * block:  # the last block is done
                at = at[:-1]
            look = windows[at >> 3] >> (room - (at & 7)).astype(np.uint32) & mask
            out[i, : len(at)] = self.ids[look]
            at = at + self.steps[look]
        return out.T.ravel()[:n_ids] if len(checkpoints) else out[0, :0]


@lru_cache(2)
def _code(lengths: bytes) -> Code:
    return Code(np.frombuffer(lengths, np.uint8))


def token_ids(docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, row) in ascending id order; ids are little-endian integers with the end id, row counts up.

    Texts are dealt by ranges of the id first, so the ids are made where they are written.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ranged = rows.repartitionByRange(partitions(spark), F.col("id").asc_nulls_first(), F.xxhash64("text"))
    ranged = ranged.sortWithinPartitions(F.col("id").asc_nulls_first())

    def encode(batches):
        encoder = chunk_encoder(path)
        end = np.array([end_id], encoder.dtype).tobytes()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            ids = [x + end for x in encoder.encode(texts)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(ids, pa.binary())], ["id", "ids"])

    # The row number has the partition in its upper bits: see monotonically_increasing_id.
    return ranged.mapInArrow(encode, "id long, ids binary").withColumn("row", F.monotonically_increasing_id())


def _joined_ids(column: pa.BinaryArray, width: int) -> np.ndarray:
    """The ids of all rows of a batch, where Arrow has them in a row."""
    if not len(column):
        return np.zeros(0, f"<u{width}")
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].view(f"<u{width}")


def id_counts(tokens: DataFrame, width: int, vocabulary: int) -> np.ndarray:
    """How often each id occurs in all documents; at most a row per id comes back."""

    def count(batches):
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            ids = _joined_ids(batch.column("ids"), width)
            for at in range(0, len(ids), SEGMENT_IDS):
                total += np.bincount(ids[at : at + SEGMENT_IDS], minlength=vocabulary)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["token", "n"])

    counted = tokens.select("ids").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    out = np.zeros(vocabulary, np.int64)
    for row in counted.collect():
        out[row.token] = row.n
    return out


def write_ids(tokens: DataFrame, lengths: np.ndarray, width: int) -> DataFrame:
    """Segments of Huffman code, one row each, written to Parquet in the shared folder.

    A segment holds whole documents, about ``SEGMENT_IDS`` ids or one longer document, that
    follow each other; ``row`` is the number of the first. Per document it has the id and the
    number of ids, per block of ``BLOCK_IDS`` ids the bit offset.
    """
    key = lengths.tobytes()

    def segment(code, row, names, docs):
        ids = np.concatenate(docs)
        payload, checkpoints = code.encode(ids)
        values = [row, len(ids), names, [len(d) for d in docs], checkpoints, payload]
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
        names = [c.split()[0] for c in SEGMENTS.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names)

    def segments(batches):
        code, row, names, docs, size = _code(key), 0, [], [], 0
        for batch in batches:
            for at, name, ids in zip(*(batch.column(c) for c in ("row", "id", "ids"))):
                at = at.as_py()
                if docs and (size >= SEGMENT_IDS or at != row + len(docs)):
                    yield segment(code, row, names, docs)
                    names, docs, size = [], [], 0
                row = row if docs else at
                names.append(name.as_py())
                docs.append(np.frombuffer(ids.as_buffer(), f"<u{width}"))
                size += len(docs[-1])
        if docs:
            yield segment(code, row, names, docs)

    return stored(tokens.mapInArrow(segments, SEGMENTS))


def read_ids(segments: DataFrame, lengths: np.ndarray, use, schema: str) -> DataFrame:
    """Decodes the segments and gives each document's ids, as 4-byte integers, to ``use``.

    ``use(id, ids)`` returns the values of one row under ``schema``; the columns seg (the
    segment's row), at (ids of the segment before the document) come with it.
    """
    key = lengths.tobytes()

    def documents(batches):
        code = _code(key)
        for batch in batches:
            rows = []
            for s in batch.to_pylist():
                ids, at = code.decode(s["payload"], s["checkpoints"], s["n_ids"]), 0
                for name, size in zip(s["doc_ids"], s["doc_sizes"]):
                    rows.append((s["row"], at, *use(name, ids[at : at + size])))
                    at += size
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)

    fields = [c.split() for c in f"seg long, at long, {schema}".split(", ")]
    out = pa.schema([(name, _ARROW[kind]) for name, kind in fields])
    return segments.mapInArrow(documents, f"seg long, at long, {schema}")


_ARROW = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}


def segment_starts(segments: DataFrame) -> DataFrame:
    """(seg, start): ids of all documents before the segment, by prefix sums of the parts' totals."""
    slim = segments.select(F.col("row").alias("seg"), "n_ids", F.shiftright("row", 33).alias("part"))
    before = (Window.unboundedPreceding, -1)
    parts = slim.groupBy("part").agg(F.sum("n_ids").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(*before)), F.lit(0)).alias("offset")
    )
    within = F.sum("n_ids").over(Window.partitionBy("part").orderBy("seg").rowsBetween(*before))
    return slim.withColumn("within", F.coalesce(within, F.lit(0))).join(parts, "part").select(
        "seg", (F.col("offset") + F.col("within")).alias("start")
    )


def _digest(name, ids: np.ndarray) -> tuple:
    return name, len(ids), zlib.crc32(ids.astype("<u4").tobytes())


def encoded_ids(
    docs: DataFrame, path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Encodes every whole text, writes the ids in Huffman code and reads the files back.

    Returns from the files: id, start (ids of all documents before it), n_tokens (with the end
    id) and ids_crc32 of the ids as little-endian 4-byte integers.

    - Null and empty texts have the end id alone. Texts of any length are encoded whole.
    - Null ids come first. Repeated ids and equal rows are written one by one, next to each other.
    - Other columns may have any name. An empty table gives no rows.

    Texts are shuffled once, by ranges of the id. The global counts, at most one per id of the
    vocabulary, are all that the driver sees; the code follows from them alone.
    """
    encoder = chunk_encoder(path)
    width, vocabulary = encoder.dtype.itemsize, len(encoder.spaced)
    tokens = stored(token_ids(docs, path, end_id, id_col, text_col))
    lengths = code_lengths(id_counts(tokens, width, vocabulary))
    segments = write_ids(tokens, lengths, width)
    found = read_ids(segments, lengths, _digest, "id long, n_tokens long, ids_crc32 long")
    return found.join(segment_starts(segments), "seg").select(
        F.col("id").alias(id_col),
        (F.col("start") + F.col("at")).alias("start"),
        "n_tokens",
        "ids_crc32",
    )
