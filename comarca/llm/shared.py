"""Tokens that several texts share: an exchange that no frequent token can overload."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from comarca.llm.common import partitions, stored

FLUSH_TOKENS = 1_000_000
_TOKEN = np.uint64((1 << 48) - 1)
# Upper bit of a place: the flush has passed this occurrence on already.
_KNOWN, _PLACE = 1 << 31, (1 << 31) - 1

# A text's class, its size, its tokens and where they stand.
Found = tuple[int, int, np.ndarray, np.ndarray]


def class_name(a: int, b: int, shift: int) -> int:
    """A class's 64-bit name out of its 128 bits; the shift is chosen so that names are unique."""
    value = (a ^ (b << shift)) & ((1 << 64) - 1)
    return value - (1 << 64) if value >> 63 else value


def classes_of(slim: DataFrame) -> tuple[DataFrame, int]:
    """(a, b, rep, n, copies, x): classes of rows (id, n, a, b) with n > 0 by their 128 bits, and the shift of their names.

    ``rep`` is the smallest id, null if no document of the class has one.
    """
    classes = stored(
        slim.filter("n > 0").groupBy("a", "b").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.count("*").alias("copies"))
    )
    for shift in range(64):
        named = classes.withColumn("x", F.col("a").bitwiseXOR(F.shiftleft("b", shift)))
        if named.groupBy("x").count().filter("count > 1").isEmpty():
            return named, shift
    raise ValueError("no shift gives unique names")


def texts_of(docs: DataFrame, wanted: DataFrame, sign: Callable[[list[str | None]], Iterable[tuple[int, int] | None]]) -> DataFrame:
    """The rows of ``wanted`` (a, b, rep, ...), without these three, and the text of each one's class.

    It is fetched by the class's smallest id, or by its 128 bits, which ``sign`` makes, where none of its documents has an id.
    An id with several texts brings all of them.
    """

    def signed(batches):
        for batch in batches:
            texts, found = batch.column("text").to_pylist(), {}
            for text, bits in zip(texts, sign(texts)):
                if bits is not None:
                    found.setdefault(bits, text)
            columns = [pa.array([bits[i] for bits in found], pa.int64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found.values(), pa.string())], ["a", "b", "text"])

    by_id = docs.join(wanted.hint("merge"), docs["id"] == wanted["rep"]).drop("id", "rep", "a", "b")
    unnamed = docs.filter("id is null").select("text").mapInArrow(signed, "a long, b long, text string").dropDuplicates(["a", "b"])
    by_bits = unnamed.join(wanted.filter("rep is null").hint("merge"), ["a", "b"]).drop("rep", "a", "b")
    return by_id.unionByName(by_bits)


def _planes(values: np.ndarray, dtype: str, keep: int) -> bytes:
    """The lowest bytes of each value, byte by byte, which compresses better than value by value."""
    return np.ascontiguousarray(values.astype(dtype).view(np.uint8).reshape(len(values), -1)[:, :keep].T).tobytes()


def _unplaned(raw: bytes, dtype: str, keep: int) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(keep, -1)
    out = np.zeros((planes.shape[1], np.dtype(dtype).itemsize), np.uint8)
    out[:, :keep] = planes.T
    return out.view(dtype).ravel()


_BLOB = ["bucket", "token", "x", "pos", "n"]


def shared_tokens(
    texts: DataFrame, produce: Callable[[Iterable[pa.RecordBatch]], Iterator[Found]], only_count: bool = False
) -> DataFrame:
    """(token, x, pos, n): the tokens, 48 bits of them, that occur twice or more, and where.

    With ``only_count`` a row says that x has ``pos`` more such tokens.

    A task gathers the tokens of its texts, each class once. Tokens it sees twice are known to
    be shared. Of every token one occurrence goes to the token's bucket, which so gets at
    most one per flush however frequent the token is, and there occurrences that stood
    alone find each other. A class that several tasks have may bring the same row again.
    """
    spark = texts.sparkSession
    buckets = 4 * partitions(spark)

    def gather(batches):
        seen, held, size = set(), [], 0
        for x, n, tokens, pos in produce(batches):
            if x in seen:
                continue
            seen.add(x)
            held.append((x, n, tokens & _TOKEN, pos))
            size += len(tokens)
            if size >= FLUSH_TOKENS:
                yield from flush(held)
                held, size = [], 0
        if size:
            yield from flush(held)

    def flush(held):
        sizes = np.array([len(h[2]) for h in held])
        token, pos = np.concatenate([h[2] for h in held]), np.concatenate([h[3] for h in held])
        x = np.repeat(np.array([h[0] for h in held], np.int64), sizes)
        n = np.repeat(np.array([h[1] for h in held], np.int64), sizes)
        order = np.argsort(token, kind="stable")
        token, x, n, pos = token[order], x[order], n[order], pos[order]
        new = np.r_[True, token[1:] != token[:-1]]
        alone = new & np.r_[new[1:], True]
        # To its bucket goes a token's first occurrence; known shared ones pass through any task.
        known = np.where(alone, 0, _KNOWN)[new]
        yield from dealt_out((token[new] % np.uint64(buckets)).astype(np.int64), token[new], x[new], pos[new] | known, n[new])
        token, x, pos, n = (v[~alone] for v in (token, x, pos, n))
        if only_count:
            x, pos = np.unique(x, return_counts=True)
            token, n = np.zeros(len(x), np.uint64), np.zeros(len(x), np.int64)
        if len(x):
            yield from dealt_out(buckets + np.arange(len(x)) * buckets // len(x), token, x, pos, n)

    def dealt_out(bucket, token, x, pos, n):
        order = np.argsort(bucket, kind="stable")
        bucket, token, x, pos, n = (v[order] for v in (bucket, token, x, pos, n))
        cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        rows = [
            (int(bucket[i]), _planes(token[i:j], "<u8", 6), x[i:j].tobytes(), _planes(pos[i:j], "<u4", 4), _planes(n[i:j], "<u4", 4))
            for i, j in zip(cuts, np.r_[cuts[1:], len(bucket)])
        ]
        kinds = [pa.int32()] + [pa.binary()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], _BLOB)

    def shared(batches):
        at, held = None, []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in _BLOB)):
                if held and row[0] != at:
                    yield from meet(at, held)
                    held = []
                at = row[0]
                held.append(row[1:])
        if held:
            yield from meet(at, held)

    def meet(bucket, held):
        token = np.concatenate([_unplaned(r[0], "<u8", 6) for r in held])
        x = np.concatenate([np.frombuffer(r[1], np.int64) for r in held])
        pos = np.concatenate([_unplaned(r[2], "<u4", 4) for r in held])
        n = np.concatenate([_unplaned(r[3], "<u4", 4) for r in held])
        if bucket < buckets:
            order = np.lexsort((pos & _PLACE, x, token))
            token, x, pos, n = token[order], x[order], pos[order], n[order]
            new = np.r_[True, token[1:] != token[:-1]]
            group = np.cumsum(new) - 1
            known, place = pos >= _KNOWN, pos & _PLACE
            fresh = np.r_[True, (token[1:] != token[:-1]) | (x[1:] != x[:-1]) | (place[1:] != place[:-1])]
            several = np.bincount(group[fresh], minlength=group[-1] + 1) > 1
            elsewhere = np.zeros(group[-1] + 1, bool)
            elsewhere[group[known]] = True
            # Known ones have been passed on already.
            keep = fresh & ~known & (several | elsewhere)[group]
            token, x, pos, n = token[keep], x[keep], pos[keep], n[keep]
            if only_count:
                x, pos = np.unique(x, return_counts=True)
                token, n = np.zeros(len(x), np.uint64), np.zeros(len(x), np.int64)
        values = [token.astype(np.int64), x, pos.astype(np.int64), n.astype(np.int64)]
        for i in range(0, len(token), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(v[i : i + (1 << 16)]) for v in values], _BLOB[1:])

    blobs = texts.mapInArrow(gather, "bucket int, token binary, x binary, pos binary, n binary")
    dealt = blobs.repartition(partitions(spark), "bucket").sortWithinPartitions("bucket")
    return stored(dealt.mapInArrow(shared, "token long, x long, pos long, n long"))
