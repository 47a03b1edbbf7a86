"""Language-model scores of documents, next to a unigram baseline over the words of the corpus."""

from __future__ import annotations

import zlib
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from comarca.llm.attention import (
    BATCH, COLUMNS, INPUTS, ROUNDS, STEPS, STRIDE, WINDOW, Model, Vocabulary, fit, log_probabilities, packed, pair_counts, untrained, windows,
)
from comarca.llm.byte_bpe import chunk_encoder
from comarca.llm.common import partitions, slices, stored, training_remainder
from comarca.llm.shingles import LOWER_CASE, powers, mix

FLUSH_WORDS = 1 << 21
SLICE_BYTES = 1_000_000

# A-Z in lower case, white space as a space.
_PLAIN = bytes(0x20 if 0x09 <= b <= 0x0D else b for b in LOWER_CASE)


def _normal(text: str | None) -> str:
    """The words, each with one space in front; white space is \\x20 and \\x09-\\x0D."""
    raw = (text or "").encode("utf-8", "surrogatepass").translate(_PLAIN)
    if b"  " in raw or raw[:1] == b" " or raw[-1:] == b" ":
        raw = b" ".join(raw.split())
    return " " + raw.decode("utf-8", "surrogatepass") if raw else ""


def _tokenized(docs: DataFrame, path: str, divisor: int, held_out: int) -> DataFrame:
    """(block, id, held_out, ids): the ids of every text, and the task that made them."""

    def encode(batches):
        encoder = chunk_encoder(path, True)
        for batch in batches:
            ids = encoder.encode([_normal(t) for t in batch.column("text").to_pylist()])
            columns = [batch.column("id"), batch.column("held_out"), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "held_out", "ids"])

    held = training_remainder(F.col("id"), divisor) == held_out
    found = docs.withColumn("held_out", held).mapInArrow(encode, "id long, held_out boolean, ids binary")
    return stored(found.withColumn("block", F.spark_partition_id()))


def _words(ids: np.ndarray, spaced: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start in a row of ids, and a 64-bit hash of each; ids tell words apart."""
    starts = np.flatnonzero(spaced[ids])
    power, inverse = powers(len(ids) + 1)
    sums = np.zeros(len(ids) + 1, np.uint64)
    np.cumsum((ids.astype(np.uint64) + np.uint64(1)) * power[: len(ids)], out=sums[1:])
    ends = np.append(starts[1:], len(ids))
    return starts, mix((sums[ends] - sums[starts]) * inverse[starts])


def _joined(rows: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(r) // width for r in rows])
    return np.frombuffer(b"".join(rows), f"<u{width}"), lengths


def _id_counts(tokens: DataFrame, width: int, vocabulary: int) -> np.ndarray:
    """How often each id occurs in the training texts; at most a row per id comes back."""

    def count(batches):
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            total += np.bincount(_joined(batch.column("ids").to_pylist(), width)[0], minlength=vocabulary)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["token", "n"])

    rows = tokens.filter("not held_out").select("ids").mapInArrow(count, "token long, n long")
    out = np.zeros(vocabulary, np.int64)
    for row in rows.groupBy("token").agg(F.sum("n").alias("n")).collect():
        out[row.token] = row.n
    return out


def _pair_counts(tokens: DataFrame, width: int, words: Vocabulary, end: int) -> np.ndarray:
    """``pair_counts`` of all training texts: a table of fixed size, summed over the tasks in row groups."""

    def count(batches):
        total = np.zeros((INPUTS, COLUMNS), np.int64)
        for batch in batches:
            texts = [np.append(np.frombuffer(r, f"<u{width}"), end).astype(np.int64) for r in batch.column("ids").to_pylist()]
            for i in range(0, len(texts), 512):
                total += pair_counts(words, texts[i : i + 512], end)
        for row in np.flatnonzero(total.any(1)):
            some = np.flatnonzero(total[row])
            yield from _row(row, some, total[row, some])

    def add(batches):
        at, total = None, np.zeros(COLUMNS, np.int64)
        for batch in batches:
            for row, columns, n in zip(*(batch.column(c).to_pylist() for c in ("row", "columns", "n"))):
                if at is not None and row != at:
                    yield from _row(at, np.flatnonzero(total), total[total > 0])
                    total[:] = 0
                at = row
                total[np.frombuffer(columns, "<i2")] += np.frombuffer(n, "<i8")
        if at is not None:
            yield from _row(at, np.flatnonzero(total), total[total > 0])

    schema = "row int, columns binary, n binary"
    parts = tokens.filter("not held_out").select("ids").mapInArrow(count, schema)
    dealt = parts.repartition(partitions(tokens.sparkSession), "row").sortWithinPartitions("row")
    out = np.zeros((INPUTS, COLUMNS), np.int64)
    for r in dealt.mapInArrow(add, schema).collect():
        out[r.row, np.frombuffer(bytes(r.columns), "<i2")] = np.frombuffer(bytes(r.n), "<i8")
    return out


def _row(row: int, columns: np.ndarray, n: np.ndarray):
    values = [pa.array([int(row)], pa.int32()), pa.array([columns.astype("<i2").tobytes()], pa.binary()), pa.array([n.astype("<i8").tobytes()], pa.binary())]
    yield pa.RecordBatch.from_arrays(values, ["row", "columns", "n"])


_PARTS = ["bucket", "block", "hashes", "counts"]


def _word_counts(tokens: DataFrame, width: int, path: str) -> DataFrame:
    """(block, hashes, counts, total, different): for every block's words their training counts in the corpus.

    A task sums its words per block first, so a frequent word comes to its bucket once per
    block. The bucket adds them up and answers each block. Rows with block -1 have the sum of the
    training counts and the number of different words.
    """
    buckets = 4 * partitions(tokens.sparkSession)

    def gather(batches):
        spaced, held = chunk_encoder(path, True).spaced, {}
        for batch in batches:
            blocks = np.array(batch.column("block"))
            outside = np.array(batch.column("held_out").to_pylist(), bool)
            rows = batch.column("ids").to_pylist()
            for block in np.unique(blocks).tolist():
                mine, at = np.flatnonzero(blocks == block), 0
                for run in slices([rows[i] for i in mine], SLICE_BYTES):
                    ids, lengths = _joined(run, width)
                    starts, hashes = _words(ids, spaced)
                    training = np.repeat(~outside[mine[at : at + len(run)]], lengths)[starts]
                    held.setdefault(block, []).append(_summed(hashes, training.astype(np.int64)))
                    at += len(run)
                if sum(len(h) for h, _ in held[block]) > FLUSH_WORDS:
                    yield from flush(block, held.pop(block))
        for block, parts in held.items():
            yield from flush(block, parts)

    def flush(block, parts):
        hashes, counts = _summed(np.concatenate([h for h, _ in parts]), np.concatenate([c for _, c in parts]))
        bucket = (hashes % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        hashes, counts, bucket = hashes[order], counts[order], bucket[order]
        cuts = np.searchsorted(bucket, np.arange(buckets + 1))
        some = np.flatnonzero(np.diff(cuts))
        rows = [(int(b), block, hashes[cuts[b] : cuts[b + 1]].tobytes(), counts[cuts[b] : cuts[b + 1]].astype("<u4").tobytes()) for b in some]
        if rows:
            kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], _PARTS)

    def answer(batches):
        at, held = None, []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in _PARTS)):
                if held and row[0] != at:
                    yield added(held)
                    held = []
                at = row[0]
                held.append(row[1:])
        if held:
            yield added(held)

    def added(held):
        sizes = np.array([len(h) // 8 for _, h, _ in held])
        hashes = np.frombuffer(b"".join(h for _, h, _ in held), "<u8")
        counts = np.frombuffer(b"".join(c for _, _, c in held), "<u4").astype(np.int64)
        words, where = np.unique(hashes, return_inverse=True)
        totals = np.bincount(where, counts, len(words)).astype(np.int64)
        back, ends = totals[where], np.cumsum(sizes)
        rows = [(b, h, back[e - s : e].tobytes(), 0, 0) for (b, h, _), s, e in zip(held, sizes, ends)]
        rows.append((-1, b"", b"", int(totals.sum()), int((totals > 0).sum())))
        kinds = [pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
        names = ["block", "hashes", "counts", "total", "different"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    sent = tokens.select("block", "held_out", "ids").mapInArrow(gather, "bucket int, block int, hashes binary, counts binary")
    dealt = sent.repartition(partitions(tokens.sparkSession), "bucket").sortWithinPartitions("bucket")
    return stored(dealt.mapInArrow(answer, "block int, hashes binary, counts binary, total long, different long"))


def _summed(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    words, where = np.unique(hashes, return_inverse=True)
    return words, np.bincount(where, counts, len(words)).astype(np.int64)


def _fitted(tokens: DataFrame, width: int, words: Vocabulary, pairs: np.ndarray, end: int) -> Model:
    """Weights fitted on the windows of all training texts, whatever their length.

    Each round deals a part of the windows to shards by a hash of text and place, so that the rounds see all of
    them once; each shard does the same number of steps, and the mean of its weights, by windows, opens the next round.
    The number of shards grows with the corpus. A corpus too small for the steps is seen whole in each round.
    """
    model = untrained(words, pairs, end)
    texts = tokens.filter("not held_out").select("id", "ids")
    more = f"greatest(0, ceil((octet_length(ids) / {width} + 1 - {WINDOW}) / {STRIDE}))"
    total = texts.agg(F.sum(F.expr(f"1 + {more}"))).first()[0] or 0
    shards = max(1, -(-total // (STEPS * BATCH)))
    parts = ROUNDS if total >= STEPS * BATCH else 1
    for nth in range(ROUNDS if total else 0):
        model.parts = _round(texts, width, model, nth, parts, int(shards))
    return model


def _round(texts: DataFrame, width: int, model: Model, nth: int, parts: int, shards: int) -> dict[str, np.ndarray]:
    words, end, steps = model.words, model.end, STEPS // ROUNDS
    names = sorted(model.parts)
    # What is in a class takes no part in the fit, so the counts stay here.
    fitting = replace(model, within=np.empty(0, np.float32))
    # Pieces of the weights, each summed by one task.
    pieces = 16

    def cut(batches):
        seen = 0
        for batch in batches:
            raws, ids, at = batch.column("ids").to_pylist(), batch.column("id").to_pylist(), 0
            for run in slices(raws, SLICE_BYTES):
                texts = [np.append(np.frombuffer(r, f"<u{width}"), end).astype(np.int64) for r in run]
                # Null ids are told apart by their place, so that no key is hot.
                keys = [seen + i if ids[at + i] is None else ids[at + i] for i in range(len(run))]
                keys = mix(np.array(keys, np.int64).astype(np.uint64) ^ (np.array([zlib.crc32(r) for r in run], np.uint64) << np.uint64(32)))
                at, seen = at + len(run), seen + len(run)
                lengths = np.array([len(t) for t in texts])
                begin, text, left = windows(lengths)
                hashes = mix(keys[text] + left.astype(np.uint64))
                mine = np.flatnonzero(hashes % np.uint64(parts) == nth % parts)
                shard = (hashes[mine] // np.uint64(parts) % np.uint64(shards)).astype(np.int64)
                rows = packed(words, words.column[np.concatenate(texts)], lengths, end, mine)
                order = np.argsort(shard, kind="stable")
                rows, found = rows[order], np.unique(shard)
                cuts = np.append(np.searchsorted(shard[order], found), len(rows))
                values = [rows[cuts[i] : cuts[i + 1]].tobytes() for i in range(len(found))]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(values, pa.binary())], ["shard", "rows"])

    def learn(batches):
        at, held, total, weight = None, [], 0.0, 0
        for batch in batches:
            for shard, rows in zip(batch.column("shard").to_pylist(), batch.column("rows").to_pylist()):
                if held and shard != at:
                    total, weight = added(total, weight, held)
                    held = []
                at = shard
                held.append(rows)
        if held:
            total, weight = added(total, weight, held)
        if weight:
            values = [v.astype("<f4").tobytes() for v in np.array_split(total / weight, pieces)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(pieces), pa.int32()), pa.array(values, pa.binary()), pa.array([weight] * pieces, pa.int64())],
                ["piece", "part", "weight"],
            )

    def added(total, weight, held):
        rows = np.frombuffer(b"".join(held), "<i2").reshape(-1, WINDOW + 3)
        fitted = fit(fitting, rows, nth * steps, steps, STEPS)
        return total + len(rows) * np.concatenate([fitted[n].ravel() for n in names]).astype(float), weight + len(rows)

    def mean(batches):
        sums, weights = {}, {}
        for batch in batches:
            for piece, part, weight in zip(*(batch.column(c).to_pylist() for c in ("piece", "part", "weight"))):
                sums[piece] = sums.get(piece, 0.0) + weight * np.frombuffer(part, "<f4").astype(float)
                weights[piece] = weights.get(piece, 0) + weight
        values = [(sums[p] / weights[p]).astype("<f4").tobytes() for p in sums]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(values, pa.binary())], ["piece", "part"])

    n = partitions(texts.sparkSession)
    dealt = texts.mapInArrow(cut, "shard int, rows binary").repartition(n, "shard").sortWithinPartitions("shard")
    learnt = dealt.mapInArrow(learn, "piece int, part binary, weight long").repartition(pieces, "piece")
    found = {r.piece: bytes(r.part) for r in learnt.mapInArrow(mean, "piece int, part binary").collect()}
    if not found:  # no window fell into this round
        return model.parts
    flat, out, at = np.frombuffer(b"".join(found[p] for p in range(pieces)), "<f4"), {}, 0
    for name in names:
        shape = model.parts[name].shape
        out[name] = flat[at : at + int(np.prod(shape))].reshape(shape).astype(np.float32)
        at += int(np.prod(shape))
    return out


def _scored(tokens: DataFrame, answers: DataFrame, width: int, path: str, model: Model, total: int, different: int, ends: int) -> DataFrame:
    """Each block's answers come first, then its documents."""
    bottom = float(np.log10(total + different + 1))

    def score(batches):
        block, parts, known, counts = None, [], None, None
        for batch in batches:
            held, size = [], 0
            rows = zip(*(batch.column(c).to_pylist() for c in ("block", "kind", "id", "held_out", "ids", "counts")))
            for at, is_text, name, outside, raw, n in rows:
                if at != block:
                    if held:
                        yield scored(held, known, counts)
                    block, parts, known, held, size = at, [], None, [], 0
                if not is_text:
                    parts.append((raw, n))
                    continue
                if known is None:
                    known = np.frombuffer(b"".join(h for h, _ in parts), "<u8")
                    order = np.argsort(known)
                    known, counts = known[order], np.frombuffer(b"".join(c for _, c in parts), "<i8")[order]
                    parts = []
                held.append((name, outside, raw))
                size += len(raw)
                if size > SLICE_BYTES:
                    yield scored(held, known, counts)
                    held, size = [], 0
            if held:
                yield scored(held, known, counts)

    def scored(held, known, counts):
        spaced, n = chunk_encoder(path, True).spaced, len(held)
        names, outside, raws = zip(*held)
        ids, lengths = _joined(raws, width)
        starts, hashes = _words(ids, spaced)
        c = counts[np.searchsorted(known, hashes)] if len(hashes) else counts[:0]
        text = np.searchsorted(np.cumsum(lengths), starts, "right")
        words = np.bincount(text, minlength=n) + 1
        base = np.bincount(text, np.log10(c + 1.0), n) + np.log10(ends + 1.0) - words * bottom
        found = np.bincount(text[c > 0], minlength=n) + (ends > 0)
        cuts = np.cumsum(lengths)[:-1]
        scores = log_probabilities(model, [np.append(t, model.end).astype(np.int64) for t in np.split(ids, cuts)]) / np.log(10)
        values = (names, outside, words, found, np.full(n, total), base, scores)
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, _SCORES)], schema=_SCORES)

    texts = tokens.select("block", F.lit(True).alias("kind"), "id", "held_out", "ids", F.lit(None).cast("binary").alias("counts"))
    replies = answers.filter("block >= 0").select(
        "block", F.lit(False), F.lit(None).cast("long"), F.lit(None).cast("boolean"), "hashes", "counts"
    )
    dealt = texts.union(replies).repartition(partitions(tokens.sparkSession), "block").sortWithinPartitions("block", "kind")
    return dealt.mapInArrow(score, ", ".join(f"{f.name} {_SQL[f.type]}" for f in _SCORES))


_SCORES = pa.schema(
    [("id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64())]
    + [("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]
)
_SQL = {pa.int64(): "long", pa.bool_(): "boolean", pa.float64(): "double"}


def language_scores(
    docs: DataFrame,
    path: str,
    end_id: int,
    divisor: int = 7,
    held_out: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The log10 probability of every whole text under a causal self-attention model and under word counts.

    Returns id, held_out, n_tokens (words and one end), n_known (those that occur in training
    texts), train_tokens (all training tokens), base_score (add-one unigram) and score (the model).

    - Null and empty texts are the end token alone. A-Z are lower-cased, white space only separates.
    - Texts of any length are scored whole, in overlapping windows that score each id once.
    - Repeated rows and null ids (held out as empty text would be) are scored one by one. Other
      columns may have any name. No training text: all counts are 0 and the model stays as it starts.
      An empty table gives no rows.

    The model predicts the class of the next subword id out of the ids before it. The id within its
    class follows from how often all training texts have it after the id before, or at all, with
    one added for every id, so that all ids have a probability. The attention weights are fitted on the windows of all
    training texts and all counts cover the whole corpus. Words are told apart by 64-bit hashes of their ids.
    """
    encoder = chunk_encoder(path, True)
    width, vocabulary = encoder.dtype.itemsize, len(encoder.spaced)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    tokens = _tokenized(rows, path, divisor, held_out)
    counts = _id_counts(tokens, width, vocabulary)
    ends = tokens.filter("not held_out").count()
    counts[end_id] += ends
    words = Vocabulary(counts)
    pairs = _pair_counts(tokens, width, words, end_id)
    model = _fitted(tokens, width, words, pairs, end_id)
    answers = _word_counts(tokens, width, path)
    sums = answers.filter("block = -1").agg(F.sum("total"), F.sum("different")).first()
    total, different = (sums[0] or 0) + ends, (sums[1] or 0) + (ends > 0)
    scored = _scored(tokens, answers, width, path, model, total, different, ends)
    return scored.withColumnRenamed("id", id_col)
