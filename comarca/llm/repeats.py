"""Removal of long byte strings that occur more than once, by external suffix sorting of shards."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from comarca.llm.common import partitions, salted_join, slices, stored
from comarca.llm.shared import class_name, classes_of, shared_tokens, texts_of
from comarca.llm.shingles import mix
from comarca.llm.suffixes import sorted_suffixes

LENGTH = 200
# Bytes of an anchor; every string of the length has the anchor whose hash is its smallest.
ANCHOR = 32
# Bytes hashed together, so few that the arrays stay in the processor's cache.
SLICE_BYTES = 250_000
_BYTE = mix(np.arange(1, 257, dtype=np.uint64))
# An odd factor for each doubling of the hashed bytes, all different, so that every byte has a weight of its own.
_FACTORS = mix(np.arange(1, 1 + ANCHOR.bit_length() - 1, dtype=np.uint64)) | np.uint64(1)


def _digest(raw: bytes) -> tuple[int, int]:
    d = hashlib.md5(raw).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _signatures(docs: DataFrame) -> DataFrame:
    """(id, n, a, b, sha): bytes of the text, 128 bits that tell texts apart, and its SHA-256."""

    def sign(batches):
        for batch in batches:
            raws = [t.encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
            a, b = zip(*map(_digest, raws)) if raws else ((), ())
            columns = [pa.array(v, pa.int64()) for v in ([len(r) for r in raws], a, b)]
            columns.append(pa.array([hashlib.sha256(r).hexdigest() for r in raws], pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], ["id", "n", "a", "b", "sha"])

    return stored(docs.mapInArrow(sign, "id long, n long, a long, b long, sha string"))


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` values in a row."""
    n = len(values)
    padded = np.append(values, np.full(-n % width, ~np.uint64(0))).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, 1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def _anchor_runs(raws: list[bytes], length: int):
    """For each text, runs of windows that have one anchor: (anchor's place, its hash, first, last window).

    A window is ``length`` bytes; its anchor is the leftmost of the smallest hashes of the
    ``ANCHOR`` bytes from each place in it on, which depends on the window's bytes alone.
    """
    none = tuple(np.zeros(0, np.int64) for _ in range(4))
    sizes = np.array([len(r) for r in raws])
    raw = np.frombuffer(b"".join(raws), np.uint8)
    if len(raw) < length:
        yield from (none for _ in raws)
        return
    hashes = _BYTE[raw]
    for level, factor in enumerate(_FACTORS):
        hashes = hashes[: -(1 << level)] * factor + hashes[1 << level :]
    hashes = mix(hashes)
    place = np.arange(len(hashes), dtype=np.uint64)
    least = _sliding_min((hashes >> np.uint64(32) << np.uint64(32)) | place, length - ANCHOR + 1)
    where = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    ends = np.cumsum(sizes)
    for begin, size in zip((ends - sizes).tolist(), sizes.tolist()):
        if size < length:
            yield none
            continue
        at = where[begin : begin + size - length + 1]
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        last = np.append(first[1:], len(at)) - 1
        yield at[first] - begin, hashes[at[first]], first, last


def _repeated_anchors(docs: DataFrame, shift: int, length: int) -> DataFrame:
    def produce(batches):
        for batch in batches:
            raws = [t.encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
            for run in slices(raws, SLICE_BYTES):
                for raw, (at, hashes, _, _) in zip(run, _anchor_runs(run, length)):
                    if len(at):
                        yield class_name(*_digest(raw), shift), len(raw), hashes, at

    return shared_tokens(docs.select("text"), produce)


def _texts(docs: DataFrame, classes: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows (x, ...) with the text of each x."""
    named = stored(rows.join(classes.select("x", "rep", "a", "b").hint("merge"), "x"))
    return texts_of(docs, named, lambda texts: (_digest(t.encode("utf-8", "surrogatepass")) for t in texts))


def _snippets(texts: DataFrame, shift: int, length: int, shards: int) -> DataFrame:
    """(shard, token, snippet, lead, xs, starts): the bytes of each run of windows whose anchor is repeated.

    Equal snippets of a batch of texts are sent once, with all places they have. The anchor is ``lead``
    bytes into the snippet.
    """

    def cut(batches):
        for batch in batches:
            raws = [t.encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
            xs, lists, found, row = batch.column("x").to_pylist(), batch.column("at").to_pylist(), {}, 0
            for run in slices(raws, SLICE_BYTES):
                for raw, (at, hashes, first, last) in zip(run, _anchor_runs(run, length)):
                    x, repeated, row = xs[row], lists[row], row + 1
                    if class_name(*_digest(raw), shift) != x:  # another text under the same id
                        continue
                    keep = np.flatnonzero(np.isin(at, repeated))
                    tokens = (hashes[keep] & np.uint64((1 << 48) - 1)).tolist()
                    for token, p, a, b in zip(tokens, at[keep].tolist(), first[keep].tolist(), last[keep].tolist()):
                        places = found.setdefault((token, raw[a : b + length], p - a), ([], []))
                        places[0].append(x)
                        places[1].append(a)
            rows = [(t % shards, t, s, p, np.array(x, "<i8").tobytes(), np.array(a, "<i8").tobytes()) for (t, s, p), (x, a) in found.items()]
            if rows:
                kinds = [pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], _SNIPPET)

    return texts.mapInArrow(cut, "shard int, token long, snippet binary, lead int, xs binary, starts binary")


_SNIPPET = ["shard", "token", "snippet", "lead", "xs", "starts"]


def alike_snippets(snippets: list[tuple[bytes, int]], length: int = LENGTH) -> list[int]:
    """Which of several different (snippet, lead) of one anchor may have a window in common with another.

    All windows of a snippet have its anchor, at most once in the same place of a window. So a common window
    has the bytes that reach from the anchor over half of the rest of the window, to one side or the other.
    """
    half = (length - ANCHOR + 1) // 2
    seen: dict[tuple[bool, bytes], list[int]] = {}
    for i, (snippet, lead) in enumerate(snippets):
        if lead >= half:
            seen.setdefault((False, snippet[lead - half : lead + ANCHOR]), []).append(i)
        if lead + ANCHOR + half <= len(snippet):
            seen.setdefault((True, snippet[lead : lead + ANCHOR + half]), []).append(i)
    return sorted({i for some in seen.values() if len(some) > 1 for i in some})


def repeated_windows(snippets: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each of several different texts, which windows of ``length`` bytes also start somewhere else.

    The texts are sorted as one, with a symbol between them that no byte has: windows that
    have a twin stand next to it or to another of its twins.
    """
    sizes = np.array([len(s) for s in snippets])
    raw = np.frombuffer(b"\0".join(snippets) + b"\0", np.uint8)
    symbols = np.zeros(len(raw) + 1, np.uint16)
    symbols[:-1] = raw.astype(np.uint16) + 2
    ends = np.cumsum(sizes + 1)
    symbols[ends - 1] = 1
    twin = np.zeros(len(symbols), bool)
    for positions, prefixes in sorted_suffixes(symbols, length):
        same = np.flatnonzero(prefixes >= length)
        twin[positions[same]] = True
        twin[positions[same - 1]] = True
    return [twin[e - 1 - n : e - length] for n, e in zip(sizes.tolist(), ends.tolist())]


def _spans(snippets: DataFrame, length: int) -> DataFrame:
    """(x, begin, end): stretches of the texts that repeated windows cover, a shard at a time.

    Windows with equal bytes have the same anchor, so an anchor whose snippets are all equal
    needs no sorting: they repeat each other if they have two places. Of an anchor's different snippets
    those are sorted that agree with another one beside the anchor.
    """

    def sort(batches):
        shard, held = None, {}
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in _SNIPPET)):
                if row[0] != shard and held:
                    yield solve(held)
                    held = {}
                shard = row[0]
                places = held.setdefault(row[1], {}).setdefault(row[2:4], set())
                places.update(zip(np.frombuffer(row[4], "<i8").tolist(), np.frombuffer(row[5], "<i8").tolist()))
        if held:
            yield solve(held)

    def solve(held):
        out, open_ = [], []
        for group in held.values():
            for (snippet, _), places in group.items():
                if len(places) > 1:
                    out += [(x, a, a + len(snippet)) for x, a in places]
            if len(group) > 1:
                some = list(group.items())
                open_ += [(some[i][0][0], some[i][1]) for i in alike_snippets(list(group), length)]
        if open_:
            for (_, places), twin in zip(open_, repeated_windows([s for s, _ in open_], length)):
                if len(places) > 1 or not twin.any():
                    continue
                edges = np.diff(twin.astype(np.int8), prepend=0, append=0)
                for x, a in places:
                    out += [(x, a + i, a + j - 1 + length) for i, j in zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist())]
        columns = [pa.array(c, pa.int64()) for c in zip(*out)] if out else [pa.array([], pa.int64())] * 3
        return pa.RecordBatch.from_arrays(columns, ["x", "begin", "end"])

    dealt = snippets.repartition(partitions(snippets.sparkSession), "shard").sortWithinPartitions("shard")
    return stored(dealt.mapInArrow(sort, "x long, begin long, end long"))


def _removed(texts: DataFrame, shift: int) -> DataFrame:
    """(x, n_removed, n_spans, kept_sha256) of texts with the spans to take out, overlapping or not."""

    def remove(batches):
        for batch in batches:
            rows = []
            for x, text, spans in zip(*(batch.column(c).to_pylist() for c in ("x", "text", "spans"))):
                raw = text.encode("utf-8", "surrogatepass")
                if class_name(*_digest(raw), shift) != x:
                    continue
                kept, at, gone, n = hashlib.sha256(), 0, 0, 0
                for span in sorted((s["begin"], s["end"]) for s in spans):
                    if span[0] > at or n == 0:
                        kept.update(raw[at : span[0]])
                        n += 1
                        at = max(at, span[0])
                    gone += max(0, span[1] - at)
                    at = max(at, span[1])
                kept.update(raw[at:])
                rows.append((x, gone, n, kept.hexdigest()))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 4, kinds)]
            yield pa.RecordBatch.from_arrays(columns, ["x", "n_removed", "n_spans", "kept_sha256"])

    return texts.mapInArrow(remove, "x long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What is left of every text when all bytes go that a repeated string of ``length`` bytes covers.

    Returns a row per document: id, n_bytes, n_removed, n_spans (maximal removed runs) and
    kept_sha256 of the rest. A string is repeated if it starts anywhere else, in the same or another
    document, overlaps included, as the texts were before anything was removed.

    - Null and empty texts have no byte. Texts shorter than ``length`` keep all. Equal texts remove
      each other whole.
    - Repeated rows of one id count as copies. Texts with a null id count like all others.
    - Texts of any length are read whole. Other columns may have any name. An empty table gives no rows.

    Equal texts are one class. Of each class the windows whose anchor occurs elsewhere
    are cut out and dealt to shards by the anchor, where equal windows must meet; a shard is
    sorted as one text by external induced sorting. Whatever the number of copies, equal
    snippets are sorted once.
    """
    if not ANCHOR <= length <= 255:
        raise ValueError(f"a length of {ANCHOR} to 255")
    docs = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    slim = _signatures(docs)
    classes, shift = classes_of(slim)
    classes = stored(classes)
    anchors = _repeated_anchors(docs, shift, length)
    wanted = anchors.groupBy("x").agg(F.collect_set("pos").alias("at"))
    shards = 4 * partitions(docs.sparkSession)
    spans = _spans(_snippets(_texts(docs, classes, wanted), shift, length, shards), length)
    single = classes.filter("copies = 1").select("x")
    listed = spans.join(single, "x", "left_semi").groupBy("x").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
    removed = stored(_removed(_texts(docs, classes, listed), shift).dropDuplicates(["x"]))
    named = classes.select("a", "b", "x", "copies").join(removed, "x", "left")
    result = salted_join(slim.filter("n > 0"), named, ["a", "b"], "copies", slim.count(), "id")
    whole = (F.col("copies") > 1) & (F.col("n") >= length)
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    cut = result.select(
        "id",
        F.col("n").alias("n_bytes"),
        F.when(whole, F.col("n")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, nothing).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )
    empty = slim.filter("n = 0").select("id", F.col("n"), F.lit(0).cast("long"), F.lit(0).cast("long"), "sha")
    return cut.union(empty).withColumnRenamed("id", id_col)
