"""Two tokenizers' tokens of the same bytes, linked by products of sparse incidence matrices."""

from __future__ import annotations

import hashlib
import os
import re
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from comarca.llm.blocks import fresh_blocks
from comarca.llm.common import release_memory, slices, stored

# What a task remembers of distinct chunks, in bytes; beyond that it goes on with those it met most often, so many bytes of them.
CACHE_BYTES, KEPT_BYTES = 80_000_000, 56_000_000
# Of a chunk, besides its characters, its groups and its links.
CHUNK_BYTES = 300
# Texts of a block; their links go from the first pass to the second as one row.
BLOCK_BYTES = 1_500_000
# New chunks are aligned side by side, so many characters at a time.
LEARNT = 120_000
# Products are made for so many entries at a time.
SLICE = 1 << 18

# A space between two other characters; neither tokenizer has a token that reaches across its left side.
_BREAK = re.compile(r" (?=\S)(?<=\S )")
_MARK = "▁"


class Csr:
    """A sparse matrix of counts, row by row: ``columns[start[i]:start[i + 1]]`` are those of row i, ascending."""

    def __init__(self, start: np.ndarray, columns: np.ndarray, values: np.ndarray, width: int):
        self.start, self.columns, self.values, self.width = start, columns, values, width

    @classmethod
    def of_rows(cls, rows: np.ndarray, columns: np.ndarray, height: int, width: int) -> Csr:
        """From the places of its entries, sorted by row and column, each once."""
        start = np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=height))))
        return cls(start, columns, np.ones(len(columns), np.int64), width)

    def transposed(self) -> Csr:
        rows = np.repeat(np.arange(len(self.start) - 1), np.diff(self.start))
        order = np.argsort(self.columns, kind="stable")
        start = np.concatenate(([0], np.cumsum(np.bincount(self.columns, minlength=self.width))))
        return Csr(start, rows[order], self.values[order], len(self.start) - 1)


def product(a: Csr, b: Csr):
    """Yields (rows, columns, values) of a times b, a run of rows at a time.

    Gustavson's way: row i of the product is the sum of the rows k of ``b`` for which a[i, k] is
    set, each times a[i, k]. All rows of a run are summed together.
    """
    reach = np.diff(b.start)[a.columns]  # entries of b's row, for each entry of a
    upto = np.concatenate(([0], np.cumsum(reach)))
    work, i, height = upto[a.start], 0, len(a.start) - 1
    while i < height:
        j = max(i + 1, int(np.searchsorted(work, work[i] + SLICE, "right")) - 1)
        entries = slice(a.start[i], a.start[j])
        many = reach[entries]
        rows = np.repeat(np.repeat(np.arange(i, j), np.diff(a.start[i : j + 1])), many)
        first = upto[entries] - upto[a.start[i]]
        at = np.repeat(b.start[a.columns[entries]] - first, many) + np.arange(int(many.sum()))
        keys = rows * b.width + b.columns[at]
        terms = np.repeat(a.values[entries], many) * b.values[at]
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        if len(keys):
            new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            yield keys[new] // b.width, keys[new] % b.width, np.add.reduceat(terms[order], new)
        i = j


class Tokens:
    """Tokens side by side: ids, where each one's bytes begin and end, and where each text's tokens begin."""

    def __init__(self, ids: np.ndarray, firsts: np.ndarray, lengths: np.ndarray):
        self.ids, self.firsts = ids, firsts
        self.ends = np.cumsum(lengths)
        self.begins = self.ends - lengths

    def on_bytes(self) -> Csr:
        """The incidence matrix of tokens and bytes."""
        size = int(self.ends[-1]) if len(self.ends) else 0
        lengths = self.ends - self.begins
        return Csr(np.append(self.begins, size), np.arange(size), np.ones(int(lengths.sum()), np.int64), size)

    def on_groups(self, cuts: np.ndarray) -> Csr:
        """The incidence matrix of tokens and groups, given the ends of the groups."""
        return Csr.of_rows(np.arange(len(self.ids)), np.searchsorted(cuts, self.ends), len(self.ids), len(cuts))


class Alignment:
    """Groups and links of two tokenizers' tokens of the same texts.

    Byte offsets where a token of both ends cut them into groups. ``overlaps`` and ``shared`` are the
    products of the incidence matrices: (A token, B token, common bytes) and (A token, B token).
    """

    def __init__(self, a: Tokens, b: Tokens):
        self.a, self.b = a, b
        self.cuts = np.intersect1d(a.ends, b.ends, assume_unique=True)
        self.a_group, self.b_group = np.searchsorted(self.cuts, a.ends), np.searchsorted(self.cuts, b.ends)

    def overlaps(self):
        return product(self.a.on_bytes(), self.b.on_bytes().transposed())

    def shared(self):
        return product(self.a.on_groups(self.cuts), self.b.on_groups(self.cuts).transposed())


class Pair:
    """The two tokenizers, the bytes of their ids, and what is known of chunks already met."""

    def __init__(self, byte_path: str, piece_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.byte_level = Tokenizer.from_file(byte_path)
        self.byte_level.encode_special_tokens = True
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        byte_of = {c: b for b, c in enumerate(_byte_letters())}
        vocabulary = self.byte_level.get_vocab(with_added_tokens=True)
        names = [""] * (max(vocabulary.values()) + 1)
        for piece, i in vocabulary.items():
            names[i] = piece
        self.a_bytes = _Bytes([bytes(byte_of[c] for c in n) if all(c in byte_of for c in n) else n.encode() for n in names])
        self.b_bytes = _Bytes([self._piece_bytes(i) for i in range(self.pieces.get_piece_size())])
        named = [self.pieces.id_to_piece(i) for i in range(self.pieces.get_piece_size())]
        # A piece with a mark after another character would reach across a break.
        self.breaks = not any(_MARK in p.lstrip(_MARK) for p in named)
        self.forget()

    def _piece_bytes(self, i: int) -> bytes:
        piece = self.pieces.id_to_piece(i)
        if self.pieces.is_byte(i):
            return bytes([int(piece[3:5], 16)])
        return piece.replace(_MARK, " ").encode("utf-8", "surrogatepass")

    def forget(self) -> None:
        self.number = _Numbers()
        self.groups: list[bytes] = []
        self.fine = np.zeros(0, bool)
        self.sums = np.zeros((0, 5), np.int64)  # per chunk: A tokens, B tokens, groups, overlaps, shared pairs
        self.link_sizes = np.zeros(0, np.int64)
        self.links = np.zeros(0, np.int64)  # A id << 32 | B id, chunk after chunk
        self.bytes = np.zeros(0, np.int64)  # per chunk: what it takes to remember it
        self.met = np.zeros(0, np.int64)  # and how often it came, half as much with every time that room was made

    def make_room(self) -> None:
        """Forgets the chunks met least often if all of them take more than they may. Numbers change."""
        if self.bytes.sum() <= CACHE_BYTES:
            return
        often = np.argsort(-self.met, kind="stable")
        kept = np.sort(often[: np.searchsorted(np.cumsum(self.bytes[often]), KEPT_BYTES, "right")])
        at = _runs(self.link_sizes, kept)
        chunks = list(self.number)
        self.number = _Numbers((chunks[n], i) for i, n in enumerate(kept.tolist()))
        self.groups = [self.groups[n] for n in kept.tolist()]
        self.fine, self.sums, self.links, self.link_sizes = self.fine[kept], self.sums[kept], self.links[at], self.link_sizes[kept]
        self.bytes, self.met = self.bytes[kept], self.met[kept] // 2

    def chunks(self, text: str) -> list[str]:
        """The text cut where a token of both must end; each chunk has a space in front of it."""
        if not self.breaks:
            return [text] if text else []
        parts = text.split()
        if " ".join(parts) == text:
            return parts
        return _BREAK.split(text) if text else []

    def numbers(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The chunks of all texts by number, and how many each text has. A mark in a text is no space: -1, no chunks."""
        known, out, sizes = self.number, [], []
        before = len(known)
        for text in texts:
            if _MARK in text:
                sizes.append(-1)
                continue
            parts = self.chunks(text)
            sizes.append(len(parts))
            out += map(known.__getitem__, parts)
        found = [self._learn(run) for run in slices(islice(known, before, None), LEARNT)]
        for groups, _ in found:
            self.groups += groups
        held = (self.fine, self.sums, self.link_sizes, self.links, self.bytes, self.met)
        self.fine, self.sums, self.link_sizes, self.links, self.bytes, self.met = map(np.concatenate, zip(held, *(f for _, f in found)))
        out = np.array(out, np.int64)
        self.met += np.bincount(out, minlength=len(self.met))
        return out, np.array(sizes, np.int64)

    def _learn(self, chunks: list[str]) -> tuple[list[bytes], tuple[np.ndarray, ...]]:
        """The groups of new chunks, and what else is held of each."""
        raw = [b" " + c.encode("utf-8", "surrogatepass") for c in chunks]
        a = [e.ids for e in self.byte_level.encode_batch_fast([" " + c for c in chunks], add_special_tokens=False)]
        b = self.pieces.encode(chunks, num_threads=1)
        fine = np.array([x == y == z for x, y, z in zip(raw, self.a_bytes.joined(a), self.b_bytes.joined(b))], bool)
        for i in np.flatnonzero(~fine).tolist():
            a[i], b[i] = [], []
        found = Alignment(self._tokens(a, self.a_bytes), self._tokens(b, self.b_bytes))
        n, a_of, b_of = len(chunks), _owner(a), _owner(b)
        overlaps, shared, links, owners = np.zeros(n, np.int64), np.zeros(n, np.int64), [], []
        for x, y, _ in found.overlaps():
            overlaps += np.bincount(a_of[x], minlength=n)
            together = found.a.ends[x] == found.b.ends[y]  # their byte ranges end together
            x, y = x[together], y[together]
            links.append((found.a.ids[x] << 32) | found.b.ids[y])
            owners.append(a_of[x])
        for x, _, _ in found.shared():
            shared += np.bincount(a_of[x], minlength=n)
        link_owner = np.concatenate(owners) if owners else np.zeros(0, np.int64)
        group_owner = a_of[np.searchsorted(found.a.ends, found.cuts)]
        sums = [np.fromiter(map(len, a), np.int64, n), np.fromiter(map(len, b), np.int64, n)]
        sums += [np.bincount(group_owner, minlength=n), overlaps, shared]
        sizes, groups = np.bincount(link_owner, minlength=n), _written(found, group_owner, n)
        taken = CHUNK_BYTES + 8 * sizes + np.fromiter(map(len, raw), np.int64, n) + np.fromiter(map(len, groups), np.int64, n)
        links = np.concatenate(links) if links else np.zeros(0, np.int64)
        return groups, (fine, np.stack(sums, 1), sizes, links, taken, np.zeros(n, np.int64))

    @staticmethod
    def _tokens(rows: list[list[int]], table: _Bytes) -> Tokens:
        ids = np.fromiter(chain.from_iterable(rows), np.int64)
        firsts = np.cumsum([0, *map(len, rows)])[:-1]
        return Tokens(ids, firsts, table.lengths[ids])


class _Numbers(dict):
    """Chunks by number; one that is looked up and not there gets the next."""

    def __missing__(self, chunk: str) -> int:
        n = self[chunk] = len(self)
        return n


class _Bytes:
    """The bytes of every id."""

    def __init__(self, of_id: list[bytes]):
        self.of_id = of_id
        self.lengths = np.array([len(b) for b in of_id], np.int64)

    def joined(self, rows: list[list[int]]) -> list[bytes]:
        return [b"".join(map(self.of_id.__getitem__, ids)) for ids in rows]


def _byte_letters() -> list[str]:
    """The character that a byte-level vocabulary writes for each byte: itself where it shows, else one from 256 on."""
    shown = [0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b for b in range(256)]
    return [chr(b) if ok else chr(256 + b - sum(shown[:b])) for b, ok in enumerate(shown)]


def _owner(rows: list[list[int]]) -> np.ndarray:
    return np.repeat(np.arange(len(rows)), [len(r) for r in rows])


def _written(found: Alignment, owner: np.ndarray, n: int) -> list[bytes]:
    """For every chunk ``a1,a2|b1;a3|b2``: its groups, with ids in order."""
    a, b = found.a.ids, found.b.ids
    i, j = (np.searchsorted(of, np.arange(len(found.cuts) + 1)) for of in (found.a_group, found.b_group))
    single = (np.diff(i) == 1) & (np.diff(j) == 1)
    groups = np.empty(len(single), object)
    pairs, which = np.unique((a[i[:-1][single]] << 32) | b[j[:-1][single]], return_inverse=True)
    groups[single] = np.array([f"{p >> 32}|{p & 0xFFFFFFFF}" for p in pairs.tolist()], object)[which]
    several = np.flatnonzero(~single)
    sides = []
    for ids, cuts in ((a, i), (b, j)):
        names = list(map(str, ids[_runs(np.diff(cuts), several)].tolist()))
        ends = np.cumsum([0, *np.diff(cuts)[several].tolist()]).tolist()
        sides.append([",".join(names[x:y]) for x, y in zip(ends, ends[1:])])
    groups[several] = [f"{x}|{y}" for x, y in zip(*sides)]
    groups = groups.tolist()
    cuts = np.searchsorted(owner, np.arange(n + 1)).tolist()
    return [(";".join(groups[i:j]) if j - i != 1 else groups[i]).encode() for i, j in zip(cuts, cuts[1:])]


def _runs(sizes: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The places of these runs' values, one run after another, among those of all runs of such sizes."""
    starts, many = (np.cumsum(sizes) - sizes)[which], sizes[which]
    return np.repeat(starts - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))


def _sums(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Sums of runs of rows."""
    upto = np.zeros((len(values) + 1, *values.shape[1:]), np.int64)
    np.cumsum(values, axis=0, out=upto[1:])
    return upto[cuts[1:]] - upto[cuts[:-1]]


@lru_cache(1)
def tokenizer_pair(byte_path: str, piece_path: str) -> Pair:
    return Pair(byte_path, piece_path)


_DOC = ["id", "n_a", "n_b", "n_groups", "n_links", "n_overlaps", "n_shared", "groups_sha256"]
_DOC_TYPE = pa.list_(pa.struct([("id", pa.int64()), *[(c, pa.int64()) for c in _DOC[1:7]], ("groups_sha256", pa.string())]))
_DOC_SCHEMA = "id: bigint, " + ", ".join(f"{c}: bigint" for c in _DOC[1:7]) + ", groups_sha256: string"


def _aligned(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """A row per block: its documents but for counts over all, the pairs of ids they link, and the links.

    ``docs`` (a list of structs), ``pairs`` with their number of links in the block, and ``links`` (indexes into
    ``pairs``, document after document, as many as its n_links; of two bytes where these do).
    """

    def align(batches):
        pair = tokenizer_pair(byte_path, piece_path)
        for block, ids, texts in fresh_blocks(batches, "id", "text", BLOCK_BYTES):
            pair.make_room()
            release_memory()
            numbers, sizes = pair.numbers(texts)
            owner = np.repeat(np.arange(len(texts)), np.maximum(sizes, 0))
            wrong = np.zeros(len(texts), bool)
            wrong[owner[~pair.fine[numbers]]] = True
            numbers = numbers[~wrong[owner]]
            sizes = np.where(wrong, 0, np.maximum(sizes, 0))
            cuts = np.concatenate(([0], np.cumsum(sizes)))
            sums = [_sums(pair.sums[numbers, i], cuts).tolist() for i in range(5)]
            n_links = _sums(pair.link_sizes[numbers], cuts).tolist()
            occurs = np.zeros(len(pair.link_sizes), bool)
            occurs[numbers] = True
            used = np.flatnonzero(occurs)
            pairs, index = np.unique(pair.links[_runs(pair.link_sizes, used)], return_inverse=True)
            index = index.astype(_width(len(pairs)))
            links = index[_runs(np.where(occurs, pair.link_sizes, 0), numbers)]
            n = np.bincount(links, minlength=len(pairs))
            shas, cuts, names = [], cuts.tolist(), pair.groups
            for a, b in zip(cuts, cuts[1:]):
                written = b";".join(map(names.__getitem__, numbers[a:b].tolist()))
                shas.append(hashlib.sha256(written).hexdigest() if b > a else "")
            rows = zip(ids, *sums[:3], n_links, *sums[3:], shas)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([block]),
                    pa.array([[dict(zip(_DOC, r)) for r in rows]], _DOC_TYPE),
                    pa.array([links.tobytes()]),
                    pa.array([[{"a": int(p >> 32), "b": int(p & 0xFFFFFFFF), "n": int(c)} for p, c in zip(pairs.tolist(), n.tolist())]],
                             pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64())]))),
                ],
                ["block", "docs", "links", "pairs"],
            )

    schema = f"block long, docs array<struct<{_DOC_SCHEMA}>>, links binary"
    return stored(docs.mapInArrow(align, f"{schema}, pairs array<struct<a: int, b: int, n: bigint>>"))


def _width(pairs: int) -> str:
    """The type of indexes into so many pairs."""
    return "<u2" if pairs <= 1 << 16 else "<u4"


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(a, b, count, best): how many links hold each pair of ids, and whether that is the most of its B id."""
    pairs = blocks.select(F.inline("pairs")).groupBy("a", "b").agg(F.sum("n").alias("count"))
    pairs = stored(pairs)
    top = pairs.groupBy("b").agg(F.max("count").alias("top"))
    return pairs.join(top, "b").select("a", "b", "count", (F.col("count") == F.col("top")).alias("best"))


def aligned_tokens(
    docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Aligns the tokens of a byte-level BPE (A, of a space and the text) with those of a piece model (B, of the text).

    Returns a row per input row: id, n_a and n_b (tokens), n_groups (runs between byte offsets where
    both end a token), n_links (pairs of tokens whose bytes end together), n_best (links whose pair of ids
    is the most frequent of its B id in all documents, ties included), count_sum (frequencies of the
    pairs, summed over links), groups_sha256 (of ``a1,a2|b1;a3|b2``, ids in order), n_overlaps (pairs of
    tokens with a byte in common) and n_shared (pairs of tokens in one group).

    - Null and empty texts, and texts whose pieces do not give the text back, have no tokens: zeros, '' as hash.
    - Strings of special tokens inside a text are ordinary text. Texts are read whole.
    - Repeated rows and null ids come back as they are and count as documents. Other columns may have any
      name. An empty table gives no rows.

    Tokens and bytes (and tokens and groups) make up incidence matrices; row products A times B
    transposed give the links. Both tokenizers end a token before a single space between words, so texts are
    cut there and each distinct chunk is aligned once as long as a task remembers it, many side by side in one
    product. A block of texts sums the links of each pair of ids; the counts of all documents come back to the
    block, a row for each pair it has.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    blocks = _aligned(rows, byte_path, piece_path)
    asked = blocks.select("block", F.inline("pairs"))
    known = asked.select("block", "a", "b").join(pair_counts(blocks).hint("merge"), ["a", "b"])
    known = known.groupBy("block").agg(F.collect_list(F.struct("a", "b", "count", "best")).alias("known"))

    def count(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                yield _counted({c: batch.column(c)[i] for c in batch.schema.names})

    columns = ["docs", "links", "known"]
    schema = "id long, " + ", ".join(f"{c} long" for c in _DOC[1:7]) + ", groups_sha256 string, n_best long, count_sum long"
    found = blocks.join(known.hint("merge"), "block", "left").select(*columns).mapInArrow(count, schema)
    kind = docs.schema[id_col].dataType
    order = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_overlaps", "n_shared"]
    return found.select(F.col("id").cast(kind).alias(id_col), *order)


def _counted(row: dict) -> pa.RecordBatch:
    """The documents of a block, with what all documents' links say about theirs."""
    docs = row["docs"].values
    cuts = np.concatenate(([0], np.cumsum(docs.field("n_links").to_numpy())))
    n_best = count_sum = np.zeros(len(docs), np.int64)
    if cuts[-1]:
        known = row["known"].values
        order = np.lexsort((known.field("b").to_numpy(), known.field("a").to_numpy()))  # as the block numbers its pairs
        count = known.field("count").to_numpy()[order]
        best = known.field("best").to_numpy(zero_copy_only=False)[order]
        links = np.frombuffer(row["links"].as_py(), _width(len(order)))
        n_best, count_sum = _sums(best[links], cuts), _sums(count[links], cuts)
    return pa.RecordBatch.from_arrays([*[docs.field(c) for c in _DOC], pa.array(n_best), pa.array(count_sum)], [*_DOC, "n_best", "count_sum"])
