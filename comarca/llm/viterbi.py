"""SentencePiece ids by a Viterbi search over batches of equally long words, and back to text."""

from __future__ import annotations

import zlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from comarca.llm.common import slices
from comarca.llm.shingles import mix

SPACE = "▁"
# Stands for the mark itself where a text has it; no piece holds a lone surrogate.
LITERAL = "\udfff"
# What an unknown character costs below the worst piece.
UNKNOWN_PENALTY = 10.0
CACHE_WORDS = 400_000
SLICE_CHARS = 2_000_000
GRID_CELLS = 1 << 20
# A longer word, as a text without spaces is, has no others of its length to advance with; its places are looked up together.
LONG_WORD = 256
PLACES = 1 << 16

_BASE = np.uint64(0x9E3779B97F4A7C15)


def zipf_scores(ranks: dict[int, float], size: int) -> dict[int, float]:
    """Log-probabilities that fall with the rank, which stands below zero, from 0 on."""
    total = float(np.log((1.0 / np.arange(1, size + 1)).sum()))
    return {i: -float(np.log(1.0 + min(-r, size - 1))) - total for i, r in ranks.items()}


class PieceModel:
    """The pieces of a SentencePiece model with their scores: the best segmentation has the highest sum.

    The text gets a mark in front and marks for its spaces. A piece has marks at its start
    only, so a text falls into words, each a run of marks and what follows it. A character
    that no piece covers becomes its UTF-8 bytes, or the unknown id if there are no byte pieces.

    A unigram model has log-probabilities as scores. A merge model has the rank of the merge
    below zero instead, of which sums mean nothing: with ``ranked`` the log-probability of the
    rank under Zipf's law takes its place. Pieces without a rank count as the last.
    """

    def __init__(self, path: str, ranked: bool):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.unknown = model.unk_id()
        self.bytes: dict[int, int] = {}
        self.out: list[bytes] = [b""] * size
        pieces: dict[str, int] = {}
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(piece[3:-1], 16)] = i
                self.out[i] = bytes([int(piece[3:-1], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                if SPACE in piece.lstrip(SPACE):
                    raise ValueError(f"a piece with a space inside: {piece!r}")
                pieces[piece] = i
                self.out[i] = piece.replace(SPACE, " ").encode()
        scores = {i: float(model.get_score(i)) for i in pieces.values()}
        if ranked:
            scores = zipf_scores(scores, size)
        self.unknown_score = min(scores.values(), default=0.0) - UNKNOWN_PENALTY
        by_length: dict[int, list[str]] = {}
        for piece in pieces:
            by_length.setdefault(len(piece), []).append(piece)
        self.longest = max(by_length, default=1)
        self.keys, self.ids, self.scores = {}, {}, {}
        for length, group in by_length.items():
            keys = self._prefix_hashes(group)[-1]
            order = np.argsort(keys)
            if len(np.unique(keys)) < len(keys):
                raise ValueError("two pieces with one key")
            self.keys[length] = keys[order]
            self.ids[length] = np.array([pieces[p] for p in group], np.int64)[order]
            self.scores[length] = np.array([scores[pieces[p]] for p in group])[order]
        self.powers = np.multiply.accumulate(np.r_[np.ones(1, np.uint64), np.full(self.longest, _BASE)])
        # All pieces' bytes in a row, to be gathered by id.
        self.sizes = np.array([len(b) for b in self.out])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.raw = np.frombuffer(b"".join(self.out) or b" ", np.uint8)
        self.words: dict[str, bytes] = {}

    def _prefix_hashes(self, words: list[str]) -> np.ndarray:
        """Row i has the hash of the first i characters, for words of one length."""
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = mix(codes.reshape(len(words), -1).T.astype(np.uint64) + np.uint64(1))
        hashes = np.zeros((len(codes) + 1, len(words)), np.uint64)
        for i, row in enumerate(codes):
            hashes[i + 1] = hashes[i] * _BASE + row
        return hashes

    def segment(self, words: list[str]) -> list[bytes]:
        """Ids of words that all have the same number of characters.

        Ends advance from left to right for all words at once. For each length of a piece,
        longest first, the hash of the substring before the end is looked up among the pieces;
        the first best sum stays. 64-bit hashes decide equality.
        """
        n, length = len(words), len(words[0])
        hashes = self._prefix_hashes(words)
        best = np.full((length + 1, n), -np.inf)
        best[0] = 0.0
        taken = np.full((length + 1, n), -1, np.int64)
        back = np.ones((length + 1, n), np.int32)
        for end in range(1, length + 1):
            top = best[end]
            for size in range(min(end, self.longest), 0, -1):
                before = best[end - size]
                if size in self.keys:
                    keys = self.keys[size]
                    key = hashes[end] - hashes[end - size] * self.powers[size]
                    at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                    hit = np.flatnonzero(keys[at] == key)
                    score = before[hit] + self.scores[size][at[hit]]
                    better = score > top[hit]
                    hit, score = hit[better], score[better]
                    top[hit] = score
                    taken[end, hit] = self.ids[size][at[hit]]
                    back[end, hit] = size
            none = np.flatnonzero(best[end - 1] + self.unknown_score > top)
            top[none] = best[end - 1][none] + self.unknown_score
            taken[end, none] = -1
            back[end, none] = 1
        steps, ends, lanes = [], np.full(n, length), np.arange(n)
        while (ends > 0).any():
            on = ends > 0
            ids = taken[ends, lanes]
            steps.append(np.where(on, np.where(ids < 0, -1 - ends, ids), -length - 9))
            ends = np.where(on, ends - back[ends, lanes], 0)
        grid = np.array(steps[::-1]).T
        real = grid > -length - 9
        flat, cuts = grid[real], np.r_[0, np.cumsum(real.sum(1))].tolist()
        raw, width = np.maximum(flat, 0).astype(self.dtype).tobytes(), self.dtype.itemsize
        out = [raw[a * width : b * width] for a, b in zip(cuts, cuts[1:])]
        for i in np.flatnonzero(((grid < 0) & real).any(1)):
            out[i] = self._with_bytes(words[i], flat[cuts[i] : cuts[i + 1]].tolist())
        return out

    def segment_long(self, word: str) -> bytes:
        """Ids of one word, the same as ``segment`` finds, in time and memory in proportion to its length.

        The substrings before ``PLACES`` ends at a time are looked up together, one length of a piece
        after the other; then only the hits take part in the maxima, end by end, with the same sums in the same order.
        """
        n = len(word)
        codes = mix(np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1))
        best, taken, back = [0.0] * (n + 1), np.full(n + 1, -1, np.int64), np.ones(n + 1, np.int32)
        for low in range(1, n + 1, PLACES):
            high = min(low + PLACES, n + 1)
            ends, sizes, ids, scores = ([], [], [], [])
            ahead = np.arange(low, high)
            hashes = np.zeros(len(ahead), np.uint64)
            for size in range(1, min(self.longest, high - 1) + 1):
                if ahead[0] < size:
                    ahead, hashes = ahead[1:], hashes[1:]
                hashes = hashes + codes[ahead - size] * self.powers[size - 1]
                if size in self.keys:
                    keys = self.keys[size]
                    at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
                    hit = np.flatnonzero(keys[at] == hashes)
                    ends.append(ahead[hit])
                    sizes.append(np.full(len(hit), size))
                    ids.append(self.ids[size][at[hit]])
                    scores.append(self.scores[size][at[hit]])
            if ends:
                ends, sizes, ids, scores = (np.concatenate(v) for v in (ends, sizes, ids, scores))
                order = np.lexsort((-sizes, ends))
                ends, sizes, ids, scores = (v[order] for v in (ends, sizes, ids, scores))
            cuts = np.searchsorted(ends, np.arange(low, high + 1)).tolist()
            size_of, score_of, chosen = list(map(int, sizes)), list(map(float, scores)), np.full(high - low, -1)
            for end in range(low, high):
                top, which = -np.inf, -1
                for i in range(cuts[end - low], cuts[end - low + 1]):
                    score = best[end - size_of[i]] + score_of[i]
                    if score > top:
                        top, which = score, i
                if best[end - 1] + self.unknown_score > top:
                    top, which = best[end - 1] + self.unknown_score, -1
                best[end] = top
                chosen[end - low] = which
            some = np.flatnonzero(chosen >= 0)
            if len(some):
                taken[low + some], back[low + some] = ids[chosen[some]], sizes[chosen[some]]
        steps, end = [], n
        while end:
            steps.append(int(taken[end]) if taken[end] >= 0 else -1 - end)
            end -= int(back[end])
        return self._with_bytes(word, steps[::-1])

    def _with_bytes(self, word: str, steps: list[int]) -> bytes:
        ids: list[int] = []
        for s in steps:
            if s >= 0:
                ids.append(s)
            else:
                c = word[-2 - s]
                raw = (SPACE if c == LITERAL else " " if c == SPACE else c).encode()
                ids += [self.bytes.get(b, self.unknown) for b in raw] if self.bytes else [self.unknown]
        return np.array(ids, self.dtype).tobytes()

    @staticmethod
    def split(text: str) -> list[str]:
        """The text's words but for the mark that each has in front."""
        pieces = text.replace(SPACE, LITERAL).split(" ") if text else []
        if "" in pieces[:-1]:  # a run of spaces belongs to what follows it
            joined, marks = [], ""
            for p in pieces[:-1]:
                joined += [marks + p] if p else []
                marks = "" if p else marks + SPACE
            pieces = [*joined, marks + pieces[-1]]
        return pieces

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian integers of ``dtype``."""
        out = []
        for run in slices(texts, SLICE_CHARS):
            if len(self.words) > CACHE_WORDS:
                self.words.clear()
            split = [self.split(t) for t in run]
            self._learn(set(chain.from_iterable(split)) - self.words.keys())
            get = self.words.__getitem__
            out += [b"".join(map(get, words)) for words in split]
        return out

    def _learn(self, words: set[str]) -> None:
        by_length: dict[int, list[str]] = {}
        for word in words:
            by_length.setdefault(len(word) + 1, []).append(word)
        for length, group in by_length.items():
            if length > LONG_WORD:
                self.words.update((w, self.segment_long(SPACE + w)) for w in group)
                continue
            lanes = GRID_CELLS // length
            for at in range(0, len(group), lanes):
                run = group[at : at + lanes]
                self.words.update(zip(run, self.segment([SPACE + w for w in run])))

    def decode(self, ids: np.ndarray) -> str:
        """The text of the ids: their bytes in a row, without the space that was put in front."""
        if not len(ids):
            return ""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1]) + np.repeat(self.starts[ids] - (ends - sizes), sizes)
        return self.raw[at][1:].tobytes().decode("utf-8", "replace")


@lru_cache(2)
def piece_model(path: str, ranked: bool) -> PieceModel:
    return PieceModel(path, ranked)


def sentencepiece_ids(
    docs: DataFrame, path: str, ranked: bool = True, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Encodes every whole text and decodes the ids again.

    Returns all columns of ``docs`` but the text, and tokens (array of ids), n_tokens, and, made from
    the decoded text, decoded_crc32 (UTF-8) and round_trip (whether it is the text itself).

    - Null and empty texts have no token, checksum 0 and a round trip.
    - Texts of any length and words of any length are encoded whole; ties go to the longer last piece.
    - Repeated rows and null ids come back as they are. An empty table gives no rows. Columns of
      ``docs`` with one of the four names above are replaced.

    A map over the rows: nothing is shuffled. A word is searched once per task and slice.
    """

    names = ["tokens", "n_tokens", "decoded_crc32", "round_trip"]
    kinds = [T.ArrayType(T.IntegerType()), T.LongType(), T.LongType(), T.BooleanType()]
    kept = [c for c in docs.columns if c not in (text_col, *names)]
    read = docs.select(*kept, F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    schema = T.StructType([*(docs.schema[c] for c in kept), *map(T.StructField, names, kinds)])

    def encoded(batches):
        model = piece_model(path, ranked)
        for batch in batches:
            texts, at = batch.column("_text").to_pylist(), 0
            for run in slices(texts, SLICE_CHARS):  # what goes out at once stays small
                ids = [np.frombuffer(raw, model.dtype) for raw in model.encode(run)]
                back = [model.decode(i) for i in ids]
                sizes = np.array([len(i) for i in ids])
                offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
                columns = [batch.column(c).slice(at, len(run)) for c in kept]
                columns += [
                    pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids).astype(np.int32))),
                    pa.array(sizes, pa.int64()),
                    pa.array([zlib.crc32(t.encode("utf-8", "surrogatepass")) for t in back], pa.int64()),
                    pa.array([t == u for t, u in zip(run, back)], pa.bool_()),
                ]
                yield pa.RecordBatch.from_arrays(columns, [*kept, *names])
                at += len(run)

    return read.mapInArrow(encoded, schema)
