"""Byte-level BPE ids of whole texts, with each distinct chunk between single spaces encoded once."""

from __future__ import annotations

import os
from functools import lru_cache
from itertools import chain

import numpy as np

from comarca.llm.common import slices

# Distinct chunks a task remembers; beyond that it starts afresh.
CACHE_CHUNKS = 1_600_000
SLICE_CHARS = 2_000_000
JOINED = 400


class _Numbers(dict):
    """Numbers its keys in the order in which they are first asked for, and lists those not yet learnt."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        number = self[key] = len(self)
        self.new.append(key)
        return number


class ChunkEncoder:
    """Encodes texts as the tokenizers library does, which splits words apart before merging.

    No pre-token reaches across a single space that follows a non-space, so a text falls
    into chunks there, each with its space in front. Chunks not seen before are encoded by the
    library joined to longer texts; only a chunk's first id begins with the space, which tells them
    apart. Texts with white space before such a space go through the library whole.
    """

    def __init__(self, path: str, literal: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = literal
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.spaced = np.zeros(size, bool)
        for piece, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.spaced[i] = piece.startswith("Ġ")
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.special = [] if literal else [t.content for t in added]
        self._forget()

    def _forget(self) -> None:
        self.chunks = _Numbers()
        self.ids = np.zeros(1 << 16, self.dtype)
        self.starts, self.sizes = np.zeros(1, np.int64), np.zeros(0, np.int64)
        self.unsplit = np.zeros(0, bool)

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, self.dtype).tobytes() for e in found]

    def _learn(self) -> None:
        """Appends the ids of new chunks to one long row of ids."""
        new, self.chunks.new = self.chunks.new, []
        odd = np.array([not p or p[-1].isspace() for p in new], bool)  # no place to split after these
        pieces = ["" if o else p for o, p in zip(odd, new)] if odd.any() else new
        rows, sizes = [], []
        runs = [pieces[at : at + JOINED] for at in range(0, len(pieces), JOINED)]
        for run, raw in zip(runs, self._whole([" " + " ".join(run) for run in runs])):
            ids = np.frombuffer(raw, self.dtype)
            starts = np.flatnonzero(self.spaced[ids])
            if len(starts) == len(run) and "" not in run:
                sizes.append(np.diff(starts, append=len(ids)))
            else:  # a piece that the library ties to its neighbour
                each = self._whole([" " + p for p in run])
                ids = np.frombuffer(b"".join(each), self.dtype)
                sizes.append(np.array([len(e) // self.dtype.itemsize for e in each]))
            rows.append(ids)
        fresh, old = np.concatenate(sizes), int(self.starts[-1])
        ends = old + np.cumsum(fresh)
        if ends[-1] > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros(int(ends[-1]), self.dtype)))
        self.ids[old : ends[-1]] = np.concatenate(rows)
        self.starts, self.sizes = np.concatenate((self.starts, ends)), np.concatenate((self.sizes, fresh))
        self.unsplit = np.concatenate((self.unsplit, odd))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids as little-endian integers of ``dtype``, for each text."""
        return [ids for run in slices(texts, SLICE_CHARS) for ids in self._encode(run)]

    def _encode(self, texts: list[str]) -> list[bytes]:
        if len(self.chunks) > CACHE_CHUNKS:
            self._forget()
        split = [text.split(" ") for text in texts]
        heads = [p.pop(0) for p in split]
        counts = np.fromiter(map(len, split), np.int64, len(split))
        chunks = np.fromiter(map(self.chunks.__getitem__, chain.from_iterable(split)), np.int64, int(counts.sum()))
        if self.chunks.new:
            self._learn()
        sizes = self.sizes[chunks]
        ends = np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes)))
        ids = self.ids[np.arange(ends[-1]) + np.repeat(self.starts[chunks] - ends[:-1], sizes)]
        last = np.cumsum(counts)
        cuts = ends[np.concatenate((np.zeros(1, np.int64), last))].tolist()
        out = [h + ids[a:b].tobytes() for h, a, b in zip(self._whole(heads), cuts, cuts[1:])]
        whole = {i for i, h in enumerate(heads) if h[-1:].isspace()}
        whole |= {i for i, text in enumerate(texts) if any(s in text for s in self.special)}
        whole |= set(np.searchsorted(last, np.flatnonzero(self.unsplit[chunks]), "right").tolist())
        for i, found in zip(sorted(whole), self._whole([texts[i] for i in sorted(whole)])):
            out[i] = found
        return out


@lru_cache(2)
def chunk_encoder(path: str, literal: bool = False) -> ChunkEncoder:
    """``literal``: the strings of special tokens are ordinary text."""
    return ChunkEncoder(path, literal)
