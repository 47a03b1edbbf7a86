"""Induced suffix sorting with common prefixes, through queues that spill to disk."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

# Entries that queues hold in memory, and the length of a reduced text that is sorted there.
QUEUE_ENTRIES = 1 << 23
BASE_SYMBOLS = 1 << 23

Entries = tuple[np.ndarray, np.ndarray]  # positions, and common prefix with the entry before


class SymbolQueues:
    """A priority queue of suffix entries: the symbol is the priority, equal symbols leave as they came.

    Induction pushes the entries of each symbol in their final order, so a file per queue and
    blocks per symbol do for a heap. Beyond ``most`` entries all that is held goes to the file.
    """

    def __init__(self, most: int = QUEUE_ENTRIES):
        self.most, self.held, self.file = most, 0, None
        self.blocks: dict[int, list[tuple[int, int]]] = {}
        self.memory: dict[int, list[Entries]] = {}

    def push(self, symbol: int, positions: np.ndarray, prefixes: np.ndarray) -> None:
        self.memory.setdefault(symbol, []).append((positions, prefixes))
        self.held += len(positions)
        if self.held > self.most:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()  # has no name, so nothing can be left behind
        self.file.seek(0, 2)
        for symbol, parts in self.memory.items():
            positions, prefixes = map(np.concatenate, zip(*parts))
            self.blocks.setdefault(symbol, []).append((self.file.tell(), len(positions)))
            self.file.write(positions.tobytes() + prefixes.tobytes())
        self.memory, self.held = {}, 0

    def pop(self, symbol: int) -> Entries:
        """All entries of the symbol, in the order in which they were pushed."""
        parts = []
        for at, n in self.blocks.pop(symbol, ()):
            self.file.seek(at)
            parts.append((np.frombuffer(self.file.read(8 * n), np.int64), np.frombuffer(self.file.read(n), np.uint8)))
        fresh = self.memory.pop(symbol, [])
        self.held -= sum(len(p) for p, _ in fresh)
        parts += fresh
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.uint8)
        positions, prefixes = zip(*parts)
        return np.concatenate(positions), np.concatenate(prefixes)


class _Text:
    """Symbols with their types: an S suffix is smaller than the next one, an L suffix is larger."""

    def __init__(self, symbols: np.ndarray):
        self.symbols, n = symbols, len(symbols)
        change = np.flatnonzero(symbols[1:] != symbols[:-1])
        self.run_ends = np.append(change, n - 1)
        rising = np.append(symbols[change + 1] > symbols[change], True)
        self.small = np.repeat(rising, np.diff(self.run_ends, prepend=-1))
        self.lms = np.flatnonzero(self.small[1:] & ~self.small[:-1]) + 1

    def run_left(self, at: int) -> int:
        """Length of the run of one symbol that starts here."""
        return int(self.run_ends[np.searchsorted(self.run_ends, at)]) - at + 1


def _refined(rank: np.ndarray, members: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Splits groups of equal rank by the keys; a rank is the number of smaller elements. Members still tied come back."""
    old = rank[members]
    if not len(old) or old[0] == old.max() == old.min():
        order = np.argsort(keys)
    elif int(keys.min()) >= 0 and int(keys.max()) < 1 << 32 and int(old.max()) < 1 << 31:
        order = np.argsort(old << 32 | keys)
    else:
        order = np.lexsort((keys, old))
    members, keys, old = members[order], keys[order], old[order]
    group = np.flatnonzero(np.r_[True, old[1:] != old[:-1]])
    fresh = np.r_[True, (old[1:] != old[:-1]) | (keys[1:] != keys[:-1])]
    part = np.flatnonzero(fresh)
    sizes = np.diff(part, append=len(members))
    base = group[np.searchsorted(group, part, "right") - 1]
    rank[members] = old + np.repeat(part - base, sizes)
    return members[np.repeat(sizes, sizes) > 1]


def _packed(symbols: np.ndarray) -> tuple[np.ndarray, int]:
    """As many symbols from each position on as fit into 62 bits, and how many these are."""
    bits = max(1, int(symbols.max()).bit_length())
    per = min(max(1, 62 // bits), len(symbols))
    out = np.zeros(len(symbols), np.int64)
    for j in range(per):
        out <<= bits
        out[: len(symbols) - j] |= symbols[j:]
    return out, per


def _lms_ranks(text: _Text) -> np.ndarray:
    """Ranks of the LMS substrings, equal for equal ones."""
    lms = text.lms
    length = np.append(np.diff(lms) + 1, 1)
    symbols = text.symbols.astype(np.int64) * 2 + text.small
    bits = int(symbols.max()).bit_length()
    per = max(1, 62 // bits)
    rank, tied, offset = np.zeros(len(lms), np.int64), np.arange(len(lms)), 0
    while len(tied):
        keys = np.zeros(len(tied), np.int64)
        for j in range(offset, offset + per):
            inside = length[tied] > j
            keys = keys << bits | np.where(inside, symbols[np.minimum(lms[tied] + j, len(symbols) - 1)], 0)
        offset += per
        tied = _refined(rank, tied, keys)
        tied = tied[length[tied] > offset]
    return rank


def _doubled(names: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of a text in memory, by as many of their symbols at least."""
    n, reach = len(names), 1
    rank = np.zeros(n, np.int64)
    tied = _refined(rank, np.arange(n), names)
    while len(tied) and reach < depth:
        after = tied + reach
        tied = _refined(rank, tied, np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0))
        reach *= 2
    return np.argsort(rank, kind="stable")


def _sorted_lms(text: _Text, depth: int, base: int) -> np.ndarray:
    rank = _lms_ranks(text)
    names = np.unique(rank, return_inverse=True)[1]
    if len(names) == names.max() + 1:
        return text.lms[np.argsort(rank)]
    if len(names) <= base:
        return text.lms[_doubled(names, depth // 2 + 1)]  # an LMS substring moves on by two symbols at least
    largest_first = [positions for positions, _ in sorted_suffixes(names, depth // 2 + 1, base)]
    return text.lms[np.concatenate(largest_first[::-1])]


def _common(symbols: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Common prefix of pairs of suffixes, ``depth`` at most."""
    packed, per = _packed(symbols)
    out, on, n = np.zeros(len(a), np.int64), np.arange(len(a)), len(symbols)
    step = per
    while step:
        compared = packed if step == per else symbols
        going = on
        for d in range(0, depth, step) if step == per else range(per):
            x, y = a[going] + out[going], b[going] + out[going]
            ok = (x < n) & (y < n) & (out[going] < depth)
            same = ok & (compared[np.minimum(x, n - 1)] == compared[np.minimum(y, n - 1)])
            going = going[same]
            if not len(going):
                break
            out[going] += step
        step = 1 if step > 1 else 0
    return np.minimum(out, depth)


def _range_min(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Minima of values[low..high], ends included."""
    out = np.zeros(len(low), values.dtype)
    length, level, table = high - low + 1, 0, values
    longest = int(length.max()) if len(length) else 0
    while 1 << level <= longest:
        now = np.flatnonzero(length >> level == 1)
        out[now] = np.minimum(table[low[now]], table[high[now] - (1 << level) + 1])
        table = np.minimum(table[: -(1 << level) or None], table[1 << level :])
        level += 1
    return out


def _induce(text: _Text, queues: SymbolQueues, symbol: int, small: bool, rest, depth: int) -> tuple[Entries, Entries]:
    """One symbol's turn: its own entries by themselves, then with ``rest`` after them, induce others.

    ``rest(last)`` gives the entries that stand behind the last of its own. Returns both.
    """
    symbols, is_small = text.symbols, text.small
    parts: list[Entries] = []
    positions, prefixes = queues.pop(symbol)
    carry = 0
    while len(positions):
        parts.append((positions, prefixes))
        before = positions - 1
        picks = np.flatnonzero((positions > 0) & (is_small[before] == small) & (symbols[before] == symbol))
        if not len(picks):
            break
        starts = np.append(0, picks[:-1] + 1)
        least = np.minimum.reduceat(prefixes[: picks[-1] + 1], starts)
        least[0] = min(int(least[0]), carry)
        tail = prefixes[picks[-1] + 1 :]
        carry = int(tail.min()) if len(tail) else depth
        positions, prefixes = before[picks], np.minimum(least.astype(np.int64) + 1, depth).astype(np.uint8)
    own = (np.zeros(0, np.int64), np.zeros(0, np.uint8))
    if parts:
        own = tuple(map(np.concatenate, zip(*parts)))
    behind = rest(int(own[0][-1]) if len(own[0]) else None)
    positions, prefixes = (np.concatenate(p) for p in zip(own, behind))
    before = positions - 1
    picks = np.flatnonzero((positions > 0) & (is_small[before] == small) & (symbols[before] != symbol))
    targets = symbols[before[picks]]
    order = np.argsort(targets, kind="stable")
    picks, targets = picks[order], targets[order]
    if len(picks):
        cuts = np.flatnonzero(np.r_[True, targets[1:] != targets[:-1]])
        common = np.ones(len(picks), np.int64)
        follows = np.setdiff1d(np.arange(len(picks)), cuts, assume_unique=True)
        common[follows] += _range_min(prefixes, picks[follows - 1] + 1, picks[follows])
        common = np.minimum(common, depth).astype(np.uint8)
        found = before[picks]
        for a, b in zip(cuts.tolist(), np.append(cuts[1:], len(picks)).tolist()):
            queues.push(int(targets[a]), found[a:b], common[a:b])
    return own, behind


def sorted_suffixes(
    symbols: np.ndarray, depth: int, base: int = BASE_SYMBOLS, most: int = QUEUE_ENTRIES
) -> Iterator[Entries]:
    """Suffixes in order, symbol by symbol from the largest down, each symbol's in ascending order.

    Yields their positions and, for each but the first, its common prefix with the one before,
    counted to ``depth`` (255 at most). Suffixes equal to that depth may come in any order. The
    last symbol must be 0 and the only 0. The sorted LMS suffixes come from the reduced text of their
    names, by recursion while that is longer than ``base``.
    """
    text = _Text(symbols)
    if len(symbols) == 1:
        yield np.zeros(1, np.int64), np.zeros(1, np.uint8)
        return
    seeds = _sorted_lms(text, depth, base)
    common = np.zeros(len(seeds), np.uint8)
    common[1:] = _common(symbols, seeds[:-1], seeds[1:], depth)
    of_seed = symbols[seeds]
    present = np.unique(symbols).tolist()
    large, kept = SymbolQueues(most), SymbolQueues(most)

    def seam(a: int | None, b: int) -> int:
        return 0 if a is None else min(text.run_left(a), text.run_left(b), depth)

    for symbol in present:
        lo, hi = np.searchsorted(of_seed, symbol), np.searchsorted(of_seed, symbol, "right")

        def seeds_behind(last, lo=lo, hi=hi):
            prefixes = common[lo:hi].copy()
            if lo < hi:
                prefixes[0] = seam(last, int(seeds[lo]))
            return seeds[lo:hi], prefixes

        kept.push(symbol, *_induce(text, large, symbol, False, seeds_behind, depth)[0])
    small = SymbolQueues(most)
    small.push(0, np.array([len(symbols) - 1]), np.zeros(1, np.uint8))
    for symbol in reversed(present):

        def large_behind(last, symbol=symbol):
            positions, prefixes = kept.pop(symbol)
            down = np.append(np.zeros(1, np.uint8), prefixes[1:][::-1])[: len(positions)]
            if len(positions):
                down[0] = seam(last, int(positions[-1]))
            return positions[::-1], down

        own, behind = _induce(text, small, symbol, True, large_behind, depth)
        positions, prefixes = (np.concatenate(p) for p in zip(own, behind))
        yield positions[::-1], np.append(np.zeros(1, np.uint8), prefixes[1:][::-1])
