"""Word shingles of many texts at once, as 64-bit hashes."""

from __future__ import annotations

import numpy as np

WORDS = 5
# Bytes of texts hashed together: a worker keeps the memory that its largest arrays took.
SLICE_BYTES = 400_000

LOWER_CASE = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_known_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    global _known_powers
    if len(_known_powers[0]) < n:
        size = 1 << max(16, n.bit_length())
        both = []
        for factor in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(size, factor, np.uint64)
            steps[0] = 1
            both.append(np.multiply.accumulate(steps))
        _known_powers = both[0], both[1]
    return _known_powers


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _slice(texts: list[bytes], words: int) -> list[np.ndarray]:
    raw = np.frombuffer(b" ".join([*texts, b""]).translate(LOWER_CASE), np.uint8)
    if not len(raw):
        return [np.zeros(0, np.uint64) for _ in texts]
    space = _SPACE[raw]
    before = np.r_[True, space[:-1]]
    starts = np.flatnonzero(~space & before)
    ends = np.flatnonzero(space & ~before)
    power, inverse = powers(len(raw) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[: len(raw)])))
    hashed = mix((sums[ends] - sums[starts]) * inverse[starts])
    cuts = np.cumsum([len(t) + 1 for t in texts])
    upto = np.searchsorted(starts, cuts)  # words of all texts up to each
    first = np.r_[0, upto[:-1]]
    factors = mix(np.arange(1, words + 1, dtype=np.uint64)) | np.uint64(1)
    n = len(hashed) - words + 1
    together = np.zeros(max(n, 0), np.uint64)
    for i in range(words if n > 0 else 0):
        together += hashed[i : i + n] * factors[i]
    together = mix(together)
    out = []
    for a, b in zip(first.tolist(), upto.tolist()):
        if b - a >= words:
            out.append(np.unique(together[a : b - words + 1]))
        elif b > a:
            few = (hashed[a:b] * factors[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(mix(np.array([few], np.uint64)))
        else:
            out.append(hashed[:0])
    return out


def shingle_sets(texts: list[str | None], words: int = WORDS):
    """Yields, for each text, its distinct shingles as sorted hashes.

    Words are runs of characters other than white space, with A-Z in lower case. A text
    of fewer words has its whole sequence as the only shingle; no word, no shingle.
    """
    run, size = [], 0
    for text in texts:
        run.append((text or "").encode("utf-8", "surrogatepass"))
        size += len(run[-1])
        if size >= SLICE_BYTES:
            yield from _slice(run, words)
            run, size = [], 0
    yield from _slice(run, words) if run else ()
