import numpy as np
import pytest

from comarca.llm.suffixes import SymbolQueues, sorted_suffixes


def brute(symbols, depth):
    order = sorted(range(len(symbols)), key=lambda i: symbols[i:])
    common = [0]
    for a, b in zip(order, order[1:]):
        n = 0
        while n < depth and max(a, b) + n < len(symbols) and symbols[a + n] == symbols[b + n]:
            n += 1
        common.append(n)
    return order, common


def induced(symbols, depth, **limits):
    order, common = [], []
    for positions, prefixes in reversed(list(sorted_suffixes(symbols, depth, **limits))):
        order += positions.tolist()
        common += [0, *prefixes[1:].tolist()]
    return order, common


# Limits of 3 and 2 make the recursion and the spilled queues do the work.
@pytest.mark.parametrize("limits", [{}, {"base": 3}, {"most": 2}, {"base": 3, "most": 2}])
@pytest.mark.parametrize("seed", range(40))
def test_order_and_common_prefixes(seed, limits):
    rng = np.random.default_rng(seed)
    text = rng.integers(1, rng.integers(2, 6), rng.integers(0, 50))
    if seed % 3 == 0:
        text = np.tile(text, 3)
    symbols = np.append(text, 0).astype(np.uint16)
    order, common = brute(symbols.tolist(), 200)
    common = [c if c else 0 for c in common]
    assert induced(symbols, 200, **limits) == (order, common)


@pytest.mark.parametrize("text", [b"", b"a", b"a" * 700, b"ab" * 300, b"banana", bytes(range(255))])
def test_special_texts(text):
    symbols = np.append(np.frombuffer(text, np.uint8).astype(np.uint16) + 1, 0).astype(np.uint16)
    order, common = induced(symbols, 255, base=4)
    want, depths = brute(symbols.tolist(), 255)
    if len(text) < 255:
        assert order == want
    assert common == depths and sorted(order) == sorted(want)


def test_queues_spill_and_keep_the_order():
    rng, queues, want = np.random.default_rng(1), SymbolQueues(50), {}
    for step in range(200):
        symbol, n = int(rng.integers(0, 5)), int(rng.integers(1, 20))
        positions = rng.integers(0, 1 << 40, n)
        queues.push(symbol, positions, (positions % 200).astype(np.uint8))
        want.setdefault(symbol, []).extend(positions.tolist())
        if step % 17 == 0:
            got = queues.pop(symbol)
            assert got[0].tolist() == want.pop(symbol)
            assert got[1].tolist() == [p % 200 for p in got[0].tolist()]
    assert queues.file is not None
    for symbol, positions in want.items():
        assert queues.pop(symbol)[0].tolist() == positions
    assert queues.pop(9)[0].tolist() == []
