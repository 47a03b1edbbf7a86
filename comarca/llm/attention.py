"""A one-layer causal self-attention model over classes of subword ids, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

# Classes of the ids that the model reads, and of those it predicts; the most frequent are alone in theirs.
INPUTS, CLASSES = 1024, 128
BANDS = 12
# Ids told apart after a class and an id before; the rest are one column of the counts.
COLUMNS = 4096
# How many observations the counts without context weigh where counts with context are few.
BACKOFF = 30.0
WIDTH = 16
# Ids of a window, and by how many the next one starts later: the rest is context that is not scored again.
WINDOW, STRIDE = 32, 24
STEPS, BATCH, RATE = 1000, 96, 0.02
# The steps are done in so many rounds, after each of which the weights of all shards of windows are averaged.
ROUNDS = 4
SCORE_IDS = 1 << 14
# Windows scored in one product, so that the logits stay in cache.
SCORE_WINDOWS = 96
# Scores and logits are held to this, so that their exponentials need no maximum taken off first.
LIMIT = np.float32(80)


class Vocabulary:
    """Ids by frequency rank: ``column`` is the rank up to the last column, which all others share."""

    def __init__(self, counts: np.ndarray):
        by_rank = np.argsort(-counts, kind="stable")
        rank = np.empty(len(counts), np.int64)
        rank[by_rank] = np.arange(len(counts))
        self.column = np.minimum(rank, COLUMNS - 1).astype(np.int16)
        smooth = counts + 1.0
        self.mass = np.bincount(self.column, smooth, COLUMNS)
        # Log-probability of an id in its column, 0 but for those in the last one.
        self.rest = np.log(smooth / self.mass[self.column]).astype(np.float32)
        self.inputs = self._bands(INPUTS)
        self.classes = self._bands(CLASSES)

    def _bands(self, n: int) -> np.ndarray:
        """A class for each column: single ones, then bands of equal mass."""
        upto = np.cumsum(self.mass[n - BANDS :])
        band = np.minimum((upto - self.mass[n - BANDS :]) * BANDS / max(upto[-1], 1), BANDS - 1)
        return np.r_[np.arange(n - BANDS), n - BANDS + band.astype(np.int64)]


@dataclass
class Model:
    """``within`` is the log-probability of a column in its class after an input class, by counts."""

    words: Vocabulary
    within: np.ndarray
    end: int
    parts: dict[str, np.ndarray]


def pair_counts(words: Vocabulary, texts: list[np.ndarray], end: int) -> np.ndarray:
    """How often each column follows each input class, over texts with the end id."""
    ids = np.concatenate(texts)
    column = words.column[ids].astype(np.int64)
    before = np.empty_like(column)
    before[1:] = column[:-1]
    before[np.cumsum([0, *map(len, texts[:-1])])] = words.column[end]
    return np.bincount(words.inputs[before] * COLUMNS + column, minlength=INPUTS * COLUMNS).reshape(INPUTS, COLUMNS)


def windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all windows in a row of texts, the text of each, and how many ids are left from there on."""
    more = np.maximum(0, -(-(lengths - WINDOW) // STRIDE))
    text = np.repeat(np.arange(len(lengths)), more + 1)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(more + 1) - more - 1, more + 1)
    begin = np.cumsum(lengths) - lengths
    return begin[text] + nth * STRIDE, text, lengths[text] - nth * STRIDE


_MASK = np.triu(np.full((WINDOW, WINDOW), -1e9, np.float32), 1)


def _softmax(x: np.ndarray) -> np.ndarray:
    x -= x.max(-1, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(-1, keepdims=True)
    return x


def _start(rng: np.random.Generator, words: Vocabulary, pairs: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    shapes = {"embed": (INPUTS, WIDTH), "place": (WINDOW, WIDTH), "out": (WIDTH, CLASSES)}
    shapes |= {name: (WIDTH, WIDTH) for name in ("query", "key", "value", "mix")}
    parts = {name: rng.normal(0, 0.3, shape).astype(np.float32) for name, shape in shapes.items()}
    by_class = np.zeros((CLASSES, COLUMNS), bool)
    by_class[words.classes, np.arange(COLUMNS)] = True
    grouped = pairs @ by_class.T.astype(np.float64)
    mass = by_class @ words.mass
    smooth = grouped + BACKOFF * mass / mass.sum() + 1e-6  # a band may be empty
    parts["bigram"] = np.log(smooth / smooth.sum(1, keepdims=True)).astype(np.float32)
    alone = words.mass / mass[words.classes]
    within = (pairs + BACKOFF * alone) / (grouped + BACKOFF)[:, words.classes]
    return parts, np.log(within).astype(np.float32)


def _forward(p: dict[str, np.ndarray], seen: np.ndarray) -> tuple:
    x = p["embed"][seen] + p["place"]
    q, k, v = (x @ p[name] for name in ("query", "key", "value"))
    weight = _softmax(q @ k.transpose(0, 2, 1) / np.float32(WIDTH**0.5) + _MASK)
    z = weight @ v
    h = x + z @ p["mix"]
    return x, q, k, v, weight, z, h, h @ p["out"] + p["bigram"][seen]


def _row_sums(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """The rows added up by their place among ``n``."""
    width = rows.shape[1]
    cell = (at[:, None] * width + np.arange(width)).ravel()
    return np.bincount(cell, rows.ravel(), n * width).reshape(n, width).astype(rows.dtype)


class Room:
    """Arrays by name, filled anew in every step: fresh ones of their size are page faults each time."""

    def __init__(self):
        self._held: dict[str, np.ndarray] = {}

    def __call__(self, name: str, shape: tuple[int, ...], dtype: np.dtype) -> np.ndarray:
        size = int(np.prod(shape))
        if name not in self._held or len(self._held[name]) < size:
            self._held[name] = np.empty(size, dtype)
        return self._held[name][:size].reshape(shape)


# Rounds of so few rows are not worth a call, nor are more rounds than these.
FEW, MOST = 16, 64


def _rounds(at: np.ndarray, n: int) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """An order of places whose rows ``_round_sums`` adds up by their value ``at``, below ``n``.

    First come rounds, each with the next place of every value that has one left, frequent values first; then what is
    left of the most frequent ones, value by value. Also returns the values, the lengths of the rounds, and of what is left.
    """
    count = np.bincount(at, minlength=n)
    values = np.argsort(-count, kind="stable")[: np.count_nonzero(count)]
    rank = np.empty(n, np.int16)
    rank[values] = np.arange(len(values))
    order, count = np.argsort(rank[at], kind="stable"), count[values]
    nth = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
    wide = np.bincount(nth)
    wide = wide[: min(MOST, np.count_nonzero(wide >= FEW))]
    order = order[np.argsort(np.minimum(nth, len(wide)).astype(np.int16), kind="stable")]
    return order, (values, wide, count[count > len(wide)] - len(wide))


def _round_sums(rows: np.ndarray, runs: tuple[np.ndarray, np.ndarray, np.ndarray], n: int) -> np.ndarray:
    """Rows in the order of ``_rounds``, added up by their value."""
    values, wide, left = runs
    sums, at = np.zeros((len(values), rows.shape[1]), rows.dtype), 0
    for size in wide.tolist():
        sums[:size] += rows[at : at + size]
        at += size
    for i, size in enumerate(left.tolist()):
        sums[i] += rows[at : at + size].sum(0)
        at += size
    out = np.zeros((n, rows.shape[1]), rows.dtype)
    out[values] = sums
    return out


def _flat(a: np.ndarray) -> np.ndarray:
    return a.reshape(-1, a.shape[-1])


def _gradients(
    p: dict[str, np.ndarray], seen: np.ndarray, next_: np.ndarray, real: np.ndarray, room: Room | None = None
) -> dict[str, np.ndarray]:
    """Those of the mean loss of the real places; logits are made for these alone, the others are context.

    Equal to those of ``_forward`` but for the limit. Real places are in an order in which those of one class add up fast.
    """
    kind, room = p["embed"].dtype, room or Room()
    n, scale = max(int(real.sum()), 1), np.asarray(WIDTH**-0.5, kind)
    all_seen, where = seen.ravel(), np.flatnonzero(real)
    order, runs = _rounds(all_seen[where], INPUTS)
    where = where[order]
    x = np.take(p["embed"], seen, 0, out=room("x", (*seen.shape, WIDTH), kind), mode="clip")
    x += p["place"]
    projections = np.concatenate([p["query"] * scale, p["key"], p["value"]], 1)
    qkv = np.matmul(x, projections, out=room("qkv", (*seen.shape, 3 * WIDTH), kind))
    q, k, v = np.split(qkv, 3, 2)
    # Weights are left unscaled; what they make and what comes back is divided by their sums.
    weight = np.matmul(q, k.transpose(0, 2, 1), out=room("weight", (*seen.shape, WINDOW), kind))
    np.clip(weight, -LIMIT, LIMIT, out=weight)
    weight += _MASK
    np.exp(weight, out=weight)
    part = (1 / (weight @ np.ones(WINDOW, kind)))[..., None]
    z = np.matmul(weight, v, out=room("z", x.shape, kind))
    z *= part
    z_real = np.take(_flat(z), where, 0)
    h = np.take(_flat(x), where, 0)
    h += z_real @ p["mix"]
    d = np.matmul(h, p["out"], out=room("d", (len(where), CLASSES), kind))
    d += np.take(p["bigram"], all_seen[where], 0, out=room("bigram", d.shape, kind), mode="clip")
    np.clip(d, -LIMIT, LIMIT, out=d)
    np.exp(d, out=d)
    d *= (1 / (d @ np.ones(CLASSES, kind)) / n)[:, None]
    d[np.arange(len(where)), next_.ravel()[where]] -= 1 / n
    g = {"out": h.T @ d, "bigram": _round_sums(d, runs, INPUTS)}
    dh = d @ p["out"].T
    g["mix"] = z_real.T @ dh
    dz, dx = room("dz", x.shape, kind), room("dx", x.shape, kind)
    dz.fill(0)
    dx.fill(0)
    _flat(dz)[where] = dh @ p["mix"].T
    _flat(dx)[where] = dh
    dz *= part
    dscore = np.matmul(dz, v.transpose(0, 2, 1), out=room("dscore", weight.shape, kind))
    dscore -= np.einsum("ijk,ijk->ij", dz, z)[..., None]  # the mean of the row under its weights
    dscore *= weight
    parts = room("parts", qkv.shape, kind)
    dq, dk, dv = np.split(parts, 3, 2)
    np.matmul(dscore, k, out=dq)
    np.matmul(dscore.transpose(0, 2, 1), q, out=dk)
    np.matmul(weight.transpose(0, 2, 1), dz, out=dv)
    g |= zip(("query", "key", "value"), np.split(_flat(x).T @ _flat(parts), 3, 1))
    g["query"] = g["query"] * scale
    dx += np.matmul(parts, projections.T, out=room("back", x.shape, kind))
    g["embed"] = _row_sums(all_seen, _flat(dx), INPUTS)
    g["place"] = dx.sum(0)
    return g


def train(texts: list[np.ndarray], words: Vocabulary, pairs: np.ndarray, end: int, steps: int = STEPS, seed: int = 7) -> Model:
    """Fits the weights on all windows of these texts (ids with the end id) by Adam."""
    model = untrained(words, pairs, end, seed)
    if texts and steps:
        columns, lengths = words.column[np.concatenate(texts)], np.array([len(t) for t in texts])
        model.parts = fit(model, packed(words, columns, lengths, end), 0, steps, steps)
    return model


def untrained(words: Vocabulary, pairs: np.ndarray, end: int, seed: int = 7) -> Model:
    parts, within = _start(np.random.default_rng(seed), words, pairs)
    return Model(words, within, end, parts)


def fit(model: Model, rows: np.ndarray, first_step: int, steps: int, total: int) -> dict[str, np.ndarray]:
    """The weights after so many more steps by Adam, of ``total``; every one of the packed windows is in a step.

    Where there are too few windows for steps of ``BATCH``, they come again.
    """
    names, parts, room = sorted(model.parts), {}, Room()
    weights = np.concatenate([model.parts[n].ravel() for n in names])
    cuts = np.cumsum([model.parts[n].size for n in names])[:-1]
    for name, piece in zip(names, np.split(weights, cuts)):
        parts[name] = piece.reshape(model.parts[name].shape)
    # Running sums of the gradients and of their squares, not scaled to means.
    first, second, g = (np.zeros_like(weights) for _ in range(3))
    rows = rows[np.lexsort(rows.T[::-1])]  # whatever order they came in
    order = np.random.default_rng(first_step + 7).permutation(len(rows))
    size = max(BATCH, -(-len(rows) // steps))
    for step in range(1, steps + 1):
        at = rows[order[np.arange((step - 1) * size, step * size) % len(rows)]]
        rate = RATE * min(1, step / 20) * (1 - (first_step + step) / (total + 1))
        found = _gradients(parts, *_unpacked(model.words, at), room)
        np.concatenate([found[n].ravel() for n in names], out=g)
        first *= np.float32(0.9)
        first += g
        g *= g
        second *= np.float32(0.99)
        second += g
        scale = (0.01 / (1 - 0.99**step)) ** 0.5
        np.sqrt(second, out=g)
        g += np.float32(1e-8 / scale)
        np.divide(first, g, out=g)
        g *= np.float32(0.1 * rate / (1 - 0.9**step) / scale)
        weights -= g
    return parts


def packed(words: Vocabulary, columns: np.ndarray, lengths: np.ndarray, end: int, chosen: np.ndarray | None = None) -> np.ndarray:
    """A row per window, or per chosen one: the column before it, its columns, and the places from and up to which it scores."""
    before, next_, scored, _ = _places(words, columns, lengths, end, chosen)
    low = scored.argmax(1)
    return np.c_[before[:, 0], np.where(np.arange(WINDOW) < (low + scored.sum(1))[:, None], next_, 0), low, low + scored.sum(1)].astype(np.int16)


def _unpacked(words: Vocabulary, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    place = np.arange(WINDOW)
    real = (place >= rows[:, -2:-1]) & (place < rows[:, -1:])
    return words.inputs[rows[:, :WINDOW]], words.classes[rows[:, 1 : WINDOW + 1]], real


def _places(words: Vocabulary, columns: np.ndarray, lengths: np.ndarray, end: int, chosen: np.ndarray | None = None) -> tuple:
    """Columns before and at each place of a window, which of them it scores, and its text."""
    begin, text, left = windows(lengths)
    opens = np.r_[True, text[1:] != text[:-1]]
    if chosen is not None:
        begin, text, left, opens = begin[chosen], text[chosen], left[chosen], opens[chosen]
    place = np.arange(WINDOW)
    at = np.minimum(begin[:, None] + place, len(columns) - 1)
    next_ = columns[at]
    before = np.empty_like(next_)
    before[:, 1:] = next_[:, :-1]
    before[:, 0] = np.where(opens, words.column[end], columns[np.maximum(begin - 1, 0)])
    scored = place < left[:, None]
    scored[~opens, : WINDOW - STRIDE] = False
    return before, next_, scored, text


def _grid(model: Model, columns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, ...]:
    """Input classes that each window sees, columns that come next, which of them it scores, and its text."""
    before, next_, scored, text = _places(model.words, columns, lengths, model.end)
    return model.words.inputs[before], next_, scored, text


def log_probabilities(model: Model, texts: list[np.ndarray]) -> np.ndarray:
    """The natural log of each text's probability, given as ids with the end id; every id is scored once.

    Equal to ``_forward`` but for the limit; as the layer sees nothing but an id's class and place, its queries, keys
    and values are sums of two table rows.
    """
    p, out, room = model.parts, np.zeros(len(texts)), Room()
    projections = np.concatenate([p["query"] / np.float32(WIDTH**0.5), p["key"], p["value"]], 1)
    by_class, by_place = p["embed"] @ projections, p["place"] @ projections
    direct = p["bigram"] + p["embed"] @ p["out"]

    def scores(seen, next_, scored, skip):
        """Log-probability of what each window scores; its first ``skip`` places are context alone."""
        kind = by_class.dtype
        qkv = np.take(by_class, seen, 0, out=room("qkv", (*seen.shape, 3 * WIDTH), kind), mode="clip")
        qkv += by_place
        q, k, v = np.split(qkv, 3, 2)
        q, seen, next_ = q[:, skip:], seen[:, skip:], next_[:, skip:].ravel()
        weight = np.matmul(q, k.transpose(0, 2, 1), out=room("weight", (*seen.shape, WINDOW), kind))
        np.clip(weight, -LIMIT, LIMIT, out=weight)
        weight += _MASK[skip:]
        np.exp(weight, out=weight)
        z = weight @ v
        z /= (weight @ np.ones(WINDOW, kind))[..., None]
        h, before = z @ p["mix"] + p["place"][skip:], seen.ravel()
        logits = np.matmul(_flat(h), p["out"], out=room("logits", (seen.size, CLASSES), kind))
        logits += np.take(direct, before, 0, out=room("direct", logits.shape, kind), mode="clip")
        np.clip(logits, -LIMIT, LIMIT, out=logits)
        log_p = logits[np.arange(seen.size), model.words.classes[next_]]
        np.exp(logits, out=logits)
        log_p -= np.log(logits @ np.ones(CLASSES, kind))
        log_p += model.within[before, next_]
        return np.where(scored[:, skip:], log_p.reshape(seen.shape), 0).sum(1, dtype=np.float64)

    first = 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and (size < SCORE_IDS or last == first):
            size += len(texts[last])
            last += 1
        ids = np.concatenate(texts[first:last])
        lengths = np.array([len(t) for t in texts[first:last]])
        total = np.bincount(np.repeat(np.arange(last - first), lengths), model.words.rest[ids], last - first)
        seen, next_, scored, text = _grid(model, model.words.column[ids], lengths)
        opens = np.r_[True, text[1:] != text[:-1]]
        for chosen, skip in ((np.flatnonzero(opens), 0), (np.flatnonzero(~opens), WINDOW - STRIDE)):
            for i in range(0, len(chosen), SCORE_WINDOWS):
                at = chosen[i : i + SCORE_WINDOWS]
                total += np.bincount(text[at], scores(seen[at], next_[at], scored[at], skip), last - first)
        out[first:last] = total
        first = last
    return out
