"""Near duplicates: an exact Jaccard join on word shingles with adaptive multi-match prefixes."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from comarca.llm.common import salted_join, stored
from comarca.llm.components import components
from comarca.llm.shared import class_name, classes_of, shared_tokens, texts_of
from comarca.llm.shingles import WORDS, shingle_sets

# Similarity as a fraction, so that the comparison is one of whole numbers.
AT_LEAST = (80, 100)
# Rounds in which every document is compared to one partner before all others follow.
ROUNDS = 2
# Tokens of a document by which a pair found again and again is told apart.
FEW = 8
# Hash ranges of which a set keeps whether it has an odd number of shingles in it, 64 in a long.
RANGE_BITS = 10
BITS = [f"bits{i}" for i in range((1 << RANGE_BITS) // 64)]


def least_overlap(n, at_least=AT_LEAST):
    """Shingles that a set of n must share with any set as similar as that."""
    return (n * at_least[0] + at_least[1] - 1) // at_least[1]


def most_matches(n, at_least=AT_LEAST):
    """The longest prefix that is indexed is the one that asks for so many shared tokens."""
    return np.minimum(np.maximum(least_overlap(n, at_least), 1), 5 + n // 20)


def _signatures(docs: DataFrame, words: int) -> DataFrame:
    """(id, n, a, b): the size of the shingle set and 128 bits of it; null for no shingle."""

    def sign(batches):
        for batch in batches:
            sizes, a, b = [], [], []
            for tokens in shingle_sets(batch.column("text").to_pylist(), words):
                sizes.append(len(tokens))
                x, y = _signature(tokens) if len(tokens) else (None, None)
                a.append(x)
                b.append(y)
            columns = [batch.column("id"), pa.array(sizes, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n", "a", "b"])

    return stored(docs.mapInArrow(sign, "id long, n long, a long, b long"))


def _signature(tokens: np.ndarray) -> tuple[int, int]:
    digest = hashlib.md5(tokens.tobytes()).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _signed(texts: list[str | None], words: int):
    for tokens in shingle_sets(texts, words):
        yield _signature(tokens) if len(tokens) else None


def _signature_column(text: Column, words: int) -> Column:
    """A struct of n, 0 for a text without a shingle, and a and b as in ``_signatures``."""

    @F.pandas_udf("n long, a long, b long")
    def signature(texts: pd.Series) -> pd.DataFrame:
        found = [(len(t), *_signature(t)) if len(t) else (0, 0, 0) for t in shingle_sets([t or None for t in texts], words)]
        return pd.DataFrame(found, columns=["n", "a", "b"], dtype="int64")

    return signature.asNondeterministic()(text)


def _prefixes(docs: DataFrame, shift: int, words: int, at_least) -> DataFrame:
    """(token, x, pos, n): the prefix tokens that two classes or more have, and where they stand.

    Tokens are ordered by their hash, so a prefix is the smallest of them.
    """

    def produce(batches):
        for batch in batches:
            for tokens in shingle_sets(batch.column("text").to_pylist(), words):
                n = len(tokens)
                if n:
                    prefix = int(min(n, n - least_overlap(n, at_least) + most_matches(n, at_least)))
                    yield class_name(*_signature(tokens), shift), n, tokens[:prefix], np.arange(prefix)

    return shared_tokens(docs.select("text"), produce)


def _hopeful(prefixes: DataFrame, at_least) -> DataFrame:
    """The classes (x) that may have a partner: one shares as many tokens of its prefix as the prefix asks for."""
    num, den = at_least
    least = F.expr(f"(n * {num} + {den - 1}) div {den}")
    asked = F.least(F.greatest(least, F.lit(1)), F.expr("5 + n div 20"))  # as most_matches
    return prefixes.groupBy("x", "n").agg(F.count("*").alias("rows")).filter(F.col("rows") >= asked).select("x")


def _shared_counts(texts: DataFrame, shift: int, words: int) -> DataFrame:
    """(x, shared): how many of all shingles of a class any other of these classes has too."""

    def produce(batches):
        for batch in batches:
            for x, tokens in zip(batch.column("x").to_pylist(), shingle_sets(batch.column("text").to_pylist(), words)):
                if class_name(*_signature(tokens), shift) == x:  # else another text under the same id
                    yield x, len(tokens), tokens, np.arange(len(tokens))

    counted = shared_tokens(texts, produce, only_count=True)
    return counted.groupBy("x").agg(F.sum("pos").alias("shared"))


def _sets(texts: DataFrame, shift: int, words: int) -> DataFrame:
    """(x, set, bits...): all shingles of a class, and for each of their hash ranges whether their number is odd.

    Two sets differ in as many shingles at least as these bits differ.
    """

    def hashed(batches):
        for batch in batches:
            xs, sets, odd = [], [], []
            for x, tokens in zip(batch.column("x").to_pylist(), shingle_sets(batch.column("text").to_pylist(), words)):
                if class_name(*_signature(tokens), shift) == x:  # else another text under the same id
                    xs.append(x)
                    sets.append(tokens.tobytes())
                    ranges = (tokens >> np.uint64(64 - RANGE_BITS)).astype(np.int64)
                    odd.append(np.packbits(np.bincount(ranges, minlength=1 << RANGE_BITS) & 1).view("<i8"))
            bits = np.array(odd).reshape(-1, len(BITS)).T
            columns = [pa.array(xs, pa.int64()), pa.array(sets, pa.binary()), *map(pa.array, bits)]
            yield pa.RecordBatch.from_arrays(columns, ["x", "set", *BITS])

    longs = ", ".join(f"{b} long" for b in BITS)
    return stored(texts.mapInArrow(hashed, f"x long, set binary, {longs}").dropDuplicates(["x"]))


def _verified(pairs: DataFrame, sets: DataFrame, at_least) -> DataFrame:
    """Edges (a, b) among the pairs (x, y, matches) whose whole sets are similar enough.

    A pair is compared in full once its prefixes share as many tokens as ``matches`` asks for.
    """

    def common(s, t):
        at = np.searchsorted(t, s)
        return int((t[np.minimum(at, len(t) - 1)] == s).sum())

    def verify(batches):
        for batch in batches:
            a, b = [], []
            rows = (batch.column(c).to_pylist() for c in ("x", "y", "matches"))
            for x, y, matches, *pair in zip(*rows, batch.column("sx"), batch.column("sy")):
                s, t = (np.frombuffer(v.as_buffer(), np.uint64) for v in pair)
                if matches > 1 and common(*(v[: len(v) - least_overlap(len(v), at_least) + matches] for v in (s, t))) < matches:
                    continue
                both = common(s, t)
                if at_least[1] * both >= at_least[0] * (len(s) + len(t) - both):
                    a.append(x)
                    b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    weights = pairs.groupBy("y").agg(F.count("*").alias("uses"))
    partner = sets.select(F.col("x").alias("y"), F.col("set").alias("sy")).join(weights.hint("merge"), "y")
    left = pairs.join(sets.select("x", F.col("set").alias("sx")).hint("merge"), "x")
    both = salted_join(left, partner, ["y"], "uses", pairs.count(), "x").select("x", "y", "matches", "sx", "sy")
    return stored(both.mapInArrow(verify, "a long, b long"))


def _may_be_similar(at_least) -> str:
    """Sizes n and m, of which ``shared`` and ``shared_y`` tokens are anyone else's, allow for enough in common."""
    num, den = at_least
    return (
        f"least(n, m) * {den} >= greatest(n, m) * {num} and least(shared, shared_y) * {num + den} >= (n + m) * {num}"
    )


def _hub_pairs(rows: DataFrame, nth: int, at_least) -> DataFrame:
    """For every x the one document of another component that shares most prefix tokens among hubs.

    The hubs of a token are the first and the last of its documents in an order, so a token of
    m documents costs m rows, whatever m is.
    """
    # First those that have most in common with others, such as the text that copies were made of.
    order = -F.col("shared") / F.col("n") if nth % 2 == 0 else F.xxhash64(F.lit(nth), "x").cast("double")
    member = F.struct(order.alias("order"), "x", "root", "n", "shared")
    hubs = rows.groupBy("token").agg(
        F.min(member).alias("low"), F.max(member).alias("high"), F.count("*").alias("df")
    ).filter("low.x != high.x")
    met = salted_join(rows, hubs, ["token"], "df", rows.count(), "x")
    hub = F.when(F.col("low.root") != F.col("root"), F.col("low")).when(F.col("high.root") != F.col("root"), F.col("high"))
    return (
        met.withColumn("hub", hub)
        .filter("hub is not null")
        .select("x", "n", "shared", F.col("hub.x").alias("y"), F.col("hub.n").alias("m"), F.col("hub.shared").alias("shared_y"))
        .filter(_may_be_similar(at_least))
        .groupBy("x", "y")
        .count()
        .groupBy("x")
        .agg(F.max_by("y", F.struct("count", "y")).alias("y"))
        .withColumn("matches", F.lit(1))
    )


def _probe_pairs(rows: DataFrame, sets: DataFrame, at_least) -> DataFrame:
    """All pairs of different components that may still be similar: (x, y, matches).

    Document x may take a longer prefix, which asks for ``matches`` shared tokens instead of one, and
    then need not look up the matches - 1 most frequent tokens of it, as one of the others must be
    shared too. It takes the length whose look-ups meet the fewest documents.
    """

    def choose(batches):
        for batch in batches:
            out = []
            lists = batch.column("tokens")
            fields = [lists.flatten().field(c).to_numpy() for c in ("pos", "cost", "token")]
            cuts = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            for i, row in enumerate(zip(*(batch.column(c).to_pylist() for c in ("x", "n", "root", "shared")))):
                n = row[1]
                pos, cost, token = (f[cuts[i] : cuts[i + 1]] for f in fields)
                t, best = least_overlap(n, at_least), None
                for matches in range(1, int(most_matches(t, at_least)) + 1):
                    inside = np.flatnonzero(pos < n - t + matches)
                    inside = inside[np.argsort(-cost[inside], kind="stable")][matches - 1 :]
                    total = int(cost[inside].sum())
                    if best is None or total < best[0]:
                        best = total, matches, inside
                    if not total:
                        break
                _, matches, look = best
                look = look[np.argsort(token[look])]
                few = token[look[:FEW]].tolist()
                out += [(k, *row, matches, c, few[:nth]) for nth, (k, c) in enumerate(zip(token[look].tolist(), cost[look].tolist()))]
            kinds = [pa.int64()] * 7 + [pa.list_(pa.int64())]
            columns = [pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 8, kinds)]
            yield pa.RecordBatch.from_arrays(columns, ["token", "x", "n", "root", "shared", "matches", "cost", "before"])

    # A token all of whose documents are in one component has nothing to find any more.
    sizes = rows.groupBy("token").agg(
        F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("cost")
    ).filter("low != high").drop("low", "high")
    open_ = stored(salted_join(rows, sizes, ["token"], "cost", rows.count(), "x"))
    chosen = (
        open_.groupBy("x", "n", "root", "shared").agg(F.collect_list(F.struct("pos", "cost", "token")).alias("tokens"))
        .mapInArrow(choose, "token long, x long, n long, root long, shared long, matches long, cost long, before array<long>")
    )
    num, den = at_least
    least_y = f"((m * {num} + {den - 1}) div {den})"
    index = open_.select(
        "token", F.col("x").alias("y"), F.col("n").alias("m"), F.col("root").alias("root_y"), F.col("shared").alias("shared_y"),
        F.col("pos").alias("pos_y"),
    )
    # The smallest tokens that any probe finds y under, to tell that a pair has been met under one of them.
    early = index.filter(f"pos_y < m - {least_y} + 1").groupBy("y").agg(F.slice(F.array_sort(F.collect_set("token")), 1, FEW).alias("early"))
    bits_y = sets.select(F.col("x").alias("y"), *[F.col(b).alias(f"{b}_y") for b in BITS])
    index = index.join(early.hint("merge"), "y", "left").join(bits_y.hint("merge"), "y")
    chosen = stored(chosen.join(sets.select("x", *BITS).hint("merge"), "x"))
    differing = " + ".join(f"bit_count({b} ^ {b}_y)" for b in BITS)
    near_enough = f"({differing}) * {num + den} <= (n + m) * {den - num}"
    met_before = "coalesce(arrays_overlap(before, filter(early, e -> e < token)), false)"
    return (
        salted_join(index, chosen, ["token"], "cost", rows.count(), "y")
        .filter(f"root != root_y and {_may_be_similar(at_least)} and pos_y < m - {least_y} + matches")
        .filter(f"{near_enough} and not {met_before}")
        .groupBy("x", "y")
        .agg(F.max("matches").alias("matches"))
    )


def similar_groups(
    docs: DataFrame,
    words: int = WORDS,
    at_least: tuple[int, int] = AT_LEAST,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The connected components of documents whose shingle sets have at least that Jaccard similarity.

    Returns a row per document: id, n_shingles and component_id, the smallest id reachable.

    - Null texts and texts without a word have no shingle and are linked with nothing.
    - Equal sets, such as copies and texts that differ in white space, are one class from the start
      and are never expanded into pairs. Repeated rows of one id come back as often as they are there.
    - A null id is no name for a component but links like any other: its document gets the smallest id reachable,
      null if there is none. An id with several texts stands for each of them.
    - Texts of any length are read whole. Other columns may have any name. An empty table gives no rows.

    Joins with what grows with the input are merge joins at every size. Links are found on classes. In a few rounds every class is first compared to one other
    that shares many prefix tokens, which joins groups of near copies without their pairs;
    then all pairs that are left between different components are looked up by adaptive
    prefixes and verified. No link is lost: pairs are only skipped within a component.
    """
    slim, labelled = _labelled(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), words, at_least)
    return _per_document(slim, labelled).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def _labelled(docs: DataFrame, words: int, at_least) -> tuple[DataFrame, DataFrame]:
    """The signatures of (id, text), and (a, b, copies, component_id, leads): one class of each component leads."""
    slim = _signatures(docs, words)
    classes, shift = classes_of(slim)
    prefixes = _prefixes(docs, shift, words, at_least)
    wanted = stored(_hopeful(prefixes, at_least).join(classes.select("x", "rep", "a", "b").hint("merge"), "x"))
    texts = stored(texts_of(docs, wanted, lambda texts: _signed(texts, words)).select("x", "text"))
    # The longest prefix of all, the whole set, for those that are left: enough of it must be shared.
    least = F.expr(f"(n * {at_least[0]} + {at_least[1] - 1}) div {at_least[1]}")
    counts = _shared_counts(texts, shift, words)
    prefixes = stored(prefixes.join(counts.hint("merge"), "x").filter(F.col("shared") >= least))
    some = prefixes.select("x").distinct()
    sets = _sets(texts.join(some.hint("merge"), "x", "left_semi"), shift, words)
    rows, edges = prefixes.withColumn("root", F.col("x")), None
    for nth in range(ROUNDS + 1):
        pairs = _hub_pairs(rows, nth, at_least) if nth < ROUNDS else _probe_pairs(rows, sets, at_least)
        found = _verified(stored(pairs), sets, at_least)
        edges = found if edges is None else edges.union(found)
        roots = components(edges)
        edges = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
        rows = (
            prefixes.join(roots.withColumnRenamed("node", "x").hint("merge"), "x", "left")
            .withColumn("root", F.coalesce("root", "x"))
        )
    named = classes.join(roots.withColumnRenamed("node", "x").hint("merge"), "x", "left").withColumn("root", F.coalesce("root", "x"))
    smallest = named.groupBy("root").agg(
        F.min("rep").alias("component_id"), F.min("x").alias("lead"), F.count("*").alias("members")
    )
    labelled = salted_join(named, smallest, ["root"], "members", classes.count(), "x")
    return slim, stored(labelled.select("a", "b", "copies", "component_id", (F.col("x") == F.col("lead")).alias("leads")))


def _per_document(slim: DataFrame, labelled: DataFrame) -> DataFrame:
    some = salted_join(slim.filter("n > 0"), labelled, ["a", "b"], "copies", slim.count(), "id")
    none = slim.filter("n = 0").withColumn("component_id", F.col("id"))
    return some.select("id", "n", "component_id").union(none.select("id", "n", "component_id"))


def drop_similar(
    docs: DataFrame,
    words: int = WORDS,
    at_least: tuple[int, int] = AT_LEAST,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The documents, all columns unchanged, whose id is the smallest of their component (see ``similar_groups``).

    Of a component none of whose documents has an id one row stays, and so do all rows without an id and
    without a word.
    """
    slim, labelled = _labelled(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), words, at_least)
    kept = _per_document(slim, labelled).filter("id = component_id").select(F.col("id").alias("_kept"))
    named = docs.join(kept.hint("merge"), docs[id_col] == kept["_kept"], "left_semi")
    sign = "_near_copy_sign"
    unnamed = docs.filter(F.col(id_col).isNull()).withColumn(sign, _signature_column(F.col(text_col), words))
    empty = unnamed.filter(F.col(sign)["n"] == 0).drop(sign)
    lone = labelled.filter("component_id is null and leads").select(F.struct("a", "b").alias("_lone"))
    bits = F.struct(F.col(sign)["a"].alias("a"), F.col(sign)["b"].alias("b"))
    signed = unnamed.filter(F.col(sign)["n"] > 0).withColumn(sign, bits)
    first = signed.join(lone.hint("merge"), signed[sign] == lone["_lone"], "left_semi").dropDuplicates([sign]).drop(sign)
    return named.unionByName(empty).unionByName(first)
