"""Mixing sources to target weights: which documents, how often."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from comarca.llm.common import WORD, stored

BUCKETS = 1024
# Words that are left to the exact fit; what exceeds them is filled greedily.
FIT_WORDS = 1 << 15


def cycle_weights(names: list[str | None], cycle: tuple[int, ...] = (3, 1, 2)) -> list[int]:
    """Weights by the sorted position of the source."""
    return [cycle[i % len(cycle)] for i in range(len(names))]


def source_targets(
    sizes: Mapping[str | None, int], weights: Mapping[str | None, int], share: Fraction, most: int
) -> dict[str | None, Fraction]:
    """Shares of ``share`` times all sizes by weight; none above ``most`` times its source's size."""
    left, targets, open_ = share * sum(sizes.values()), {}, set(sizes)
    while open_:
        weight = sum(weights[s] for s in open_)
        full = {s for s in open_ if left * weights[s] > most * sizes[s] * weight}
        if not full:
            return targets | {s: left * weights[s] / weight for s in open_}
        for s in full:
            targets[s] = Fraction(most * sizes[s])
        left -= sum(targets[s] for s in full)
        open_ -= full
    return targets


def fit_budget(sizes: np.ndarray, counts: np.ndarray, budget: int, fit_words: int = FIT_WORDS) -> np.ndarray:
    """How many documents of each length to take so that their words come nearest below the budget.

    Every length first gives the same share of its documents, the long ones fill up what is
    left down to ``fit_words``, and a bounded knapsack over the lengths still available fits
    the rest exactly: bit j of ``reach`` says that j words can be made.
    """
    sizes, counts = [int(s) for s in sizes], [int(c) for c in counts]
    total = sum(s * c for s, c in zip(sizes, counts))
    if total <= budget:
        return np.array(counts, dtype=np.int64)
    take = [c * budget // total if s else 0 for s, c in zip(sizes, counts)]
    left = budget - sum(s * t for s, t in zip(sizes, take))
    long_first = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    for floor in (fit_words, 0):
        for i in long_first:
            if sizes[i] and left > fit_words:
                more = min(counts[i] - take[i], max(0, left - floor) // sizes[i])
                take[i] += more
                left -= more * sizes[i]
    reach, steps = 1, []
    mask = (1 << (left + 1)) - 1
    for i in long_first:
        spare, piece = min(counts[i] - take[i], left // sizes[i] if sizes[i] else 0), 1
        while spare and not reach >> left & 1:
            piece = min(piece, spare)
            steps.append((i, piece, reach))
            reach = (reach | reach << piece * sizes[i]) & mask
            spare, piece = spare - piece, piece * 2
    at = reach.bit_length() - 1
    for i, piece, before in reversed(steps):
        if not before >> at & 1:
            take[i] += piece
            at -= piece * sizes[i]
    return np.array(take, dtype=np.int64)


def mix_sources(
    docs: DataFrame,
    weights_of: Callable[[list[str | None]], list[int]] = cycle_weights,
    share: Fraction = Fraction(3, 2),
    most: int = 2,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """How many words of each document a mix of the sources takes.

    Returns id, size (words), source, source_size, target (words of the source), copies (a
    document is taken whole, 0 to ``most`` times) and taken (words, repeats counted).
    ``weights_of`` gets the sources by code point, null last.

    - Null or empty text: size 0, taken 0. A source without words has target 0.
    - Null is a source of its own. Equal or repeated rows are chosen one by one.
    - Null ids are allowed. Other columns may have any name. An empty table gives no rows.
    - The choice among documents of one source and length follows a seeded hash of the id,
      so reruns agree whatever the partitions are.

    Only (source, length, count) rows go into the fit, one task per source; their number is
    at most about the square root of twice the source's words. The sources themselves, one
    row each with its weight, are a list on the driver. Documents of one source and length
    are ranked within ``BUCKETS`` hash buckets, so no length can fill a task.
    """
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    slim = stored(
        docs.select(
            F.col(id_col).alias("id"),
            F.col(source_col).alias("source"),
            F.when(F.col(source_col).isNull(), "-").otherwise(F.concat(F.lit("+"), source_col)).alias("key"),
            size.alias("size"),
            F.xxhash64(F.lit(seed), F.col(id_col)).alias("h"),
        ).withColumn("bucket", F.pmod("h", F.lit(BUCKETS)).cast("int"))
    )
    by_bucket = stored(slim.groupBy("key", "size", "bucket").count())
    lengths = by_bucket.groupBy("key", "size").agg(F.sum("count").alias("n"))
    per_source = {
        (r.key[1:] if r.key[0] == "+" else None): r.words
        for r in lengths.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("words")).collect()
    }
    names = sorted(per_source, key=lambda s: (s is None, s or ""))
    targets = source_targets(per_source, dict(zip(names, weights_of(names))), share, most)
    plan = spark.createDataFrame(
        [
            ("-" if s is None else f"+{s}", per_source[s], float(targets[s]), *_passes(targets[s], per_source[s], most))
            for s in names
        ],
        "key string, source_size long, target double, passes int, budget long",
    )

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("size")
        take = fit_budget(rows["size"].to_numpy(), rows["n"].to_numpy(), int(rows["budget"].iloc[0]))
        return pd.DataFrame({"key": rows["key"], "size": rows["size"], "take": take})

    takes = lengths.join(plan.select("key", "budget"), "key").groupBy("key").applyInPandas(
        fit, "key string, size long, take long"
    )
    upto = Window.partitionBy("key", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    chosen = (
        by_bucket.join(stored(takes), ["key", "size"])
        .withColumn("before", F.coalesce(F.sum("count").over(upto), F.lit(0)))
        .select("key", "size", "bucket", (F.col("take") - F.col("before")).alias("quota"))
    )
    rank = F.row_number().over(Window.partitionBy("key", "size", "bucket").orderBy("h", "id"))
    extra = (rank <= F.col("quota")).cast("int")
    return (
        slim.join(chosen.hint("merge"), ["key", "size", "bucket"])
        .withColumn("extra", extra)
        .join(F.broadcast(plan), "key")  # a row per source, made on the driver
        .select(
            F.col("id").alias(id_col),
            "size",
            "source_size",
            "target",
            (F.col("size") * (F.col("passes") + F.col("extra"))).alias("taken"),
            "source",
            (F.col("passes") + F.col("extra")).alias("copies"),
        )
    )


def _passes(target: Fraction, size: int, most: int) -> tuple[int, int]:
    """Whole passes over the source, and the words that documents chosen once more make up."""
    passes = min(most, int(target // size)) if size else 0
    return passes, 0 if passes == most else int(target - passes * size)


def mixed(docs: DataFrame, id_col: str = "doc_id", **settings) -> DataFrame:
    """The mix itself: every document, all columns unchanged, as often as ``mix_sources`` takes it.

    Rows that share an id are taken as often as the one of them that is taken most often.
    """
    copies = mix_sources(docs, id_col=id_col, **settings)
    copies = copies.groupBy(F.col(id_col).alias("_id")).agg(F.max("copies").alias("_copies")).filter("_copies > 0")
    joined = docs.join(copies.hint("merge"), docs[id_col].eqNullSafe(copies["_id"]))
    return joined.withColumn("_nth", F.explode(F.sequence(F.lit(1), "_copies"))).select(*docs.columns)
