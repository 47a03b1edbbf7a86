"""Exact nearest neighbours of binary codes by incremental multi-index hashing."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from comarca.llm.common import hot_shares, stored

BITS = 64


def sign_code(vector: Column) -> Column:
    """The signs of up to 64 numbers as a long: bit i is set where number i is above zero. Null has no code."""

    @F.pandas_udf("long")
    def packed(vectors: pd.Series) -> pd.Series:
        bits = np.zeros((len(vectors), BITS), np.uint8)
        for row, v in zip(bits, vectors):
            if v is not None:
                row[: len(v)] = np.asarray(v, dtype=float) > 0
        codes = np.packbits(bits, axis=1, bitorder="little").view("<i8").ravel()
        return pd.Series([int(c) if v is not None else None for c, v in zip(codes, vectors)], dtype="Int64")

    return packed(vector)


def _segments(n_codes: int) -> list[tuple[int, int]]:
    """(first bit, bits) of segments of log2(codes) - 2 bits at most, so that a bucket holds a few codes.

    Shorter segments have larger buckets, longer ones need a larger radius and far more probes.
    """
    count = math.ceil(BITS / min(16, max(4, round(math.log2(max(n_codes, 2))) - 2)))
    cuts = [BITS * i // count for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _part(code: Column, first: int, bits: int) -> Column:
    return F.shiftrightunsigned(code, first).bitwiseAND(F.lit((1 << bits) - 1))


def _masks(bits: int, radius: int) -> list[int]:
    return [sum(1 << b for b in chosen) for chosen in combinations(range(bits), radius)]


def _at_radius(part: Column, bits: int, radius: int) -> Column:
    """All segment values that differ from this one in so many bits."""
    return F.transform(F.lit(_masks(bits, radius)).cast("array<long>"), lambda mask: part.bitwiseXOR(mask))


def _new_at(segment: int, radius: int, segments: list[tuple[int, int]], differing: Column) -> Column:
    """Whether this segment is the first, at this radius, in which two codes are found close."""
    first = F.lit(True)
    for j, (a, bits) in enumerate(segments):
        if j != segment:
            first = first & (F.bit_count(_part(differing, a, bits)) >= (radius + 1 if j < segment else radius))
    return first


def nearest_codes(
    rows: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", code_col: str = "code"
) -> DataFrame:
    """The k rows nearest to each query by Hamming distance of the codes, without the query's own id.

    Returns query_id, rank (1 to k), neighbor_id and distance; ties go to the smaller id.
    ``queries`` are rows of the same columns.

    - Null codes are neither searched for nor found. A query with fewer than k others gets all of them.
    - Equal codes are searched once and found once, each with its k + 1 smallest ids, so a code that
      a third of the rows have costs no more than another.
    - Repeated rows (id and code) count once. Null ids are left out. Other columns may have any
      name. No rows or no queries give no rows.

    Codes are cut into segments. In round r all codes are met that differ from the query in exactly
    r bits of some segment. After it every code within segments * (r + 1) - 1 bits has been met, so a
    query is done once its kth distance is no larger. Rounds shuffle the open queries' probes only, and
    a segment value with many codes is dealt over as many tasks as it holds shares of them (``hot_shares``).
    Only the list of such values, at most one a share for each segment, is broadcast.
    """
    n, shares = k + 1, hot_shares(rows.sparkSession)
    named = rows.select(F.col(id_col).alias("id"), F.col(code_col).alias("code")).dropna().distinct()
    first = F.row_number().over(Window.partitionBy("code", "deal").orderBy("id"))
    dealt = named.withColumn("deal", F.pmod(F.xxhash64("id"), F.lit(shares)))
    # The smallest ids of a code, taken in each of many parts of it first.
    few = dealt.withColumn("nth", first).filter(F.col("nth") <= n).groupBy("code").agg(F.collect_list("id").alias("ids"))
    codes = stored(few.select("code", F.slice(F.array_sort("ids"), 1, n).alias("ids")))
    asked = queries.select(F.col(id_col).alias("query_id"), F.col(code_col).alias("query")).dropna().distinct()
    n_codes = codes.count()
    segments = _segments(n_codes)
    size = F.least(F.size("ids"), F.lit(n))
    index = codes.select(
        "code",
        F.element_at("ids", 1).alias("low"),
        size.alias("ids"),
        F.posexplode(F.array(*[_part(F.col("code"), a, b) for a, b in segments])).alias("segment", "part"),
    )
    # A code is in each segment once, so no more values of a segment can hold a share of all codes than there are shares.
    tasks = F.expr(f"int(count * {shares} div {max(n_codes, 1)})").alias("tasks")
    hot = index.groupBy("segment", "part").count().select("segment", "part", tasks).filter("tasks > 1")
    hot = F.broadcast(stored(hot))
    salt = F.coalesce(F.pmod(F.xxhash64("code"), "tasks"), F.lit(0)).cast("int")
    index = stored(index.join(hot, ["segment", "part"], "left").withColumn("salt", salt).drop("tasks"))
    salts = F.sequence(F.lit(0), F.coalesce("tasks", F.lit(1)) - 1)

    open_ = stored(asked.select("query").distinct().withColumn("within", F.lit(BITS)))
    found, radius, settled = None, 0, []
    best = Window.partitionBy("query").orderBy("distance", "low")
    nearer = Window.partitionBy("query").orderBy("distance").rangeBetween(Window.unboundedPreceding, -1)
    while not open_.isEmpty():
        probes = None
        for j, (a, bits) in enumerate(segments):
            if radius <= bits:
                near = _at_radius(_part(F.col("query"), a, bits), bits, radius)
                probe = open_.select("query", "within", F.lit(j).alias("segment"), F.explode(near).alias("part"))
                probes = probe if probes is None else probes.union(probe)
        probes = probes.join(hot, ["segment", "part"], "left").withColumn("salt", F.explode(salts)).drop("tasks")
        differing = F.col("query").bitwiseXOR(F.col("code"))
        fresh = F.coalesce(
            *[F.when(F.col("segment") == j, _new_at(j, radius, segments, differing)) for j in range(len(segments))]
        )
        met = (
            probes.join(index.hint("merge"), ["segment", "part", "salt"])
            .filter(fresh & (F.bit_count(differing) <= F.col("within")))
            .select("query", "code", "low", "ids", F.bit_count(differing).alias("distance"))
        )
        found = met if found is None else found.union(met)
        ranked = found.withColumn("nth", F.row_number().over(best))
        ranked = ranked.withColumn("before", F.coalesce(F.sum("ids").over(nearer), F.lit(0)))
        # A code with n others before it, or n ids at smaller distance, cannot add an id.
        found = stored(ranked.filter((F.col("nth") <= n) & (F.col("before") < n)).drop("nth", "before"))
        covered = len(segments) * (radius + 1) - 1
        state = found.groupBy("query").agg(
            F.sum("ids").alias("ids"), F.sum(F.when(F.col("distance") <= covered, F.col("ids"))).alias("sure"),
            F.max("distance").alias("farthest"),
        )
        radius += 1
        if covered >= BITS or radius > max(b for _, b in segments):
            break
        open_ = stored(
            open_.join(state.hint("merge"), "query", "left")
            .filter(F.coalesce("sure", F.lit(0)) < n)
            .select("query", F.when(F.col("ids") >= n, F.col("farthest")).otherwise(F.lit(BITS)).alias("within"))
        )
        # What a query has found is ranked again only while it is open.
        still = open_.select("query").hint("merge")
        settled.append(found.join(still, "query", "left_anti"))
        found = found.join(still, "query", "left_semi")
    for done in settled:
        found = found.unionByName(done)
    if found is None:
        found = index.select(F.col("code").alias("query"), "code", "low", "ids", F.lit(0).alias("distance")).limit(0)
    rank = F.row_number().over(Window.partitionBy("query_id", "query").orderBy("distance", "neighbor_id"))
    return (
        asked.join(found.drop("ids").hint("merge"), "query")
        .join(codes.hint("merge"), "code")
        .select("query_id", "query", "distance", F.explode("ids").alias("neighbor_id"))
        .filter("query_id != neighbor_id")
        .withColumn("rank", rank)
        .filter(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("long").alias("rank"), "neighbor_id", F.col("distance").cast("long").alias("distance"))
    )
