"""Ids found by a name that may be misspelled.

Names are compared by edit distance, but only those that share a rare pair of letters are: k edits
change at most ``GRAM`` * k grams of a name, so of its rarest ``GRAM`` * k + 1 grams one is among those of
any name that is k edits away. No pair within reach is missed. Everything runs on different
names, not on rows, so a name that a third of all rows have is compared once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from comarca.functions import normalize_text

GRAM = 2
MOST_EDITS = 2
# How many edits the second best name must be further away than the best.
MARGIN = 2
# A name is given one edit per so many of its letters.
LETTERS_PER_EDIT = 4


def grams(name: Column) -> Column:
    """The different runs of ``GRAM`` characters of a name with an edge put around it."""
    edged = F.concat(F.lit("\u0001"), name, F.lit("\u0002"))
    starts = F.sequence(F.lit(1), F.char_length(edged) - (GRAM - 1))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(edged, i, F.lit(GRAM))))


def _rarest(names: DataFrame, keys: list[str], uses: DataFrame, reach: Column) -> DataFrame:
    """(keys, gram): of every name the rarest grams, as many as one of must survive so many edits."""
    exploded = names.select(*keys, reach.alias("_reach"), F.explode("_grams").alias("_gram")).join(uses, "_gram", "left")
    ordered = F.array_sort(F.collect_list(F.struct(F.coalesce("_uses", F.lit(0)).alias("uses"), F.col("_gram").alias("gram"))))
    listed = exploded.groupBy(*keys).agg(ordered.alias("_all"), F.first("_reach").alias("_reach"))
    taken = F.slice("_all", F.lit(1), F.col("_reach") * GRAM + 1)
    return listed.select(*keys, F.explode(F.transform(taken, lambda g: g["gram"])).alias("_gram"))


def place_names(
    received: DataFrame,
    reference: DataFrame,
    name_col: str,
    id_col: str,
    within: str | None = None,
    most_edits: int = MOST_EDITS,
    margin: int = MARGIN,
) -> DataFrame:
    """(name, [within], id, edits, outcome): what each different name of ``received`` stands for.

    Both frames have the name and, if given, a column ``within`` in which names are compared, such
    as the province of a department; ``reference`` has the id. Names are normalised first.

    - ``equal``: a reference has this name, and no other id does (``edits`` 0).
    - ``placed``: exactly one id is within reach (``most_edits``, one per ``LETTERS_PER_EDIT`` letters, and only
      as far as the grams can tell), and none other within ``margin`` - 1 edits more.
    - ``ambiguous``: others are about as near; ``unknown``: nothing is within reach. Both have no id.

    NULL and empty names are left out, and so is a NULL ``within``. Repeated rows of an id count once.
    """
    block = [within] if within else []
    keys = [*block, "name"]
    farthest = most_edits + margin - 1

    def named(df: DataFrame, *more: str) -> DataFrame:
        found = df.select(*block, *more, normalize_text(F.col(name_col)).alias("name"))
        return found.where("name <> ''").dropna(subset=[*block, *more]).distinct()

    known = named(reference, id_col).groupBy(*keys).agg(F.min(id_col).alias("_id"), F.count(F.lit(1)).alias("_ids"))
    names = named(received).join(known, keys, "left")
    is_one = F.col("_ids") == 1
    equal = names.where("_ids is not null").select(
        *keys,
        F.when(is_one, F.col("_id")).alias(id_col),
        F.lit(0).alias("edits"),
        F.when(is_one, "equal").otherwise("ambiguous").alias("outcome"),
    )

    listed = known.withColumn("_grams", grams(F.col("name")))
    uses = listed.select(F.explode("_grams").alias("_gram")).groupBy("_gram").agg(F.count(F.lit(1)).alias("_uses"))
    others = names.where("_ids is null").select(*keys).withColumn("_grams", grams(F.col("name")))
    told = F.expr(f"(size(_grams) - 1) div {GRAM}") - (margin - 1)
    given = F.expr(f"char_length(name) div {LETTERS_PER_EDIT}")
    others = others.withColumn("_most", F.greatest(F.least(F.lit(most_edits), told, given), F.lit(0)).cast("int"))
    open_ = others.where("_most > 0")
    looked_up = _rarest(open_.withColumn("_reach", F.col("_most") + (margin - 1)), [*keys, "_most"], uses, F.col("_reach"))
    index = _rarest(listed, [*keys, "_id", "_ids"], uses, F.lit(farthest)).withColumnRenamed("name", "_like")
    pairs = looked_up.join(index, [*block, "_gram"]).select(*keys, "_most", "_like", "_id", "_ids")
    near = (
        pairs.where(F.abs(F.char_length("name") - F.char_length("_like")) <= farthest)
        .distinct()
        .withColumn("_edits", F.levenshtein("name", "_like", farthest))
        .where(F.col("_edits") >= 0)
    )
    # At most farthest + 1 sums per name, however many names are near it.
    at = [F.coalesce(F.sum(F.when(F.col("_edits") == d, F.col("_ids"))), F.lit(0)).alias(f"_at{d}") for d in range(farthest + 1)]
    tallied = near.groupBy(*keys, "_most").agg(F.min("_edits").alias("_best"), F.min_by("_id", "_edits").alias("_id"), *at)
    rivals = sum(
        (F.when(F.col("_best") + (margin - 1) >= d, F.col(f"_at{d}")).otherwise(0) for d in range(farthest + 1)), F.lit(0)
    )
    outcome = F.when(F.col("_best") > F.col("_most"), "unknown").when(rivals == 1, "placed").otherwise("ambiguous")
    judged = tallied.withColumn("outcome", outcome).select(
        *keys,
        F.when(F.col("outcome") == "placed", F.col("_id")).alias("_found"),
        F.when(F.col("outcome") != "unknown", F.col("_best")).alias("edits"),
        "outcome",
    )
    guessed = others.select(*keys).join(judged, keys, "left").select(
        *keys, F.col("_found").alias(id_col), "edits", F.coalesce("outcome", F.lit("unknown")).alias("outcome")
    )
    return equal.unionByName(guessed).select("name", *block, id_col, "edits", "outcome")


def place_rows(
    rows: DataFrame,
    reference: DataFrame,
    name_col: str,
    id_col: str,
    within: str | None = None,
    most_edits: int = MOST_EDITS,
    margin: int = MARGIN,
) -> DataFrame:
    """All rows with a NULL ``id_col`` filled from their name where ``place_names`` finds it; ids that are there stay.

    The column ``outcome`` says how: ``given``, one of those of ``place_names``, or ``no name``. ``rows`` are read
    twice: once for their different names, once to be filled.
    """
    without = rows.where(F.col(id_col).isNull())
    found = place_names(without, reference, name_col, id_col, within, most_edits, margin).select(
        F.col("name").alias("_name"),
        *([F.col(within).alias("_within")] if within else []),
        F.col(id_col).alias("_found"),
        F.col("outcome").alias("_outcome"),
    )
    # A row that needs no name gets no key, so it meets nothing in the join.
    keyed = rows.withColumn("_key", F.when(F.col(id_col).isNull(), normalize_text(F.col(name_col))))
    on = keyed["_key"] == found["_name"]
    if within:
        on &= keyed[within] == found["_within"]
    outcome = F.when(F.col(id_col).isNotNull(), "given").otherwise(F.coalesce("_outcome", F.lit("no name")))
    return keyed.join(found, on, "left").select(
        *[F.coalesce(c, F.col("_found")).alias(c) if c == id_col else F.col(c) for c in rows.columns],
        outcome.alias("outcome"),
    )
