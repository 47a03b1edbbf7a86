"""Province and department codes: text of a fixed width, never integers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from comarca.functions.text import strip


def standardize_id(col: Column, width: int) -> Column:
    """Left-pad a numeric code to ``width`` digits.

    Codes that are too long or hold anything but digits become NULL: ``lpad``
    alone would cut ``2007`` at width 2 down to the unrelated code ``20``.
    """
    text = strip(col.cast("string"))
    return F.when(text.rlike(f"^[0-9]{{1,{width}}}\\z"), F.lpad(text, width, "0"))


def compose_id(prov: Column, dep: Column) -> Column:
    """Country-wide department code from standardised parts; NULL if a part is."""
    return F.concat(prov, dep)
