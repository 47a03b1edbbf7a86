"""Founding dates."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from comarca.functions.text import strip

# The parts a numeric date format is made of, and what each can read.
DIGITS = {
    "yyyy": "[0-9]{4}",
    "MM": "[0-9]{2}",
    "M": "[0-9]{1,2}",
    "dd": "[0-9]{2}",
    "d": "[0-9]{1,2}",
}
SEPARATORS = "-/. "


def _shape(fmt: str) -> str | None:
    """Pattern of the texts a numeric date format can read; None for other formats."""
    parts = re.findall(r"y+|M+|d+|.", fmt)
    if not all(p in DIGITS or p in SEPARATORS for p in parts):
        return None
    return "^" + "".join(DIGITS.get(p) or re.escape(p) for p in parts) + "\\z"


def parse_date(col: Column, formats: Sequence[str]) -> Column:
    """Date under the first format that reads the value; NULL if none does.

    Numeric formats are only tried on texts of their shape. Trying them on all
    rows gives the same dates, but a failed parse costs far more than a match.
    """
    col, tries = strip(col), []
    for fmt in formats:
        date, shape = F.try_to_date(col, fmt), _shape(fmt)
        tries.append(F.when(col.rlike(shape), date) if shape else date)
    return F.coalesce(*tries)


def founding_year(col: Column) -> Column:
    return F.year(col).cast("bigint")
