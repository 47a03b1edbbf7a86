"""Column functions. All are built from Spark's own functions, none is a Python UDF."""

from comarca.functions.dates import founding_year, parse_date
from comarca.functions.ids import compose_id, standardize_id
from comarca.functions.measures import log10_safe, per_thousand
from comarca.functions.numbers import parse_integer
from comarca.functions.text import email_domain, email_domains, normalize_text, regex_clean, strip

__all__ = [
    "compose_id",
    "email_domain",
    "email_domains",
    "founding_year",
    "log10_safe",
    "normalize_text",
    "parse_date",
    "parse_integer",
    "per_thousand",
    "regex_clean",
    "standardize_id",
    "strip",
]
