"""Text cleaning and e-mail domains."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters that count as the same name with and without accent. Combining marks,
# which a decomposed letter has behind it, have no plain letter and go.
LETTERS = {
    "a": "áàâäãå", "c": "ç", "e": "éèêë", "i": "íìîï", "n": "ñ", "o": "óòôöõ", "u": "úùûü", "y": "ýÿ",
}
ACCENTED = "".join(LETTERS.values())
PLAIN = "".join(plain * len(accented) for plain, accented in LETTERS.items())
ACCENTED, PLAIN = ACCENTED + "".join(LETTERS.values()).upper(), PLAIN + PLAIN.upper()
MARKS = "".join(map(chr, range(0x300, 0x370)))
# Fixed value: white space of registers, the no-break space included.
SPACES = " \t\r\n\f\v\u00a0"

# Fixed value: an address is recognised by what follows its '@'.
DOMAIN_PATTERN = "@([A-Za-z0-9.-]+[.][A-Za-z]{2,})"


def normalize_text(col: Column) -> Column:
    """One spelling per name: no accents, lower case, single spaces, no outer space."""
    plain = F.translate(col, ACCENTED + MARKS, PLAIN)
    return F.lower(F.trim(F.regexp_replace(plain, f"[{SPACES}]+", " ")))


def strip(col: Column) -> Column:
    """The value without outer white space of any kind."""
    return F.btrim(col, F.lit(SPACES))


def regex_clean(col: Column, pattern: str, replacement: str = "") -> Column:
    """Replace every match of ``pattern`` (Java regular expression)."""
    return F.regexp_replace(col, pattern, replacement)


def email_domain(col: Column) -> Column:
    """Domain of the first address in a value, lower case; NULL when there is none.

    Most values hold no ``@`` and are not searched for the pattern.
    """
    domain = F.lower(F.regexp_extract(col, DOMAIN_PATTERN, 1))
    return F.when(col.contains("@"), F.nullif(domain, F.lit("")))


def email_domains(col: Column) -> Column:
    """Domains of all addresses in a value, as written and in order of appearance."""
    return F.regexp_extract_all(col, F.lit(DOMAIN_PATTERN), 1)
