"""String expressions used by the cleaning rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# Patterns that decide which rows survive cleaning.
EMAIL_PATTERN = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
NAME_PATTERN = r"^[A-Za-z\s\-]+$"

# The characters that count as whitespace at the ends of a cell.
WHITESPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(
    chr(c) for c in range(0x2000, 0x200B)
)

# Texts that the CSV reader treats as missing.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def strip(col: Column) -> Column:
    """Remove any leading or trailing whitespace (plain ``trim`` only knows spaces)."""
    return F.btrim(col, F.lit(WHITESPACE))


def na_to_null(col: Column) -> Column:
    return F.when(~col.isin(*NA_TOKENS), col)


def has_digit(col: Column) -> Column:
    return col.rlike(r"\d")


def is_email(col: Column) -> Column:
    return F.coalesce(col.rlike(EMAIL_PATTERN), F.lit(False))


def is_alphabetic_name(col: Column) -> Column:
    return F.coalesce(col.rlike(NAME_PATTERN), F.lit(False))


def number_or_null(col: Column) -> Column:
    """Tolerant numeric cast: unparseable text becomes NULL instead of an error."""
    return strip(col.cast("string")).try_cast("double")


def currency_or_null(col: Column) -> Column:
    return number_or_null(F.regexp_replace(col.cast("string"), r"[\$,]", ""))


def first_contained(col: Column, words: Sequence[str]) -> Column:
    """First of ``words`` that occurs in ``col`` ignoring case, else NULL."""
    lowered = F.lower(col)
    return F.coalesce(*[F.when(lowered.contains(w.lower()), F.lit(w)) for w in words])
