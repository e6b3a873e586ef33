"""Identifier and free-text cleaning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that mean 'true' and texts that mean 'no identifier'.
TRUE_TOKENS = ("1", "true", "yes", "y", "si", "sí")
EMPTY_TOKENS = ("", "NA", "N/A", "NONE", "NAN", "NULL", "-999")


def truthy(value: Column) -> Column:
    return F.coalesce(F.lower(F.trim(value.cast("string"))).isin(*TRUE_TOKENS), F.lit(False))


def clean_identifier(value: Column) -> Column:
    """Upper-case identifier without blanks; placeholders become NULL."""
    text = F.upper(F.trim(value.cast("string")))
    return F.when(~text.isin(*EMPTY_TOKENS), F.replace(text, F.lit(" "), F.lit("")))


def compound_parts(value: Column) -> Column:
    """The numbers hidden in an 11-digit compound key, none for any other identifier.

    Such a key is six digits (station number times ten, or a plain number) and a
    five-digit national number in which 99999 stands for none.
    """
    clean = clean_identifier(value)
    compound = clean.rlike(r"^[0-9]{11}$")
    head, tail = F.substring(clean, 1, 6), F.substring(clean, 7, 5)
    parts = F.array(
        F.when(compound, head),
        F.when(compound & (tail != "99999"), tail),
        F.when(compound & head.endswith("0"), F.substring(head, 1, 5)),
    )
    return F.array_distinct(F.array_compact(parts))


def identifier_variants(value: Column) -> Column:
    """The identifier itself and the parts hidden in it."""
    return F.array_distinct(F.array_compact(F.concat(F.array(clean_identifier(value)), compound_parts(value))))


def decimal_comma(value: Column) -> Column:
    return F.replace(F.trim(value), F.lit(","), F.lit(".")).try_cast("double")


def number_or_null(value: Column) -> Column:
    return F.trim(value).try_cast("double")


def timestamp_or_null(value: Column, pattern: str) -> Column:
    return F.try_to_timestamp(F.trim(value), F.lit(pattern)).cast("timestamp_ntz")


def file_stem(path: Column) -> Column:
    """File name without folder and extension."""
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]+)?$", 1)


def signed_fixed(value: Column, width: int = 8, digits: int = 4) -> Column:
    """Number with an explicit sign, zero padded to ``width`` characters."""
    return F.format_string(f"%+0{width}.{digits}f", value)
