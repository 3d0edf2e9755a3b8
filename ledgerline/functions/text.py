"""Text folding and canonical renderings, all as native column expressions."""

from __future__ import annotations

import sys
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


# White space of any kind, as members of a character class.
WHITE = r"\s\p{Z}\x1C-\x1F\x85"


@lru_cache(maxsize=1)
def _fold_exceptions() -> str:
    """Characters whose full case folding differs from their lower case, as "c=folded;" text."""
    return ";".join(
        f"{chr(point)}={chr(point).casefold()}"
        for point in range(128, sys.maxunicode + 1)
        if chr(point).casefold() != chr(point).lower()
    )


def _is_ascii(value: Column) -> Column:
    return F.octet_length(value) == F.char_length(value)


def casefold(value: Column) -> Column:
    """Unicode case folding; plain ASCII takes the short way through lower()."""
    table = F.str_to_map(F.lit(_fold_exceptions()), F.lit(";"), F.lit("="))
    folded = F.array_join(
        F.transform(F.split(value, ""), lambda c: F.coalesce(F.try_element_at(table, c), F.lower(c))),
        "",
    )
    return F.when(_is_ascii(value), F.lower(value)).otherwise(folded)


def normalize_identifier(value: Column) -> Column:
    """Case-folded letters and numbers only."""
    plain = F.regexp_replace(F.lower(value), "[^a-z0-9]", "")
    return F.when(_is_ascii(value), plain).otherwise(F.regexp_replace(casefold(value), r"[^\p{L}\p{N}]", ""))


def normalize_question(value: Column) -> Column:
    """Case-folded, hyphens as spaces, runs of white space collapsed."""
    spaced = F.regexp_replace(F.replace(casefold(value), F.lit("-"), F.lit(" ")), rf"[{WHITE}]+", " ")
    return F.trim(spaced)


def is_blank(value: Column) -> Column:
    """Null, empty or white space of any kind."""
    return value.isNull() | ~value.rlike(f"[^{WHITE}]")


def decimal_text(value: Column) -> Column:
    """Decimal without exponent and without trailing zeros."""
    text = value.cast("string")
    stripped = F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")
    return F.when(text.contains("."), stripped).otherwise(text)


# Digits of a quantity or price: before the point, and after it.
WHOLE_DIGITS, DECIMALS = 12, 6
_NUMBER = r"^([+-]?)([0-9]*)\.?([0-9]*)(?:[eE]([+-]?[0-9]{1,6}))?$"


def number_parts(value: Column) -> Column:
    """A number in text as struct (negative, digits, scale) without leading and trailing zeros; null if it is no number.

    It is worth digits / 10^scale, with an empty text of digits for zero. Exponents count, and nothing is rounded.
    """
    text = F.trim(value)
    part = [F.regexp_extract(text, _NUMBER, i) for i in range(5)]
    digits = F.ltrim(F.concat(part[2], part[3]), F.lit("0"))
    kept = F.rtrim(digits, F.lit("0"))
    exponent = F.when(part[4] == "", 0).otherwise(part[4].try_cast("int"))
    scale = F.length(part[3]) - exponent - (F.length(digits) - F.length(kept))
    parts = F.struct(
        (part[1] == "-").alias("negative"), kept.alias("digits"), F.when(kept == "", 0).otherwise(scale).alias("scale")
    )
    return F.when(text.rlike(_NUMBER) & (F.concat(part[2], part[3]) != ""), parts)


def fits(parts: Column) -> Column:
    """Whether a number has its exact place in a quantity or price."""
    return (parts["scale"] <= DECIMALS) & (F.length(parts["digits"]) - parts["scale"] <= WHOLE_DIGITS)


def has_exact_place(value: Column) -> Column:
    """`fits` of a number in text; plain ones are told by a single look, others are taken apart."""
    return F.when(value.rlike(rf"^[+-]?[0-9]{{1,{WHOLE_DIGITS}}}(\.[0-9]{{0,{DECIMALS}}})?$"), True).otherwise(fits(number_parts(value)))


def instant_text(value: Column) -> Column:
    """ISO 8601 in UTC; microseconds appear only when they are not zero.

    The session zone is pinned to UTC, so both timestamp types render the same instant.
    """
    seconds = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(value, "SSSSSS")
    return F.concat(
        seconds, F.when(micros == "000000", F.lit("")).otherwise(F.concat(F.lit("."), micros)), F.lit("+00:00")
    )
