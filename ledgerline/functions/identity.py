"""Deterministic identifiers: a short digest over a compact ASCII JSON array."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerline.schemas import SCOPE

# Fixed value: hexadecimal digits of the digest that are kept.
DIGEST_LENGTH = 24


@dataclass(frozen=True)
class Json:
    """A part that already is a JSON fragment (number, array, literal)."""

    fragment: Column


def _escape_char(c: Column) -> Column:
    units = F.lower(F.hex(F.encode(c, "UTF-16BE")))
    return (
        F.when(c == '"', F.lit('\\"'))
        .when(c == "\\", F.lit("\\\\"))
        .when(c == "\n", F.lit("\\n"))
        .when(c == "\r", F.lit("\\r"))
        .when(c == "\t", F.lit("\\t"))
        .when(c == "\b", F.lit("\\b"))
        .when(c == "\f", F.lit("\\f"))
        .when(c.rlike("^[ -~]$"), c)
        .otherwise(F.regexp_replace(units, "(.{4})", r"\\u$1"))
    )


# Anything JSON has to escape: quotes, backslashes and all but printable ASCII.
_SPECIAL = r'["\\]|[^ -~]'


def json_text(value: Column) -> Column:
    """JSON string with every non-ASCII character escaped; null becomes the JSON null."""
    escaped = F.array_join(F.transform(F.split(value, ""), _escape_char), "")
    body = F.when(value.rlike(_SPECIAL), escaped).otherwise(value)
    return F.coalesce(F.concat(F.lit('"'), body, F.lit('"')), F.lit("null"))


def json_ids(values: Column) -> Column:
    """JSON array of strings; the usual plain identifiers are only joined."""
    special = F.array_join(values, "").rlike(_SPECIAL)
    listed = F.when(special, F.array_join(F.transform(values, json_text), ",")).otherwise(
        F.concat(F.lit('"'), F.array_join(values, '","'), F.lit('"'))
    )
    return F.when(F.size(values) == 0, "[]").otherwise(F.concat(F.lit("["), listed, F.lit("]")))


def stable_id(namespace: str, *parts: Column | Json) -> Column:
    """`namespace:` plus the leading digest digits of [namespace, *parts]."""
    fragments = [p.fragment if isinstance(p, Json) else json_text(p) for p in parts]
    separated = [x for fragment in fragments for x in (F.lit(","), fragment)]
    payload = F.concat(F.lit(f'["{namespace}"'), *separated, F.lit("]"))
    return F.concat(F.lit(f"{namespace}:"), F.substring(F.sha2(payload, 256), 1, DIGEST_LENGTH))


def quoted(value: Column) -> Column:
    """Text quoted the way a record's printed form quotes it."""
    escaped = value
    for raw, shown in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        escaped = F.replace(escaped, F.lit(raw), F.lit(shown))
    single = F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("\\'")), F.lit("'"))
    double = F.concat(F.lit('"'), escaped, F.lit('"'))
    return F.when(value.contains("'") & ~value.contains('"'), double).otherwise(single)


def scope_text(prefix: str = "") -> Column:
    """Printed form of a scope, the form in which it enters identifiers."""
    # Fixed value: record name and field order of the printed form.
    fields = []
    for name in SCOPE:
        fields += [F.lit(f"{', ' if fields else ''}{name}="), quoted(F.col(prefix + name))]
    return F.concat(F.lit("StateScope("), *fields, F.lit(")"))
