from ledgerline.functions.identity import Json, json_ids, json_text, scope_text, stable_id
from ledgerline.functions.text import casefold, decimal_text, fits, has_exact_place, instant_text, is_blank, normalize_identifier, number_parts

__all__ = [
    "Json",
    "casefold",
    "decimal_text",
    "fits",
    "has_exact_place",
    "instant_text",
    "is_blank",
    "json_ids",
    "json_text",
    "normalize_identifier",
    "number_parts",
    "scope_text",
    "stable_id",
]
