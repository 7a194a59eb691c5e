"""JSON and array helpers (ARR1, ARR2)."""

from pyspark.sql import functions as F

from versarium.functions.text import nonempty


def json_array_from_text(c, schema="array<string>"):
    """The JSON array embedded in prose, or null."""
    return F.from_json(nonempty(F.regexp_extract(c, r"(?s)\[.*\]", 0)), schema,
                       {"mode": "PERMISSIVE"})


def safe_json(c, schema):
    """Parsed JSON, or null for empty and malformed values."""
    return F.from_json(nonempty(c), schema, {"mode": "PERMISSIVE"})


def any_in(c, values):
    return F.exists(c, lambda x: x.isin(list(values)))


def first_n(c, n):
    return F.slice(c, 1, n)
