"""JSON functions over variants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def decode(text: Column) -> Column:
    """The value of a JSON text as a variant, which tells a JSON null from a missing value; raises if malformed."""
    return F.parse_json(text)


def try_decode(text: Column) -> Column:
    return F.try_parse_json(text)


def get(value: Column, path: str, kind: str = "string") -> Column:
    """The value at a path such as $.a[0], null where it is missing or of another kind."""
    return F.try_variant_get(value, path, kind)


def is_null(value: Column) -> Column:
    """Whether the value is the JSON null."""
    return F.is_variant_null(value)


def encode(value: Column) -> Column:
    """JSON text of a struct, array, map or variant."""
    return F.to_json(value)
