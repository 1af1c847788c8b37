"""JSON arrays of strings held in text columns.

A text that is not a well-formed JSON array counts as absent. NULL and ``[]`` stay distinct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}

# An array of nothing but JSON strings, which is nearly every stored value.
_ITEM = r'"(?:[^"\\]|\\.)*+"'
_STRINGS_ONLY = rf"(?s)^\s*\[\s*(?:{_ITEM}\s*(?:,\s*{_ITEM}\s*)*+)?\]\s*$"


def _parse(text: Column, element: str) -> Column:
    # The JSON reader stops after the first complete value. What follows one breaks the text either
    # as a field of an object or as the only element of an array: no separator suits both.
    field = F.concat(F.lit('{"v":'), text, F.lit("}"))
    only = F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<array<string>>", _STRICT)
    closed = F.rtrim(text, F.lit(" \t\r\n")).endswith("]")
    return F.when(closed & (F.size(only) == 1), F.from_json(field, f"v array<{element}>", _STRICT)["v"])


def parse_json_array(text: Column, default: Column | None = None) -> Column:
    """Array of strings, or ``default`` (NULL) when absent or unreadable; other scalars become text."""
    plain = F.from_json(text, "array<string>", _STRICT)
    parsed = F.when(text.rlike(_STRINGS_ONLY), plain).otherwise(_parse(text, "string"))
    return parsed if default is None else F.coalesce(parsed, default)


def parse_string_items(text: Column) -> Column:
    """As :func:`parse_json_array`, keeping only the elements that are JSON strings."""
    mixed = F.filter(_parse(text, "variant"), lambda v: F.schema_of_variant(v) == "STRING")
    strings = F.transform(mixed, lambda v: v.cast("string"))
    return F.when(text.rlike(_STRINGS_ONLY), F.from_json(text, "array<string>", _STRICT)).otherwise(strings)


def empty_array() -> Column:
    return F.array().cast("array<string>")


def is_array(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.ArrayType)


def as_array(df: DataFrame, name: str) -> Column:
    """The column as an array, whether it is stored as JSON text or as an array already."""
    return F.col(name) if is_array(df, name) else parse_json_array(F.col(name))


def as_label_set(df: DataFrame, name: str) -> Column:
    """The column as a set of strings: other element types dropped, duplicates collapsed."""
    items = F.array_compact(name) if is_array(df, name) else parse_string_items(F.col(name))
    return F.array_distinct(items)


def explode_labels(df: DataFrame, name: str, alias: str, *keep: str) -> DataFrame:
    """One row per element, null elements left out; an absent or empty array gives no row."""
    return df.select(*keep, F.explode(as_array(df, name)).alias(alias)).where(F.col(alias).isNotNull())
