"""Text clean-up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character a JavaScript ``trim`` strips; Spark's own default strips spaces only.
_WHITE = (
    " \t\n\x0b\x0c\r\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)


def strip_white(text: Column) -> Column:
    return F.trim(text, F.lit(_WHITE))


def normalize_tags(tags: Column) -> Column:
    """JSON text of the tags, lower-cased and stripped; ``[]`` when there is no array."""
    cleaned = F.transform(tags, lambda t: strip_white(F.lower(t)))
    return F.coalesce(F.to_json(cleaned), F.lit("[]"))


def blank_to_null(text: Column) -> Column:
    return F.when(text != "", text)


def zero_to_null(number: Column) -> Column:
    return F.when(number != 0, number)


def whole_number(value: Column) -> Column:
    """INT of a number or a numeric text; NULL for anything else, fractions included."""
    number = value.cast("string").try_cast("double")
    return F.when(number == F.floor(number), number.try_cast("int"))


def model_input(title: Column, summary: Column) -> Column:
    """Text handed to the second classifier."""
    return strip_white(F.concat(title, F.lit(". "), F.coalesce(summary, F.lit(""))))
