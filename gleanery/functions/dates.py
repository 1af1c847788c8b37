"""Date texts and calendar parts. Expressions assume a UTC session (``session.ensure_utc``)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip_white

ISO_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"

# Spark's lenient cast reads "T10" or "12:30" as today; only these shapes are let through.
_ISO_SHAPE = r"^\d{4}(-\d{2}(-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?\s?(Z|[+-]\d{2}:?\d{2})?)?)?)?$"
_TO_THE_MINUTE = r"^(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2})(\s?(?:Z|[+-]\d{2}:?\d{2}))$"
_MAIL_SHAPE = r"^([A-Za-z]{3,9},?\s+)?\d{1,2}\s+[A-Za-z]{3,9}\s+\d{4}"
# Month first, as in "Jan 5, 2026"; and days written with slashes, year first or month first.
_MONTH_FIRST = r"^([A-Za-z]{3})[A-Za-z]*\.?\s+(\d{1,2}),?\s+(\d{4})"
_SLASHES = {r"^\d{4}/\d{1,2}/\d{1,2}( |$)": "yyyy/M/d[ H:mm[:ss]]", r"^\d{1,2}/\d{1,2}/\d{4}( |$)": "M/d/yyyy[ H:mm[:ss]]"}

# The zone names of RFC 822 and their offsets.
_ZONES = {
    "UT": "+0000",
    "UTC": "+0000",
    "GMT": "+0000",
    "Z": "+0000",
    "EST": "-0500",
    "EDT": "-0400",
    "CST": "-0600",
    "CDT": "-0500",
    "MST": "-0700",
    "MDT": "-0600",
    "PST": "-0800",
    "PDT": "-0700",
}


def parse_iso(text: Column) -> Column:
    """TIMESTAMP of an ISO 8601 text, NULL for any other shape or an impossible date."""
    # The cast wants seconds before a zone.
    full = F.when(text.rlike(_TO_THE_MINUTE), F.regexp_replace(text, _TO_THE_MINUTE, "$1:00$2")).otherwise(text)
    return F.when(text.rlike(_ISO_SHAPE), full.try_cast("timestamp"))


def _parse_mail(text: Column) -> Column:
    # "[weekday, ]day month year[ rest]": weekday dropped, month cut to three letters.
    body = F.regexp_replace(
        text, r"^(?:[A-Za-z]{3,9},?\s+)?(\d{1,2})\s+([A-Za-z]{3})[A-Za-z]*\s+(\d{4})\s*", "$1 $2 $3 "
    )
    zones = F.create_map(*[F.lit(x) for pair in _ZONES.items() for x in pair])
    offset = F.try_element_at(zones, F.upper(F.regexp_extract(body, r" ([A-Za-z]{1,3})$", 1)))
    body = F.regexp_replace(body, r"([+-]\d{2}):(\d{2})$", "$1$2")
    numeric = F.concat(F.regexp_replace(body, r"\s*[A-Za-z]{1,3}$", " "), offset)
    return F.try_to_timestamp(F.rtrim(F.coalesce(numeric, body)), F.lit("d MMM yyyy[ H:mm[:ss]][ xx]"))


def parse_date(text: Column) -> Column:
    """TIMESTAMP of an ISO 8601, mail-style, month-first or slashed date text, NULL when unreadable.

    Texts without a zone mean UTC. Other forms that date parsers guess at (names of days alone,
    two-digit years, relative words) stay unreadable.
    """
    clean = strip_white(text)
    turned = F.regexp_replace(clean, _MONTH_FIRST, "$2 $1 $3")
    slashed = [F.when(clean.rlike(shape), F.try_to_timestamp(clean, F.lit(form))) for shape, form in _SLASHES.items()]
    return F.coalesce(parse_iso(clean), F.when(turned.rlike(_MAIL_SHAPE), _parse_mail(turned)), *slashed)


def iso_text(ts: Column) -> Column:
    """Canonical text: UTC, milliseconds, ``Z``."""
    return F.date_format(ts, ISO_FORMAT)


def normalize_date(text: Column) -> Column:
    """Any readable date text in canonical form, NULL otherwise."""
    return iso_text(parse_date(text))


def day_of(text: Column) -> Column:
    """UTC calendar day of a date text."""
    return F.to_date(parse_iso(text))


def week_of_year(day: Column) -> Column:
    """Week number 0-53, weeks starting on Monday, days before the first Monday in week 0."""
    return F.floor((F.dayofyear(day) + F.lit(6) - F.weekday(day)) / F.lit(7)).cast("int")


def day_of_week(day: Column) -> Column:
    """Sunday 0 to Saturday 6."""
    return F.dayofweek(day) - F.lit(1)


def days_between(later: Column, earlier: Column) -> Column:
    """Fractional days between two timestamps."""
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(86_400_000_000)


def calendar_day(day: str) -> dt.date:
    """The date a ``YYYY-MM-DD`` text names; only the text that this date is written as is accepted."""
    try:
        found = dt.date.fromisoformat(day)
    except ValueError:
        found = None
    if found is None or found.isoformat() != day:
        raise ValueError(f"not a day written as YYYY-MM-DD: {day!r}")
    return found


def day_bounds(day: str) -> tuple[str, str]:
    """``[day, next day)`` as texts."""
    start = calendar_day(day)
    return start.isoformat(), (start + dt.timedelta(days=1)).isoformat()


def in_day(text: Column, day: str) -> Column:
    """Day filter as a range on the stored text, so it reaches the Parquet scan."""
    start, end = day_bounds(day)
    return (text >= F.lit(start)) & (text < F.lit(end))


def moment(now: str | dt.datetime) -> Column:
    """TIMESTAMP literal of a reference instant given as ISO text or datetime (naive means UTC)."""
    if isinstance(now, dt.datetime):
        now = now if now.tzinfo else now.replace(tzinfo=dt.timezone.utc)
        now = now.isoformat()
    return F.lit(now).cast("timestamp")
