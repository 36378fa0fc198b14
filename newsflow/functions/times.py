"""Publication times, durations and time-zone-free conversions."""

import re

from pyspark.sql import Column, functions as F

_UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}


def seconds(duration: str) -> int:
    """Length of a duration such as ``"20 minutes"`` in seconds."""
    match = re.fullmatch(r"\s*(\d+)\s+(second|minute|hour|day)s?\s*", duration)
    if not match or int(match[1]) == 0:
        raise ValueError(f"not a positive duration: {duration!r}")
    return int(match[1]) * _UNITS[match[2]]


def shift(c: Column, n: int) -> Column:
    """``n`` seconds of elapsed time after (or, below zero, before) a time, with or without
    a zone. The days of an interval would be added as calendar days of the session's zone,
    so it is added in parts shorter than a day."""
    part = 12 * 3600
    sign, rest = (1, n) if n >= 0 else (-1, -n)
    while rest:
        step = min(rest, part)
        c = c + F.expr(f"INTERVAL '{sign * step}' SECOND")
        rest -= step
    return c


def parse_published(c: Column) -> Column:
    """``Mon Jan 01 10:00:00 UTC 2024`` to TIMESTAMP, null when it does not parse.

    Leaves the session's parser policy alone: the weekday is cut off, since the
    current parser rejects it, and is not checked against the date.
    """
    return F.try_to_timestamp(
        F.regexp_replace(c, r"^\w{3} ", ""), F.lit("MMM d HH:mm:ss z yyyy")
    )


def parse_feed_date(c: Column) -> Column:
    """RSS ``Mon, 01 Jan 2024 10:00:00 GMT`` or ISO-8601 (Atom, RDF) to TIMESTAMP, null when
    it does not parse."""
    body = F.regexp_replace(F.trim(c), r"^\w{3},\s*", "")
    return F.coalesce(
        F.try_to_timestamp(body, F.lit("d MMM yyyy HH:mm:ss z")),
        F.try_to_timestamp(body, F.lit("d MMM yyyy HH:mm:ss Z")),
        F.try_to_timestamp(F.when(body.rlike(r"^\d{4}-"), body)),
    )


def parse_iso(c: Column) -> Column:
    """ISO-8601 text to TIMESTAMP, null when it does not parse."""
    return F.try_to_timestamp(c)


def to_utc_ntz(c: Column) -> Column:
    """TIMESTAMP to its UTC wall-clock time, whatever the session zone is."""
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), c.cast("timestamp_ntz"))
