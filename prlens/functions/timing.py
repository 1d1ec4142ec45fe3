"""Time functions, as column expressions. All are for UTC sessions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400_000_000


def micros(ts: Column) -> Column:
    """Microseconds since the epoch, for timestamps with or without a zone."""
    return F.unix_micros(ts.cast("timestamp"))


def parse_strict(c: Column) -> Column:
    """A timestamp from ISO-8601 text; anything else is an error."""
    return F.to_timestamp(c)


def parse_lenient(c: Column) -> Column:
    """A timestamp from ISO-8601 text; anything else is null."""
    return F.try_to_timestamp(c)


def parse_any(c: Column) -> Column:
    """A timestamp from any of the accepted forms, tried in order; blank text is null."""
    c = F.when(F.trim(c) != "", F.trim(c))
    forms = [F.try_to_timestamp(c, F.lit(f)) for f in ("yyyy-MM-dd'T'HH:mm:ssX", "yyyy-MM-dd HH:mm:ssXXX", "yyyy-MM-dd HH:mm:ss")]
    return F.coalesce(*forms, F.try_to_timestamp(F.replace(c, F.lit("Z"), F.lit(""))))


def whole_days(earlier: Column, later: Column) -> Column:
    """Elapsed days, rounded down; not the number of midnights."""
    return F.floor((micros(later) - micros(earlier)) / F.lit(DAY)).cast("long")


def hours(earlier: Column, later: Column) -> Column:
    """Elapsed hours; null if an end is."""
    return (micros(later) - micros(earlier)) / F.lit(3.6e9)


def minutes(earlier: Column, later: Column) -> Column:
    """Elapsed minutes."""
    return (micros(later) - micros(earlier)) / F.lit(6e7)


def months(earlier: Column, later: Column) -> Column:
    """Elapsed months of 30.44 days."""
    return (micros(later) - micros(earlier)) / F.lit(30.44 * DAY)


def years(earlier: Column, later: Column) -> Column:
    """Elapsed years of 365.25 days."""
    return (micros(later) - micros(earlier)) / F.lit(365.25 * DAY)


def month(ts: Column) -> Column:
    """``YYYY-MM``."""
    return F.date_format(ts, "yyyy-MM")


def iso(ts: Column) -> Column:
    """ISO-8601 with a numeric offset."""
    return F.date_format(ts.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ssxxx")


def is_friday(ts: Column) -> Column:
    """Whether the day is a Friday."""
    return F.weekday(ts) == 4


def humanised(h: Column) -> Column:
    """Hours as ``1.5h``, or as days from 24 hours on."""
    return F.when(h >= 24, F.format_string("%.1fd", h / 24)).otherwise(F.format_string("%.1fh", h))
