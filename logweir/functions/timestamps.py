"""Timestamp columns: reading log timestamps, printing index timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The accepted shapes, date and time in one-or-two-digit fields.
_WITH_T = r"T\d{1,2}:\d{1,2}:\d{1,2}(\.\d{1,6}Z?)?"
_WITH_BLANK = r"\s+\d{1,2}:\d{1,2}:\d{1,2}([.,]\d{1,6})?"
LOG_TIMESTAMP = rf"^\d{{4}}-\d{{1,2}}-\d{{1,2}}({_WITH_T}|{_WITH_BLANK})\z"
INDEX_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSZ"


def log_timestamp(text: Column) -> Column:
    """Timestamp of an accepted text, else NULL; offsets do not exist, wall clock is kept.

    One shape test, then a cast: the cast returns NULL on impossible dates
    without the exceptions that a chain of format attempts would throw per row.
    """
    plain = F.regexp_replace(F.translate(text, ",Z", "."), r"\s+", " ")
    return F.when(text.rlike(LOG_TIMESTAMP), plain.try_cast("timestamp"))


def index_timestamp(ts: Column) -> Column:
    """``2024-01-01T00:00:07.179+0000``: milliseconds cut, session zone UTC."""
    return F.date_format(ts, INDEX_FORMAT)


def index_timestamp_text(text: Column, now: Column) -> Column:
    """Index text of an ISO timestamp text; unreadable text becomes ``now``.

    An offset in the text is dropped: the wall clock is printed as UTC.
    """
    wall = F.regexp_replace(text, r"(Z|[+-]\d{2}:?\d{2}(:?\d{2})?)\z", "")
    iso = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}([.,]\d{1,6})?)?)?)?\z"
    hours = F.regexp_replace(F.translate(wall, ",", "."), r"^(\S{10}[T ]\d{2})\z", "$1:00")
    read = F.when(wall.rlike(iso), hours.try_cast("timestamp"))
    return index_timestamp(F.coalesce(read, now))


def token_date(token: Column) -> Column:
    """Date meant by a search token: ``yyyyMMdd``, ISO date or ISO date-time, else NULL."""
    compact = F.regexp_replace(token, r"^(\d{4})(\d{2})(\d{2})\z", "$1-$2-$3")
    iso = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?)?\z"
    zone_free = F.regexp_replace(compact, r"(Z|[+-]\d{2}:?\d{2})\z", "")
    candidate = F.when(compact.rlike(iso), compact).when(zone_free.rlike(iso), zone_free)
    return candidate.try_cast("timestamp")
