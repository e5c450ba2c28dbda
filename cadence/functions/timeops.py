"""Time-zone bucketing shared by every operator (and by the search filter).

Plays are stored as instants.  Inside a plan we carry them as UTC wall-clock
``timestamp_ntz`` so no result depends on ``spark.sql.session.timeZone``; all
calendar buckets (day, week, month, part of day, weekday) are taken on the
listener's local wall clock, obtained with ``convert_timezone``.
"""

from __future__ import annotations

import datetime as _dt
from functools import lru_cache
from zoneinfo import available_timezones

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType, TimestampType

# Zones the Python zone database knows but the JVM rejects; treated as UTC.
_JVM_REJECTED_ZONES = {"Factory", "ROC", "localtime"}

# Part-of-day names, index = local hour div 6.
PART_NAMES = ["night", "morning", "afternoon", "evening"]

_EPOCH_NTZ = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


def check_tz(name: str | None) -> str:
    """An IANA zone name, or 'UTC' for anything unknown.

    Validation happens on the driver before the plan is built, as a junk zone
    would otherwise raise inside the executors.
    """
    return name if isinstance(name, str) and name in known_zones() else "UTC"


@lru_cache(maxsize=1)
def known_zones() -> tuple[str, ...]:
    """All zone names that a search or a listener may use (``check_tz`` and the tz
    column check): region names, without the tz database's own subfolders."""
    return tuple(sorted(z for z in available_timezones() if z not in _JVM_REJECTED_ZONES))


def to_utc_ntz(col: Column | str, dtype) -> Column:
    """Normalise a play-time column to UTC wall clock ``timestamp_ntz``.

    ``timestamp_ntz`` input is taken to be UTC already (the stored convention);
    an instant (``timestamp``) is rendered in UTC by its microseconds, so neither
    the session zone nor its repeated hour plays a part.
    """
    c = F.col(col) if isinstance(col, str) else col
    if isinstance(dtype, TimestampNTZType):
        return c
    if isinstance(dtype, TimestampType):
        return F.timestamp_add("MICROSECOND", F.unix_micros(c), F.expr(_EPOCH_NTZ))
    raise TypeError(f"play time must be a timestamp, got {dtype}")


def _tz_col(tz: str | Column) -> Column:
    return tz if isinstance(tz, Column) else F.lit(check_tz(tz))


def local_ts(col: Column | str, tz: str | Column) -> Column:
    """UTC wall clock -> the listener's wall clock (DST-aware).

    Same result as ``convert_timezone('UTC', tz, col)``, computed as
    micros -> instant -> ``from_utc_timestamp`` (a zone-rules offset lookup)
    -> micros -> wall clock, which is about twice as fast and, going through
    micros on both ends, independent of the session time zone."""
    c = F.col(col) if isinstance(col, str) else col
    if isinstance(tz, str) and check_tz(tz) == "UTC":
        return c  # UTC wall clock already
    epoch = F.expr(_EPOCH_NTZ)
    us = F.timestamp_diff("MICROSECOND", epoch, c)
    shifted = F.from_utc_timestamp(F.timestamp_micros(us), _tz_col(tz))
    return F.timestamp_add("MICROSECOND", F.unix_micros(shifted), epoch)


def local_date(col: Column | str, tz: str | Column) -> Column:
    return F.to_date(local_ts(col, tz))


def local_period(col: Column | str, tz: str | Column, period: str = "month") -> Column:
    """First local day of the ISO week (Monday) or month; anything but 'week'
    means month, as the reference whitelists it."""
    unit = "week" if period == "week" else "month"
    return F.trunc(local_date(col, tz), unit)


def part_of_day(col: Column | str, tz: str | Column) -> Column:
    """0 night, 1 morning, 2 afternoon, 3 evening: local hour div 6."""
    return F.floor(F.hour(local_ts(col, tz)) / 6).cast("int")


def weekday(col: Column | str, tz: str | Column) -> Column:
    """0 = Sunday .. 6 = Saturday (Spark's dayofweek is 1-based)."""
    return (F.dayofweek(local_ts(col, tz)) - 1).cast("int")


def utc_micros(col: str) -> Column:
    """Microseconds since the epoch of a UTC ``timestamp_ntz`` column
    (session-zone free)."""
    return F.timestamp_diff("MICROSECOND", F.expr(_EPOCH_NTZ), F.col(col))


# Fixed value: the longest range that a range picker offers.
PICKER_DAYS = 1826


def days_norm(days: int | None) -> int | None:
    """Range-picker days (F2) for a caller that offers a picker: <= 0 or None is
    all time, more than ``PICKER_DAYS`` is that.  Operators take any number."""
    return min(int(days), PICKER_DAYS) if days and int(days) > 0 else None


def since(col: Column | str, days: int | None, as_of) -> Column | None:
    """Rolling range (F1): ``col >= as_of - days``; None (all time) when ``days`` is
    None or not positive.

    ``as_of`` replaces the reference's ``now()`` so results are reproducible.
    """
    if not days or int(days) <= 0:
        return None
    if as_of is None:
        raise ValueError("as_of is required when days is set")
    c = F.col(col) if isinstance(col, str) else col
    start = as_of_ntz(as_of) - _dt.timedelta(days=int(days))
    return c >= _ntz_lit(start)


def as_of_ntz(as_of) -> _dt.datetime:
    """``as_of`` (date, datetime or ISO string) as a naive UTC datetime."""
    if isinstance(as_of, str):
        as_of = _dt.datetime.fromisoformat(as_of)
    if isinstance(as_of, _dt.datetime):
        if as_of.tzinfo is not None:
            as_of = as_of.astimezone(_dt.timezone.utc).replace(tzinfo=None)
        return as_of
    if isinstance(as_of, _dt.date):
        return _dt.datetime(as_of.year, as_of.month, as_of.day)
    raise TypeError(f"unsupported as_of {as_of!r}")


def _ntz_lit(value: _dt.datetime) -> Column:
    # string -> timestamp_ntz is session-zone free; a Python datetime literal is not
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def as_of_lit(as_of) -> Column:
    return _ntz_lit(as_of_ntz(as_of))


def valid_tz_col(tz: Column | str) -> Column:
    """A tz column with unknown zones replaced by 'UTC' (X5 for a column):
    one IN list over the known zones, planned as a hash-set lookup."""
    name = tz if isinstance(tz, str) else None
    if name is None:
        raise TypeError("valid_tz_col takes a column name")
    zones = ", ".join("'" + z.replace("'", "") + "'" for z in known_zones())
    return F.expr(f"CASE WHEN `{name}` IN ({zones}) THEN `{name}` ELSE 'UTC' END")


# SQL-text forms of the same expressions, for predicates built as one
# expression string (one call to the JVM instead of thousands).
def local_ts_sql(col: str, tz: str) -> str:
    e = _EPOCH_NTZ
    return (f"timestampadd(MICROSECOND, unix_micros(from_utc_timestamp(timestamp_micros("
            f"timestampdiff(MICROSECOND, {e}, {col})), {tz})), {e})")


def local_date_sql(col: str, tz: str) -> str:
    return f"to_date({local_ts_sql(col, tz)})"


def weekday_sql(col: str, tz: str) -> str:
    return f"CAST(dayofweek({local_ts_sql(col, tz)}) - 1 AS INT)"


def part_of_day_sql(col: str, tz: str) -> str:
    return f"CAST(floor(hour({local_ts_sql(col, tz)}) / 6) AS INT)"
