"""Wall-clock milliseconds, buckets, daylight saving and trading sessions, as column expressions.

Times are epoch milliseconds of a clock without a zone, or TIMESTAMP_NTZ.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MINUTE, HOUR, DAY = 60_000, 3_600_000, 86_400_000


def wall_ms(ts: Column) -> Column:
    """Epoch milliseconds of a TIMESTAMP_NTZ read as UTC."""
    return F.unix_millis(F.to_utc_timestamp(ts.cast("timestamp"), F.current_timezone()))


def from_ms(ms: Column) -> Column:
    """TIMESTAMP_NTZ of wall milliseconds, whatever the session's zone."""
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=(ms / 1000).cast("decimal(18,6)"))


def bucket(ms: Column, width: int, boundary: int = 0) -> Column:
    """Start of the bucket of `width` ms that holds `ms`; `boundary` shifts the buckets. Floors below zero too."""
    return ms - F.pmod(ms - F.lit(boundary), F.lit(width))


def parse_wall(date: Column, time: Column) -> Column:
    """Milliseconds of a date (year first; dots, dashes or slashes) and a time with an optional fraction; null if malformed."""
    day = F.regexp_replace(F.trim(date), "[./]", "-")
    clock = F.regexp_extract(F.trim(time), r"^(\d{1,2}:\d{2}:\d{2})(?:\.(\d+))?$", 1)
    part = F.rpad(F.substring(F.regexp_extract(F.trim(time), r"^(\d{1,2}:\d{2}:\d{2})(?:\.(\d+))?$", 2), 1, 3), 3, "0")
    whole = F.when((clock != "") & day.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.concat_ws(" ", day, clock))
    seconds = F.try_to_timestamp(whole, F.lit("yyyy-M-d H:mm:ss"))
    return F.unix_seconds(F.to_utc_timestamp(seconds, F.current_timezone())) * 1000 + part.cast("int")


def guessed_ms(x: Column) -> Column:
    """Seconds or milliseconds, told apart by size, as milliseconds."""
    return F.when(F.abs(x) < 1e11, x * 1000).otherwise(x).cast("long")


def nth_sunday(year: Column, month: int, n: int) -> Column:
    """Date of the n-th Sunday of a month; n = -1 is the last."""
    if n > 0:
        return F.date_add(F.next_day(F.date_sub(F.make_date(year, F.lit(month), F.lit(1)), 1), "SUN"), 7 * (n - 1))
    return F.next_day(F.date_sub(F.last_day(F.make_date(year, F.lit(month), F.lit(1))), 7), "SUN")


def london_offset(ts: Column) -> Column:
    """Hours London is ahead of UTC: summer time from the last Sunday of March, 01:00, to that of October."""
    start = nth_sunday(F.year(ts), 3, -1).cast("timestamp_ntz") + F.expr("INTERVAL 1 HOUR")
    end = nth_sunday(F.year(ts), 10, -1).cast("timestamp_ntz") + F.expr("INTERVAL 1 HOUR")
    return F.when((ts >= start) & (ts < end), 1).otherwise(0)


def new_york_offset(ts: Column) -> Column:
    """Hours New York is ahead of UTC: summer time from the second Sunday of March, 07:00 UTC, to the first of November, 06:00."""
    start = nth_sunday(F.year(ts), 3, 2).cast("timestamp_ntz") + F.expr("INTERVAL 7 HOURS")
    end = nth_sunday(F.year(ts), 11, 1).cast("timestamp_ntz") + F.expr("INTERVAL 6 HOURS")
    return F.when((ts >= start) & (ts < end), -4).otherwise(-5)


def session(ts: Column) -> Column:
    """Open centres at a UTC time, joined: London 08-17 and New York 08-17 local, Tokyo 00-09 UTC; CLOSED at weekends."""
    hour = F.hour(ts)
    london = hour + london_offset(ts)
    york = F.pmod(hour + new_york_offset(ts), F.lit(24))
    weekend = F.dayofweek(ts).isin(1, 7)
    names = F.concat_ws(
        "+",
        F.when((hour >= 0) & (hour < 9), "TOKYO"),
        F.when((london >= 8) & (london < 17), "LONDON"),
        F.when((york >= 8) & (york < 17), "NEW_YORK"),
    )
    return F.when(weekend, "CLOSED").when(names == "", "OFF").otherwise(names)
