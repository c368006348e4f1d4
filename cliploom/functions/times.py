"""Clock, bucket and range helpers. Times of day are those of Asia/Seoul (UTC+9, no daylight saving)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MINUTE = 60_000_000
HOUR = 60 * MINUTE


def micros(ts: Column) -> Column:
    """Epoch microseconds of a timestamp without zone, which is taken as UTC whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def activity_day(ts: Column) -> Column:
    """Day that starts at 07:00 in Seoul, which is 22:00 UTC of the day before."""
    return F.to_date(ts + F.expr("INTERVAL 2 HOURS"))


def seoul_day(ts: Column) -> Column:
    return F.to_date(ts + F.expr("INTERVAL 9 HOURS"))


def seoul_clock(ts: Column) -> Column:
    """HH:mm in Seoul."""
    return F.date_format(ts + F.expr("INTERVAL 9 HOURS"), "HH:mm")


def clock_between(clock: Column, first: str, last: str) -> Column:
    """Closed range of times of day; a first after the last spans midnight."""
    return clock.between(first, last) if first <= last else (clock >= first) | (clock <= last)


def two_hour_bucket(ts: Column) -> Column:
    return F.floor(F.hour(ts + F.expr("INTERVAL 9 HOURS")) / 2)


def displayed_seconds(seconds: Column) -> Column:
    """Half a second counts as a whole one, also below zero."""
    return F.floor(seconds + 0.5).cast("int")


def backoff(us: Column, attempt: Column) -> Column:
    """One minute, doubled with each attempt."""
    return us + F.lit(MINUTE) * F.pow(F.lit(2), attempt).cast("long")


def gap_bin(gap: Column) -> Column:
    return F.when(gap <= 30, "short").when(gap <= 60, "medium").otherwise("long")


def day_start_us(day: Column) -> Column:
    """Epoch microseconds at which an activity day begins: 22:00 UTC of the date before."""
    return F.datediff(day, F.lit("1970-01-01").cast("date")).cast("long") * (24 * HOUR) - 2 * HOUR


def closed_day(now: Column) -> Column:
    """The last activity day that is over."""
    return F.date_sub(activity_day(now), 1)


def preset_ranges(now: Column) -> Column:
    """Array of (preset, from, to): ranges of Seoul days, both ends inside."""
    today = seoul_day(now)
    spans = {"today": (0, 0), "yesterday": (1, 1), "last3": (2, 0), "last7": (6, 0)}
    return F.array(*[F.struct(F.lit(name).alias("preset"), F.date_sub(today, a).alias("from"), F.date_sub(today, b).alias("to")) for name, (a, b) in spans.items()])


ZONED = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:\d{2})$"
NAIVE = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?$"


def aware_us(text: Column) -> Column:
    """Epoch microseconds of a text with a zone; null without one, and for what is no time."""
    return F.when(text.rlike(ZONED), F.unix_micros(text.try_cast("timestamp")))


def lenient_us(text: Column) -> Column:
    """Like aware_us(), but a text without a zone is UTC."""
    return aware_us(F.when(text.rlike(NAIVE), F.concat(text, F.lit("Z"))).otherwise(text))
