"""Calendar parts as 64-bit integers, and whole-day differences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# English day names, the week starting on Sunday.
DAY_NAMES = ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")


def year(ts: str) -> Column:
    return F.year(ts).cast("bigint")


def month(ts: str) -> Column:
    return F.month(ts).cast("bigint")


def hour(ts: str) -> Column:
    return F.hour(ts).cast("bigint")


def day_number(ts: str) -> Column:
    """1 for Sunday up to 7 for Saturday."""
    return F.dayofweek(ts).cast("bigint")


def day_name(number: str) -> Column:
    """Full day name for a day number; no time zone takes part."""
    return F.element_at(F.array(*[F.lit(n) for n in DAY_NAMES]), F.col(number).cast("int"))


def days_between(end: Column | str, start: Column | str) -> Column:
    """Calendar days from start to end; the time of day does not count."""
    return F.datediff(end, start).cast("bigint")
