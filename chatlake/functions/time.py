"""Time expressions over epoch seconds, all in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400
# Names of the time frames and their length in days.
FRAMES = {"week": 7, "month": 30, "year": 365, "2years": 730}


def at(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


def day(seconds: Column) -> Column:
    return F.date_format(at(seconds), "yyyy-MM-dd")


def sunday_first(seconds: Column) -> Column:
    """Day of the week with Sunday 0."""
    return F.dayofweek(at(seconds)) - 1


def monday_week(seconds: Column) -> Column:
    """Year and week, weeks starting on Monday, days before the first Monday in week 00."""
    d = at(seconds)
    week = F.floor((F.dayofyear(d) - 1 + 7 - F.weekday(d)) / 7)
    return F.concat(F.date_format(d, "yyyy"), F.lit("-W"), F.lpad(week.cast("string"), 2, "0"))


def period(seconds: Column, unit: str) -> Column:
    """Label of the hour, day, week or month."""
    if unit == "week":
        return monday_week(seconds)
    formats = {"hour": "yyyy-MM-dd HH:00", "day": "yyyy-MM-dd", "month": "yyyy-MM"}
    return F.date_format(at(seconds), formats[unit])


def timeframe(now: int, frame: str | None) -> tuple[int, int]:
    """Closed interval of a named time frame; "a,b" gives its own bounds; anything else is all time up to now."""
    today = now - now % DAY
    if frame == "today":
        return today, now
    if frame == "yesterday":
        return today - DAY, today
    if frame in FRAMES:
        return now - FRAMES[frame] * DAY, now
    parts = (frame or "").split(",")
    if len(parts) == 2 and all(p.strip().lstrip("-").isdigit() for p in parts):
        return int(parts[0]), int(parts[1])
    return 0, now


def parsed(text: Column) -> Column:
    """Timestamp of export-local date text in either spelling; null if it is neither."""
    clean = F.regexp_replace(text, "Z$", "")
    return F.coalesce(F.try_to_timestamp(clean, F.lit("yyyy-MM-dd'T'HH:mm:ss")), F.try_to_timestamp(F.substring(clean, 1, 19), F.lit("yyyy-MM-dd HH:mm:ss")))
