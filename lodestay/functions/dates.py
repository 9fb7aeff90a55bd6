"""Dates, ages and service hours in free text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]


def month_of(text: Column, names: list[str] = MONTHS) -> Column:
    """Month of ``D.M``, else of the first name in ``names`` that occurs. An impossible ``D.M`` gives null at once."""
    pattern = r"(?<!\d)(\d{1,2})[./](\d{1,2})(?!\d)"
    written = F.regexp_extract(text, pattern, 2)
    number = F.when(written != "", written.cast("int"))
    named = F.lit(None).cast("int")
    for i, name in reversed(list(enumerate(names, 1))):
        named = F.when(F.contains(F.lower(text), F.lit(name)), i).otherwise(named)
    return F.when(number.isNotNull(), F.when(number.between(1, 12), number)).otherwise(named)


def entry_dates(text: Column) -> Column:
    """Distinct ``DD.MM`` of all possible dates in the text, in their order, comma-separated; null without any."""
    found = F.regexp_extract_all(text, F.lit(r"(?<!\d)\d{1,2}[./]\d{1,2}(?!\d)"), F.lit(0))
    parts = F.transform(found, lambda d: F.split(d, "[./]"))
    fits = F.filter(parts, lambda p: p[0].cast("int").between(1, 31) & p[1].cast("int").between(1, 12))
    dates = F.array_distinct(F.transform(fits, lambda p: F.concat(F.lpad(p[0], 2, "0"), F.lit("."), F.lpad(p[1], 2, "0"))))
    return F.when(F.size(dates) > 0, F.array_join(dates, ", "))


def age_hours(text: Column) -> Column:
    """Hours of ``5 min``, ``3 h``, ``2 d``, ``1 w`` or these words in full; null for anything else."""
    pattern = r"(?i)^\s*(\d+)\s*(m|min|mins|minutes?|h|hrs?|hours?|d|days?|w|weeks?)(?![\p{L}\d])"
    number = F.regexp_extract(text, pattern, 1)
    unit = F.lower(F.substring(F.regexp_extract(text, pattern, 2), 1, 1))
    hours = F.when(unit == "m", 1 / 60).when(unit == "h", 1.0).when(unit == "d", 24.0).when(unit == "w", 168.0)
    return F.when(number != "", number.cast("double")) * hours


def age_passes(hours: Column, most: float = 24.0) -> Column:
    """Whether a post is young enough; an unknown age passes."""
    return F.coalesce(hours < most, F.lit(True))


def quota_day(ts: Column, begins: int = 10) -> Column:
    """The day of a quota that begins at ``begins`` o'clock."""
    return F.to_date(ts - F.make_dt_interval(hours=F.lit(begins)))


def service_hour(time: Column) -> Column:
    """Hour of day of a timetable's ``HH:MM:SS``, whose hours run past 24 after midnight."""
    return F.pmod(F.substring_index(time, ":", 1).cast("int"), F.lit(24))


def service_active(day_flag: Column, end_date: Column, today: Column) -> Column:
    """Whether a service runs: its weekday flag is 1 and it has not ended; an end that is no date passes."""
    ends = F.try_to_date(end_date, "yyyyMMdd")
    return (day_flag == 1) & F.coalesce(ends >= today, F.lit(True))
