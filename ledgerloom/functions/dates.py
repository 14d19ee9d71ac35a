"""Column functions on dates as statements write them; times are epoch seconds, UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How statements write dates and times, in the order in which they are tried: a pattern, then the groups of year, month, day.
FORMATS = [
    (r"^(\d{1,2})/(\d{1,2})/(\d{4})(?: (\d{1,2}):(\d{1,2})(?::(\d{1,2}))?)?$", (3, 2, 1)),
    (r"^(\d{4})-(\d{1,2})-(\d{1,2})(?: (\d{1,2}):(\d{1,2}):(\d{1,2}))?$", (1, 2, 3)),
    (r"^(\d{1,2})-(\d{1,2})-(\d{4})(?: (\d{1,2}):(\d{1,2}):(\d{1,2}))?$", (3, 2, 1)),
    (r"^(\d{2})(\d{2})(\d{2})$", (1, 2, 3)),
    (r"^(\d{4})(\d{2})(\d{2})$", (1, 2, 3)),
]


def day_seconds(year: Column, month: Column, day: Column) -> Column:
    """Epoch seconds of midnight; null for a day that does not exist. Two-digit years up to 68 are of this century."""
    full = F.when(F.length(year) == 2, F.concat(F.when(year.cast("int") <= 68, "20").otherwise("19"), year)).otherwise(year)
    return F.unix_date(F.concat_ws("-", full, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")).try_cast("date")).cast("long") * 86_400


def parse_date(text: Column) -> Column:
    """Epoch seconds by the first of FORMATS that gives an existing time, else null."""
    clean, tries = F.trim(text), []
    for pattern, ymd in FORMATS:
        day = day_seconds(*[F.regexp_extract(clean, pattern, g) for g in ymd])
        clock = [F.coalesce(F.nullif(F.regexp_extract(clean, pattern, g), F.lit("")).cast("int"), F.lit(0)) for g in (4, 5, 6)] if "\\d{1,2}):" in pattern else [F.lit(0)] * 3
        fits = clean.rlike(pattern) & (clock[0] < 24) & (clock[1] < 60) & (clock[2] < 60)
        tries.append(F.when(fits, day + clock[0] * 3600 + clock[1] * 60 + clock[2]))
    return F.coalesce(*tries)


def parse_loose(text: Column) -> Column:
    """parse_date, or a number: days since 1899-12-30 below 100000, epoch milliseconds from 10**11 on, epoch seconds between; else null."""
    number = F.when(F.trim(text).rlike(r"^\d{1,5}(\.\d+)?$|^\d{9,15}$"), F.trim(text).cast("double"))
    serial = F.floor((number - 25_569) * 86_400 + 0.5)
    return F.coalesce(F.when(number < 100_000, serial).when(number >= 1e11, F.floor(number / 1000)).otherwise(number).cast("long"), parse_date(text))


def effective(value_date: Column, booked: Column) -> Column:
    """The value date where it is stated and positive, else when the line was booked."""
    return F.when(value_date > 0, value_date).otherwise(booked)


def valid_at(now: Column, since: Column, until: Column) -> Column:
    """Whether since <= now < until; a missing end is open."""
    return (since.isNull() | (since <= now)) & (until.isNull() | (now < until))


def expired(created: Column, seconds: int, now: Column) -> Column:
    return now > created + seconds


def mt940_dates(tag61: Column) -> tuple[Column, Column]:
    """(value date, entry date or null) as epoch seconds from the body of a :61: line: yymmdd and an optional mmdd of the same year."""
    year, month, day = (F.substring(tag61, at, 2) for at in (1, 3, 5))
    entry = F.regexp_extract(tag61, r"^\d{6}(\d{2})(\d{2})", 1), F.regexp_extract(tag61, r"^\d{6}(\d{2})(\d{2})", 2)
    return day_seconds(year, month, day), F.when(entry[0] != "", day_seconds(year, *entry))
