"""Lenient conversions and the event flags. Nothing here fails on bad input: it becomes null."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, functions as F

# day, separator, month, year of four or two digits, and optionally hour, minute, second, AM/PM
DAY_FIRST = (
    r"^(\d{1,2})([/.-])(\d{1,2})\2(\d{4}|\d{2})(?:\s+(\d{1,2}):(\d{2})(?::(\d{2}(?:\.\d{1,6})?))?\s*([AaPp][Mm])?)?$"
)
NAMED_MONTH = r"^(\d{1,2})[-/ ]([A-Za-z]{3})[A-Za-z]*[-/ ](\d{4}|\d{2})\b"
COMPACT = r"^(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(\d{2}(?:\.\d+)?)(Z|[+-]\d{2}:?\d{2})?$"
MONTHS = ["JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC"]
UNITS = {"s": 1e6, "ms": 1e3, "us": 1.0, "ns": 1e-3}  # microseconds
CENTURY = 69  # two-digit years from here on are of the 1900s


def number(value: Column) -> Column:
    """Number or null."""
    return value.cast("string").try_cast("double")


def integer(value: Column) -> Column:
    """Integer or null; ``4444.0`` counts as 4444."""
    return number(value).try_cast("int")


def utc_time(value: Column, unit: str | None = None) -> Column:
    """ISO text (dates also with slashes, or without any marks) to a UTC timestamp.

    A bare number is a time only where its source says in which ``unit`` it counts from 1970 (s, ms, us or ns):
    the size of a number does not tell.
    """
    text = F.trim(value.cast("string"))
    iso = F.when(text.rlike(r"^\d{4}-"), text).when(
        text.rlike(r"^\d{4}/\d{1,2}/\d{1,2}\b"), F.regexp_replace(text, r"^(\d{4})/(\d{1,2})/", "$1-$2-")
    ).when(text.rlike(COMPACT), F.regexp_replace(text, COMPACT, "$1-$2-$3T$4:$5:$6$7"))
    time = iso.try_cast("timestamp")
    if unit is None:
        return time
    micros = F.round(number(text) * F.lit(UNITS[unit])).try_cast("bigint")
    return F.coalesce(time, F.when(text.rlike(r"^-?\d+(\.\d*)?([eE][+-]?\d+)?$"), F.timestamp_micros(micros)))


def month_number(name: Column) -> Column:
    """1 to 12 by the first three letters of a month's name in any case, 0 for other texts."""
    return F.array_position(F.array(*map(F.lit, MONTHS)), F.upper(name))


def day_first_time(value: Column, unit: str | None = None) -> Column:
    """As ``utc_time``; all other texts are read day-first, or month-first if there is no such month.

    One pattern splits all layouts into their parts, which are put together in ISO order: trying
    layouts one after the other would raise and catch an error for each that does not fit. Month names
    are put as numbers first.
    """
    text = F.trim(value.cast("string"))
    name = F.regexp_extract(text, NAMED_MONTH, 2)
    month = month_number(name).cast("string")
    text = F.when(name == "", text).otherwise(
        F.regexp_replace(text, F.lit(NAMED_MONTH), F.concat(F.lit("$1/"), month, F.lit("/$3")))
    )
    groups = "\n".join(f"${i}" for i in (1, 3, 4, 5, 6, 7, 8))
    parts = F.split(F.regexp_replace(text, DAY_FIRST, groups), "\n")

    def put_together(part: Column) -> Column:
        month_first = part[1].try_cast("int") > 12
        short = part[2].try_cast("int")
        year = F.when(F.length(part[2]) == 2, (short + F.when(short < CENTURY, 2000).otherwise(1900)).cast("string")).otherwise(part[2])
        hour, half = part[3], F.lower(part[6])
        hour = F.when(half == "", F.when(hour == "", "0").otherwise(hour)).otherwise(
            hour.try_cast("int") % 12 + F.when(half == "pm", 12).otherwise(0)
        )
        day = [year, F.when(month_first, part[0]).otherwise(part[1]), F.when(month_first, part[1]).otherwise(part[0])]
        clock = [hour, F.when(part[4] == "", "0").otherwise(part[4]), F.when(part[5] == "", "0").otherwise(part[5])]
        return F.when(
            F.size(part) == 7, F.concat_ws(" ", F.concat_ws("-", *day), F.concat_ws(":", *clock)).try_cast("timestamp")
        )

    # the one-element transform names the parts, so that they are split only once
    other = F.transform(F.array(parts), put_together)[0]
    return F.coalesce(utc_time(value, unit), other)


def syslog_time(month: Column, day: Column, clock: Column, year: int | Column, tz: str = "UTC") -> Column:
    """Syslog has no year: add the given one, read as local time of ``tz``, return UTC."""
    year = year if isinstance(year, Column) else F.lit(year)
    text = F.concat_ws(" ", year.cast("string"), F.initcap(F.lower(month)), day, clock)
    return F.to_utc_timestamp(F.try_to_timestamp(text, F.lit("yyyy MMM d HH:mm:ss")), tz)


def micros(moment: dt.datetime) -> int:
    """Microseconds since 1970; a time without zone is UTC."""
    moment = moment if moment.tzinfo else moment.replace(tzinfo=dt.timezone.utc)
    return (moment - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)) // dt.timedelta(microseconds=1)


def is_true(condition: Column) -> Column:
    """1 where the condition holds, 0 where it is false or null."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def login_failed(code: Column, outcome: Column) -> Column:
    return is_true(F.coalesce(code == "4625", F.lit(False)) | (F.lower(outcome) == "failure"))


def conn_suspicious(port: Column, outcome: Column) -> Column:
    return is_true(F.coalesce(number(port) == 4444, F.lit(False)) | (outcome == "S0"))


def risk_level(score: Column, high: float = 0.95, medium: float = 0.85) -> Column:
    return F.when(score >= high, "HIGH").when(score >= medium, "MEDIUM").otherwise("LOW")
