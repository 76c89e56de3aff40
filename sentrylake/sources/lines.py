"""Cutting a log file down to the lines of interest."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, functions as F


def lines_of_date(lines: DataFrame, day: str, column: str = "value") -> DataFrame:
    """Lines that start with the date text."""
    return lines.filter(F.startswith(F.col(column), F.lit(day)))


def lines_with_keyword(lines: DataFrame, keyword: str, column: str = "value") -> DataFrame:
    """Lines that contain the keyword in any letter case."""
    return lines.filter(F.contains(F.lower(F.col(column)), F.lit(keyword.lower())))


def lines_in_range(lines: DataFrame, start: str, end: str, column: str = "value") -> DataFrame:
    """Lines whose first token is a date in [start, end]; other lines are skipped."""
    token = F.split(F.trim(F.col(column)), r"\s+", 2)[0]
    day = F.when(
        token.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.to_date(F.try_to_timestamp(token, F.lit("yyyy-M-d")))
    )
    return lines.filter(day.between(F.lit(date.fromisoformat(start)), F.lit(date.fromisoformat(end))))


def write_lines(lines: DataFrame, folder: str, name: str, column: str = "value") -> str:
    """Write the lines as text below ``folder``; blanks in the name become ``_``."""
    path = f"{folder.rstrip('/')}/{name.replace(' ', '_')}"
    lines.select(F.col(column).alias("value")).write.mode("overwrite").text(path)
    return path
