"""Keeping an expensive expression from being computed several times per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def with_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed exactly once per row.

    A filter on a computed column is pushed below the projection and computes it again, once per
    mention. Filters on the output of a generator stay above it, so the columns are generated from
    an array of one struct.
    """
    one = F.array(F.struct(*[column.alias(name) for name, column in columns.items()]))
    return df.select("*", F.inline(one))
