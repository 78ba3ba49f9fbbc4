"""Derived columns that are worked out once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def once(df: DataFrame, keep: list[str] | None = None, **columns: Column) -> DataFrame:
    """Add columns through an `inline` of one row.

    Filters and projections on the new columns stay above it. Pushed through a plain projection they would repeat its
    expressions at each use, which multiplies over several steps.
    """
    made = F.struct(*[column.alias(name) for name, column in columns.items()])
    return df.select(*(df.columns if keep is None else keep), F.inline(F.array(made)))
