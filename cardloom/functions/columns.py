"""Columns beside a user's own: names that are free, and values that are computed once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unused(df: DataFrame, name: str) -> str:
    """``name``, behind as many underscores as it takes for ``df`` not to have it, in any letter case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def bound(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` and columns that are computed once for each row, however often they are used above.

    Filters and projections are not substituted into a generator, so that long expressions don't
    multiply where the next ones are built on them.
    """
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(name) for name, c in columns.items())))))
