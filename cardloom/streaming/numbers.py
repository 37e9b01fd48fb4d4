"""Identity numbers as a stream: the batch expressions, row by row, without state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardloom.functions import nid


def validated(stream: DataFrame, column: str = "number", as_of: str = "2026-01-01") -> DataFrame:
    """The stream with ``validation`` and ``decoded``; it needs no watermark, and appends."""
    return nid.with_decoded(stream, column, F.lit(as_of).cast("date"))
