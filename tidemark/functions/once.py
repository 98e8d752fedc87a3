"""Expressions that are computed once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame) -> DataFrame:
    """``df``, its columns being values from here on: the optimizer doesn't copy their expressions into each later use, as it does when it merges projections."""
    return df.select(F.inline(F.array(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))
