"""Whole tables in order, without a single task that sees them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import shared_table


def ranked(df: DataFrame, order: list[Column], place: str = "place") -> DataFrame:
    """``df`` with its ``place``, from 1, in an order over all rows: rows are dealt out by ranges, sorted in them, and each range counts on from those before it. The order should tell all rows apart."""
    # the number holds the range above its lower 33 bits, in them the place in the range
    at = shared_table(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()), "ordered")
    part, within = F.shiftright("_m", 33), F.col("_m").bitwiseAND((1 << 33) - 1)
    base, rows = 0, []
    for r in at.groupBy(part.alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect():  # a row for each range
        rows.append((r["p"], base))
        base += r["n"]
    starts = df.sparkSession.createDataFrame(rows, "_p long, _base long")
    return at.withColumn("_p", part).join(F.broadcast(starts), "_p").withColumn(place, F.col("_base") + within + 1).drop("_p", "_base", "_m")  # a row for each range
