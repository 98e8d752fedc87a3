"""Catalogs under a lock, runs chosen for replay, days by source, news in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def signatures(entries: DataFrame, name: str = "name", day: str = "d") -> DataFrame:
    """``name, n_dates, signature`` of each catalog: the SHA-256 of its canonical payload, keys in order and no blanks. A catalog has a day at most once, so it is bounded by the calendar."""
    days = F.array_sort(F.collect_set(F.date_format(day, "yyyy-MM-dd")))
    quoted = F.array_join(F.transform(days, lambda d: F.concat(F.lit('"'), d, F.lit('"'))), ",")
    payload = F.concat(F.lit('{"dates":['), quoted, F.lit('],"name":"'), F.col(name).cast("string"), F.lit('"}'))
    return entries.where(F.col(day).isNotNull()).groupBy(name).agg(F.size(days).alias("n_dates"), F.sha2(payload, 256).alias("signature"))


def lock_status(catalog: DataFrame, lock: DataFrame, name: str = "name") -> DataFrame:
    """Each wanted catalog of ``lock`` or ``catalog (name, signature)`` with the first reason why it fails its lock, or ok."""
    both = catalog.select(name, F.lit(True).alias("_c"), F.col("signature").alias("_cs")).join(lock.select(name, F.lit(True).alias("_l"), F.col("signature").alias("_ls")), name, "full")
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    why = F.when(F.col("_c").isNull(), "catalog_missing").when(F.col("_l").isNull(), "lock_missing").when(blank("_cs"), "catalog_signature_missing").when(blank("_ls"), "lock_signature_missing").when(F.col("_cs") != F.col("_ls"), "signature_mismatch").otherwise("ok")
    return both.select(name, why.alias("status"))


def runs_for_replay(runs: DataFrame, last: int = 1, run_id: str | None = None) -> DataFrame:
    """The run of that id; else the last runs (by ``ord``) that had failed chunks, one at least."""
    if run_id is not None:
        return runs.where(F.col("run_id") == run_id).orderBy("ord").limit(1)
    return runs.where(F.coalesce("failed_chunks", F.lit(0)) > 0).orderBy(F.col("ord").desc()).limit(max(1, last))


def day_sources(ranges: DataFrame) -> DataFrame:
    """``query, d, source``: each day of ``ranges (query, start, end, source, ord)``, both ends included; the last range that covers a day names its source."""
    days = ranges.where(F.col("start") <= F.col("end")).select("query", F.explode(F.sequence("start", "end")).alias("d"), "source", "ord")
    return days.groupBy("query", "d").agg(F.max_by("source", F.struct("ord", "source")).alias("source"))


def source_modes(days: DataFrame) -> DataFrame:
    """How many days of each query came from each source."""
    return days.groupBy("query", "source").agg(F.count("*").alias("days"))


def timeline_bounds(start: Column, end: Column) -> Column:
    """A range as the timeline interface writes it."""
    return F.struct(F.concat(F.date_format(start, "yyyyMMdd"), F.lit("000000")).alias("first"), F.concat(F.date_format(end, "yyyyMMdd"), F.lit("235959")).alias("last"))


def news_order() -> list[Column]:
    """Later dates, higher scores, a timestamp, more weight first; of equals the first seen."""
    return [F.coalesce(F.col("date").cast("string"), F.lit("")).desc(), F.col("final_score").desc(), F.col("published_at").isNotNull().desc(), F.col("weight").desc(), F.col("ord")]


def in_region(region: Column) -> Column:
    return F.upper(F.trim(F.coalesce(region, F.lit("USA")))).isin("USA", "US")
