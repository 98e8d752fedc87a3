"""Sinks: JSON and CSV documents, keyed upserts, append-only logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``new`` and those rows of ``old`` whose keys it doesn't have; columns missing on a side are null."""
    return new.unionByName(old.join(new.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def append_new(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """A history with the rows of ``new`` that it doesn't hold yet."""
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def guarded_insert(old: DataFrame, new: DataFrame, failed: DataFrame, keys: list[str], count: str, source: str = "data_source", tag: str = "timeline_backfill", overwrite: bool = False, skip_zero: bool = False) -> DataFrame:
    """What a backfill does with each row of ``new``, as ``action``: rows of failed days are skipped, missing keys inserted, and only rows that an earlier backfill wrote are replaced."""
    had = old.select(*keys, F.coalesce(F.col(source), F.lit("")).alias("_source"), F.lit(True).alias("_had"))
    bad = failed.select("d").distinct().withColumn("_failed", F.lit(True))
    rows = new.join(had, keys, "left").join(bad, "d", "left")
    action = F.when(F.col("_failed"), "skip_failed").when(F.lit(skip_zero) & (F.col(count) == 0), "skip_zero").when(F.col("_had").isNull(), "insert").when(F.lit(overwrite) & F.col("_source").startswith(tag), "replace").otherwise("skip_existing")
    return rows.select(*new.columns, action.alias("action"))
