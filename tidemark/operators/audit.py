"""Audits of the sources: what each delivered and how it answered, coverage, health and what to mend."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T

#: Days that count as recent, reasons and recommendations listed, failed sources looked at for them, backups named.
FRESH_DAYS, TOP_REASONS, MOST_ADVICE, MOST_FAILED, BACKUPS = 3, 10, 12, 8, 3


def source_windows(status: DataFrame, items: DataFrame, today: Column, fresh: int = FRESH_DAYS) -> DataFrame:
    """Each source of ``status (source, status, item_count, used_fallback, ord, ...)`` with the span of its items and whether any is recent; a source without dated items has none."""
    spans = items.groupBy("source").agg(F.min("date").alias("min_date"), F.max("date").alias("max_date"))
    df = status.join(spans, "source", "left")
    return df.withColumns({"span_days": F.coalesce(F.datediff("max_date", "min_date") + 1, F.lit(0)), "has_recent_items": F.coalesce(F.col("max_date") >= F.date_sub(today, fresh), F.lit(False))})


def with_last_success(windows: DataFrame, runs: DataFrame, at: Column) -> DataFrame:
    """Adds ``last_success`` and ``failures_since`` from ``runs (source, at, status)``: the source's last run up to ``at`` that didn't fail, and how many failed after it. By sums, so a source with many runs is no sort."""
    before = runs.where(F.col("at") <= at)
    good = before.where("status <> 'failed'").groupBy("source").agg(F.max("at").alias("last_success"))
    bad = before.where("status = 'failed'").join(good, "source", "left").where("last_success IS NULL OR at > last_success")
    failed = bad.groupBy("source").agg(F.count("*").alias("failures_since"))
    return windows.join(good, "source", "left").join(failed, "source", "left").withColumn("failures_since", F.coalesce("failures_since", F.lit(0)))


def coverage(windows: DataFrame) -> DataFrame:
    """One row: sources, those that answered, those with recent items, and the confidence that shares of them give."""
    least = lambda share: F.greatest(F.lit(1), F.floor(F.col("sources_total") * share / 100))
    c = windows.agg(F.count("*").alias("sources_total"), F.count_if(F.col("status") != "failed").alias("sources_available"), F.count_if("has_recent_items").alias("sources_with_recent_items"))
    enough = lambda a, b: (F.col("sources_available") >= least(a)) & (F.col("sources_with_recent_items") >= least(b))
    return c.withColumn("coverage_confidence", F.when(enough(90, 70), "high").when(enough(75, 50), "medium").otherwise("low"))


def most_common(df: DataFrame, value: str, order: str, most: int) -> DataFrame:
    """``value, n, place`` of the most frequent values; of equals the one seen first by ``order``."""
    n = df.groupBy(value).agg(F.count("*").alias("n"), F.min(order).alias("_first"))
    top = n.orderBy(F.col("n").desc(), "_first").limit(most)
    return top.select(value, "n", F.row_number().over(W.orderBy(F.col("n").desc(), "_first")).alias("place"))  # a short list


def reject_reasons(rejected: DataFrame, most: int = TOP_REASONS) -> DataFrame:
    """The most frequent single reasons of ``rejected (ord, reason)``, whose reasons are joined by commas."""
    parts = F.filter(F.transform(F.split(F.coalesce("reason", F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    tokens = rejected.select("ord", F.posexplode(parts).alias("_k", "reason")).withColumn("ord", F.struct("ord", "_k"))
    return most_common(tokens, "reason", "ord", most)


def health(status: DataFrame) -> DataFrame:
    """One row over ``status (source, category, type, weight, status, error, used_fallback)``: how many sources answered, with items, by fallback, and the classes of errors."""
    failed = F.col("status") == "failed"
    row = status.agg(F.count("*").alias("total_active_sources"), F.count_if(~failed).alias("available_sources"), F.count_if(F.col("status") == "ok").alias("sources_with_items"), F.count_if(failed).alias("failed_sources"), F.count_if("used_fallback").alias("fallback_used_count"))
    share = lambda c: F.when(F.col("total_active_sources") > 0, F.round(F.col(c) / F.col("total_active_sources"), 4)).otherwise(0.0)
    kinds = status.where(failed).groupBy(T.error_class(F.col("error")).alias("k")).agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias("failed_error_types"))  # a row a class
    return row.withColumns({"availability_rate": share("available_sources"), "success_rate_with_items": share("sources_with_items")}).join(kinds)


def by_category(status: DataFrame) -> DataFrame:
    """Per category: active, available, with items, failed, and the trusted ones (feeds of weight 2 and more)."""
    ok, failed = F.col("status") == "ok", F.col("status") == "failed"
    trusted = F.coalesce((F.col("type") == "rss") & (F.coalesce("weight", F.lit(1)) >= 2), F.lit(False))
    return status.groupBy("category").agg(F.count("*").alias("active"), F.count_if(~failed).alias("available"), F.count_if(ok).alias("success_with_items"), F.count_if(failed).alias("failed"), F.count_if(trusted).alias("trusted_active"), F.count_if(trusted & ok).alias("trusted_success_with_items"))


def recommendations(status: DataFrame, sources: DataFrame, most: int = MOST_ADVICE) -> DataFrame:
    """``place, category, issue, source, backups``: categories with under two trusted sources that delivered, with inactive sources of most weight as backups; then failed feeds without a fallback.

    ``sources (name, category, weight, active, ord)`` are all that are configured. Only the first MOST_FAILED failed
    sources, by ``ord``, are looked at. Lists are of the length of the configuration.
    """
    rank = F.row_number().over(W.partitionBy("category").orderBy(F.coalesce("weight", F.lit(1)).desc(), "ord"))
    spare = sources.where("NOT coalesce(active, true)").withColumn("_r", rank).where(F.col("_r") <= BACKUPS)
    named = spare.groupBy("category").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "name"))), lambda x: x["name"]).alias("backups"))  # BACKUPS a category
    empty = F.array().cast("array<string>")
    low = by_category(status).where("trusted_success_with_items < 2").join(named, "category", "left").select(F.lit(0).alias("_part"), F.lit(0).cast("long").alias("_o"), "category", F.lit("trusted_source_coverage_low").alias("issue"), F.lit(None).cast("string").alias("source"), F.coalesce("backups", empty).alias("backups"))
    first = status.where("status = 'failed'").orderBy("ord").limit(MOST_FAILED)
    bare = first.where((F.col("type") == "rss") & (F.coalesce("fallback_url", F.lit("")) == "") & (F.coalesce(F.size("fallback_urls"), F.lit(0)) <= 0))
    lone = bare.select(F.lit(1).alias("_part"), F.col("ord").cast("long").alias("_o"), "category", F.lit("missing_fallback_url").alias("issue"), "source", empty.alias("backups"))
    listed = low.unionByName(lone).orderBy("_part", "_o", "category").limit(most)
    return listed.select(F.row_number().over(W.orderBy("_part", "_o", "category")).alias("place"), "category", "issue", "source", "backups")  # `most` rows
