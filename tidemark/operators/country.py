"""Country controls: feeds of each country as daily counts on a whole grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.readers import feed_items

#: Entries of a feed at most, and the days of a grid without a panel.
MOST_ENTRIES, FALLBACK_DAYS = 120, 3650


def country_entries(payloads: DataFrame, zone: str, payload: str = "payload") -> DataFrame:
    """``country, source, title, description, d``: the first MOST_ENTRIES entries of each payload that have a title and a date of their own, the latter in the local time ``zone`` where it names a zone."""
    e = feed_items(payloads, payload, MOST_ENTRIES, chars=None)
    zoned = F.coalesce(F.col("raw_date"), F.lit("")).rlike(r"(Z|[A-Z]{2,4}|[+-]\d\d:?\d\d)\s*$")
    local = F.convert_timezone(F.current_timezone(), F.lit(zone), F.col("published_at").cast("timestamp_ntz"))
    day = F.to_date(F.when(zoned, local).otherwise(F.col("published_at").cast("timestamp_ntz")))
    return e.select("country", "source", "title", "description", day.alias("d")).where("d IS NOT NULL")


def grid_window(panel: DataFrame, today: Column, lookback: int = 0, date: str = "date") -> DataFrame:
    """One row ``oldest, newest, why``: the days back from today, else the panel's own, up to today at least, else FALLBACK_DAYS."""
    own = panel.agg(F.min(date).alias("a"), F.max(date).alias("b"))
    if lookback > 0:
        return own.select(F.date_sub(today, lookback).alias("oldest"), today.alias("newest"), F.lit(f"lookback_days={lookback}").alias("why"))
    known = F.col("a").isNotNull()
    return own.select(F.when(known, F.col("a")).otherwise(F.date_sub(today, FALLBACK_DAYS)).alias("oldest"), F.when(known, F.greatest(today, F.col("b"))).otherwise(today).alias("newest"), F.when(known, "auto_from_causal_panel").otherwise(f"fallback_lookback_days={FALLBACK_DAYS}").alias("why"))


def country_controls(entries: DataFrame, countries: DataFrame, window: DataFrame, ufo: list[str], policy: list[str], crisis: list[str]) -> DataFrame:
    """``d, country, ufo_policy_news, crisis_index`` for each day of ``window`` and each of ``countries (country)``: entries that name both a sighting and a policy, and those of a crisis; 0 where there are none."""
    body = F.lower(F.concat_ws(" ", T.normalize(F.col("title")), T.normalize(F.col("description"))))
    found = entries.withColumn("_f", T.found_keywords(body, sorted({*ufo, *policy, *crisis})))
    counts = found.groupBy("d", "country").agg(F.count_if(T.any_of(F.col("_f"), ufo) & T.any_of(F.col("_f"), policy)).alias("ufo_policy_news"), F.count_if(T.any_of(F.col("_f"), crisis)).alias("crisis_index"))
    grid = window.select(F.explode(F.sequence("oldest", "newest")).alias("d")).crossJoin(F.broadcast(countries.select("country").distinct()))  # days by configured countries
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return grid.join(counts, ["d", "country"], "left").select("d", "country", zero("ufo_policy_news"), zero("crisis_index"))


def country_status(sources: DataFrame, fetched: bool = True) -> DataFrame:
    """One row ``sources, failed_sources, status, reason`` of ``sources (country, source, status)``."""
    c = sources.agg(F.count("*").alias("sources"), F.count_if(F.col("status") == "failed").alias("failed_sources"))
    n, bad = F.col("sources"), F.col("failed_sources")
    status = F.when(n == 0, "blocked").when(F.lit(fetched) & (bad > 0) & (bad < n), "partial_failed").otherwise("ok")
    reason = F.when(n == 0, "no_active_country_sources").when(~F.lit(fetched), "offline_zero_filled_grid").when(bad == n, "all_country_sources_failed_zero_filled_grid").when(bad > 0, "updated_with_partial_failures_zero_filled_grid").otherwise("updated_zero_filled_full_date_grid")
    return c.select("*", status.alias("status"), reason.alias("reason"))
