"""Events: items of one claim, and events of one signature, brought together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import shared_table


def rank_of(order: str = "ord") -> Column:
    """Greater is better: score, weight, a timestamp, a feed, a longer title; of equals the first seen."""
    return F.struct(F.col("final_score").alias("a"), F.col("weight").alias("b"), F.col("published_at").isNotNull().cast("int").alias("c"), (F.col("source_type") == "rss").cast("int").alias("d"), F.length("title").alias("e"), (-F.col(order)).alias("f"))


def timeline(entries: str, most: int = 24) -> Column:
    """Distinct reports, those with timestamps first, then by date, weight and source."""
    key = lambda e: F.struct(e["published_at"].isNull().alias("a"), e["published_at"].alias("b"), e["date"].isNull().alias("c"), e["date"].alias("d"), (-e["weight"]).alias("e"), e["source"].alias("f"), e["url"].alias("g"), e.alias("h"))
    return F.slice(F.transform(F.array_sort(F.transform(F.col(entries), key)), lambda k: k["h"]), 1, most)


#: The columns of a report.
REPORT = ("source", "date", "published_at", "url", "weight", "source_type")


def report_order() -> list[Column]:
    """The order of a timeline."""
    return [F.col("published_at").isNull(), F.col("published_at"), F.col("date").isNull(), F.col("date"), -F.col("weight"), F.col("source"), F.col("url"), F.col("source_type")]


def first_of(rows: DataFrame, keys: list[str], order: list, most: int) -> DataFrame:
    """The first rows of each key. Every task keeps that many at most before the shuffle, so a hot key stays small."""
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= most).drop("_r")


#: The columns of a claim's best item; the description may be missing.
BEST = ("ord", "source", "title", "date", "final_score", "url", "description")


def collapse_claims(items: DataFrame, most_urls: int = 12, most_reports: int = 24) -> DataFrame:
    """An event per claim: its best item, all its sources and domains sorted, the earliest URLs, the timeline.

    Sources and domains are made distinct by aggregation before they are listed, and of URLs and reports only those
    listed are gathered, so a claim that a third of all items make is no task of its own.
    """
    keys = ["category", "fingerprint"]
    items = shared_table(items, "claim-items")
    g = items.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in BEST if c in items.columns]), rank_of()).alias("best"), F.count("*").alias("cluster_size"))
    listed = lambda c, name, most=None: (lambda d: (first_of(d, keys, [c], most) if most else d).groupBy(*keys).agg(F.array_sort(F.collect_list(c)).alias(name)))(items.where(F.coalesce(F.col(c), F.lit("")) != "").select(*keys, c).distinct())
    reports = first_of(items.select(*keys, *REPORT).distinct(), keys, report_order(), most_reports).groupBy(*keys).agg(F.collect_list(F.struct(*REPORT)).alias("reports"))
    out = g.join(listed("source", "sources"), keys, "left").join(listed("domain", "domains"), keys, "left").join(listed("url", "urls", most_urls), keys, "left").join(reports, keys, "left")
    empty = lambda c: F.coalesce(c, F.array().cast("array<string>")).alias(c)
    return out.select(*keys, "best.*", empty("sources"), empty("domains"), F.coalesce("urls", F.array().cast("array<string>")).alias("evidence_urls"), timeline("reports", most_reports).alias("timeline"), "cluster_size", (F.size(F.coalesce("sources", F.array().cast("array<string>"))) > 1).alias("multi_source"))


def lag_metrics(events: DataFrame) -> DataFrame:
    """Adds who reported first: official and media days and timestamps, the lag in days and hours, and its basis."""
    official = lambda e: T.is_official(e["source"])
    rss = F.exists("timeline", lambda e: ~official(e) & (e["source_type"] == "rss"))
    media = lambda e: ~official(e) & (~rss | (e["source_type"] == "rss"))
    least = lambda who, field: F.array_min(F.transform(F.filter("timeline", who), lambda e: e[field]))
    df = events.withColumns({"official_day": least(official, "date"), "media_day": least(media, "date"), "official_at": least(official, "published_at"), "media_at": least(media, "published_at"), "official_reports": F.size(F.filter("timeline", official)), "media_reports": F.size(F.filter("timeline", media))})
    both = F.col("official_at").isNotNull() & F.col("media_at").isNotNull()
    hours = F.round((F.unix_timestamp("media_at") - F.unix_timestamp("official_at")) / 3600, 3)
    days = F.datediff("media_day", "official_day")
    return df.withColumns({"lag_days": days, "lag_hours": F.when(both, hours), "lag_basis": F.when(both, "timestamp").when(days.isNotNull(), "date").otherwise("none")})


def lead_reason(event: None = None) -> Column:
    """Why an event does or doesn't count as led by an official source."""
    lag, hours = F.col("lag_days"), F.col("lag_hours")
    return F.when((F.col("official_reports") == 0) & (F.col("media_reports") == 0), "no_reports").when(F.col("official_reports") == 0, "no_official_report").when(F.col("media_reports") == 0, "no_media_report").when(lag.isNull(), "missing_dates").when(hours > 0, "strict_official_lead").when(hours == 0, "same_time").when(hours < 0, "media_lead").when(lag > 0, "official_lead_by_date").when(lag == 0, "same_day").otherwise("media_lead")


def lead_diagnostics(events: DataFrame) -> DataFrame:
    """``events`` with lags, as from :func:`lag_metrics`, with ``reason, lead_day, lead_strict`` and ``place``: their order, strict leads first, then leads by day, longer lags, larger claims and earlier dates."""
    lag, hours = F.col("lag_days"), F.col("lag_hours")
    day, strict = F.coalesce(lag >= 0, F.lit(False)), F.coalesce((lag > 0) | ((lag == 0) & (hours > 0)), F.lit(False))
    df = events.withColumns({"reason": lead_reason(), "lead_day": day, "lead_strict": strict})
    order = F.struct((~F.col("lead_strict")).alias("a"), (~F.col("lead_day")).alias("b"), F.coalesce(-lag, F.lit(999)).alias("c"), (-F.col("cluster_size")).alias("d"), F.coalesce(F.col("date").cast("string"), F.lit("")).alias("e"), F.col("fingerprint").alias("f"))
    return df.withColumn("place", order)


def lead_summary(diagnostics: DataFrame) -> DataFrame:
    """One row: events, those with official and media reports, with lags in days and hours, and leads by day and strictly."""
    return diagnostics.agg(F.count("*").alias("events"), F.count_if(F.col("official_reports") > 0).alias("with_official"), F.count_if(F.col("media_reports") > 0).alias("with_media"), F.count("lag_days").alias("with_lag_days"), F.count("lag_hours").alias("with_lag_hours"), F.count_if("lead_day").alias("lead_day"), F.count_if("lead_strict").alias("lead_strict"))


def merge_by_signature(events: DataFrame, signature: Column, most_urls: int, most_reports: int) -> DataFrame:
    """Events of one signature as one: the best of them, their lists in order of first sight, sums of sizes. Events without a signature stay alone.

    Values are made distinct by aggregation before they are listed, and of URLs and reports only those listed are gathered.
    """
    df = shared_table(events.withColumn("sig", F.coalesce(signature, F.concat(F.lit("solo:"), F.col("fingerprint")))), "signed-events")
    g = df.groupBy("sig").agg(F.max_by(F.struct("ord", "title", "date", "final_score"), F.struct("final_score", "cluster_size", -F.col("ord"))).alias("best"), F.count("*").alias("merged_claims"), F.sum("cluster_size").alias("cluster_size"))

    def listed(c: str, most: int | None = None) -> DataFrame:
        seen = df.select("sig", "ord", F.posexplode(c).alias("p", "x")).groupBy("sig", "x").agg(F.min(F.struct("ord", "p")).alias("at"))
        seen = first_of(seen, ["sig"], [F.col("at")], most) if most else seen
        return seen.groupBy("sig").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias(c))

    reports = first_of(df.select("sig", F.explode("timeline").alias("r")).select("sig", "r.*").distinct(), ["sig"], report_order(), most_reports)
    reports = reports.groupBy("sig").agg(F.collect_list(F.struct(*REPORT)).alias("reports"))
    out = g.join(listed("sources"), "sig", "left").join(listed("evidence_urls", most_urls), "sig", "left").join(reports, "sig", "left")
    empty = lambda c: F.coalesce(c, F.array().cast("array<string>")).alias(c)
    return out.select("sig", "best.*", empty("sources"), empty("evidence_urls"), timeline("reports", most_reports).alias("timeline"), "merged_claims", "cluster_size")
