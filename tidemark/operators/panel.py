"""Daily counts, calendar-complete panels and their quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stats import pearson, shock_threshold


def by_day() -> WindowSpec:
    """Series have a row a day, so a window over one is bounded by the calendar, whatever the volume of events."""
    return W.orderBy("d")


def daily(events: DataFrame, day: Column, **counts: Column) -> DataFrame:
    """Rows per day for which each condition holds; days of no event are missing. One partial aggregation, one shuffle of a row per day and task."""
    return events.groupBy(day.cast("date").alias("d")).agg(*[F.count_if(c).alias(n) for n, c in counts.items()]).where("d IS NOT NULL")


def grid(series: DataFrame) -> DataFrame:
    """Every day from the first to the last."""
    return series.agg(F.min("d").alias("a"), F.max("d").alias("b")).where("a IS NOT NULL").select(F.explode(F.sequence("a", "b")).alias("d"))


def densify(series: DataFrame) -> DataFrame:
    """The calendar-complete series: missing days are 0 and not ``observed``."""
    values = [c for c in series.columns if c != "d"]
    return grid(series).join(series.withColumn("observed", F.lit(True)), "d", "left").select("d", F.coalesce("observed", F.lit(False)).alias("observed"), *[F.coalesce(c, F.lit(0)).alias(c) for c in values])


def adjusted(panel: DataFrame, crisis: str = "crisis", outcome: str = "outcome", control: str = "control") -> DataFrame:
    """Adds ``density`` of controls and the outcome discounted by it."""
    density = F.col(control) / F.greatest(F.lit(1), F.col(crisis) + F.col(outcome))
    return panel.withColumn("density", density).withColumn("adj", F.col(outcome) / (1 + F.greatest(F.lit(0.0), F.col("density"))))


def cross_fill(facts: DataFrame, days: DataFrame, dim: str, value: str) -> DataFrame:
    """Counts for every day and every value of ``dim``, a fixed list such as topics or regions; 0 where there are none."""
    dims = facts.groupBy(dim).agg(F.collect_set("d").alias("_")).select(dim)
    return days.crossJoin(dims).join(facts, ["d", dim], "left").withColumn(value, F.coalesce(value, F.lit(0)))


def max_missing_streak(series: DataFrame) -> DataFrame:
    gap = F.datediff("d", F.lag("d").over(by_day())) - 1
    return series.select(gap.alias("gap")).agg(F.coalesce(F.max("gap"), F.lit(0)).cast("long").alias("max_missing_streak"))


def progress(series: DataFrame, min_days: int = 180, min_shocks: int = 12, crisis: str = "crisis") -> DataFrame:
    """How far a panel is from its targets, as one row."""
    thr = series.agg(shock_threshold(F.col(crisis)).alias("threshold"))
    s = series.join(F.broadcast(thr)).agg(F.min("d").alias("first"), F.max("d").alias("last"), F.count("*").alias("observed_days"), F.max("threshold").alias("threshold"), F.count_if(F.col(crisis) >= F.col("threshold")).alias("shock_days"))  # one row
    s = s.withColumn("span_days", (F.datediff("last", "first") + 1).cast("long")).crossJoin(max_missing_streak(series))
    left_d, left_s = F.greatest(F.lit(0), F.lit(min_days) - F.col("observed_days")), F.greatest(F.lit(0), F.lit(min_shocks) - F.col("shock_days"))
    s = s.withColumns({"missing_days": F.col("span_days") - F.col("observed_days"), "observed_ratio": F.round(F.col("observed_days") / F.col("span_days"), 6), "remaining_days": left_d, "remaining_shocks": left_s})
    return s.withColumns({"earliest": F.date_add("last", F.greatest("remaining_days", "remaining_shocks").cast("int")), "progress": F.round(F.least(F.lit(1.0), F.col("observed_days") / min_days, F.col("shock_days") / min_shocks), 6)})


def dual_review(a: DataFrame, b: DataFrame, min_overlap: int = 30) -> DataFrame:
    """Agreement of the crisis and outcome series of two policies, over the days that both have."""
    side = lambda df, s: df.select("d", F.col("crisis").alias(f"c{s}"), F.col("outcome").alias(f"o{s}"))
    j = side(a, 1).join(side(b, 2), "d")
    thr = j.agg(shock_threshold(F.col("c1")).alias("t1"), shock_threshold(F.col("c2")).alias("t2"))
    rel = lambda x, y: F.round(F.sum(F.abs(F.col(x) - F.col(y))) / F.sum(F.greatest(F.lit(1.0), (F.col(x) + F.col(y)) / 2)), 6)
    agree = F.avg(((F.col("c1") >= F.col("t1")) == (F.col("c2") >= F.col("t2"))).cast("double"))
    out = j.join(F.broadcast(thr)).agg(F.count("*").alias("overlap_days"), F.round(F.avg(F.abs(F.col("c1") - F.col("c2"))), 6).alias("mean_abs_delta"), rel("c1", "c2").alias("crisis_delta"), rel("o1", "o2").alias("outcome_delta"), F.round(pearson(F.col("c1"), F.col("c2")), 6).alias("correlation"), F.round(agree, 6).alias("shock_agreement"))  # one row
    return out.withColumn("stable", (F.col("overlap_days") >= min_overlap) & (F.col("shock_agreement") >= 0.7) & (F.col("crisis_delta") <= 0.6) & (F.col("outcome_delta") <= 0.6))
