"""Shock days: thresholds, the selection ladder, catalogs with a minimum gap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stats import shock_threshold
from .panel import by_day


def shock_ladder(series: DataFrame, catalog: DataFrame | None = None, value: str = "crisis", least: int = 5) -> DataFrame:
    """``d, threshold, source``: catalog dates in the panel's range if there are ``least``; else days at or above the 90th percentile of non-zero values, else the 75th."""
    s = series.agg(shock_threshold(F.col(value), 0.9).alias("t90"), shock_threshold(F.col(value), 0.75).alias("t75"), F.min("d").alias("lo"), F.max("d").alias("hi"))
    n = series.join(F.broadcast(s)).agg(F.count_if(F.col(value) >= F.col("t90")).alias("n90"), F.max("t90").alias("t90"), F.max("t75").alias("t75"))  # one row
    thr = n.select(F.when(F.col("n90") >= least, F.col("t90")).otherwise(F.col("t75")).alias("threshold"), F.when(F.col("n90") >= least, "p90").otherwise("p75").alias("source"))
    by_value = series.join(F.broadcast(thr)).where(F.col(value) >= F.col("threshold")).select("d", "threshold", "source")  # one row
    if catalog is None:
        return by_value
    inside = catalog.join(F.broadcast(s.select("lo", "hi")), F.col("d").between(F.col("lo"), F.col("hi"))).select("d").distinct()  # one row
    enough = inside.agg((F.count("*") >= least).alias("_ok"))
    known = inside.join(F.broadcast(enough.where("_ok"))).select("d", F.lit(None).cast("double").alias("threshold"), F.lit("catalog").alias("source"))
    return known.unionByName(by_value.join(F.broadcast(enough.where("NOT _ok"))).drop("_ok"))


def shock_days(series: DataFrame, value: str, q: float) -> DataFrame:
    """``d`` of the days at or above the threshold of a series' own values."""
    thr = series.agg(shock_threshold(F.col(value), q).alias("threshold"))
    return series.join(F.broadcast(thr)).where(F.col(value) >= F.col("threshold")).select("d")  # one row


def min_distance(days: DataFrame, shocks: DataFrame) -> DataFrame:
    """``d, distance``: days to the nearest shock on either side, 10**9 without any. Two windows, not a product."""
    marked = days.select("d").join(F.broadcast(shocks.select("d", F.col("d").alias("s"))), "d", "full")  # at most a row a day
    back = F.last("s", ignorenulls=True).over(by_day().rowsBetween(W.unboundedPreceding, 0))
    ahead = F.first("s", ignorenulls=True).over(by_day().rowsBetween(0, W.unboundedFollowing))
    out = marked.select("d", F.coalesce(F.least(F.datediff("d", back), F.datediff(ahead, "d")), F.lit(1_000_000_000)).alias("distance"))
    return out.join(days.select("d"), "d", "left_semi")


def downsample(days: DataFrame, most: int) -> DataFrame:
    """At most ``most`` of the days, evenly spread, both ends kept; the middle one for 1; all for 0 or less."""
    r = days.select("d", (F.row_number().over(by_day()) - 1).alias("i"), F.count("*").over(W.partitionBy()).alias("n"))
    if most <= 0:
        return days.select("d")
    if most == 1:
        return r.where(F.col("i") == F.floor(F.col("n") / 2)).select("d")
    at = F.explode(F.sequence(F.lit(0), F.lit(most - 1)))
    wanted = r.agg(F.max("n").alias("n")).select("n", at.alias("k")).select(F.expr(f"cast(k * (n - 1) div {most - 1} AS int)").alias("i")).distinct()
    return r.where(F.col("n") <= most).select("d").union(r.where(F.col("n") > most).join(F.broadcast(wanted), "i", "left_semi").select("d"))  # `most` rows


def _greedy(candidates: DataFrame, keys: list[str], gap: Column, order: list[Column]) -> DataFrame:
    """``candidates`` with ``kept`` and ``nearest``, by ``keys``: taken in order, each unless one within ``gap`` days was kept before; for the others the nearest kept day, the earlier of two.

    Runs of days with at most ``gap`` days from one to the next are clusters, and no choice in one touches another. So
    a fold goes over a cluster, whose kept days are further apart than the gap, and not over all days; the nearest kept
    day lies in the same cluster, and follows by two windows.
    """
    by_day_ = W.partitionBy(*keys).orderBy("d")
    apart = F.coalesce(F.datediff("d", F.lag("d").over(by_day_)) > gap, F.lit(True))
    clustered = candidates.withColumn("_new", apart.cast("int")).withColumn("_c", F.sum("_new").over(by_day_.rangeBetween(W.unboundedPreceding, W.currentRow))).drop("_new")
    ranked = clustered.withColumn("_r", F.row_number().over(W.partitionBy(*keys, "_c").orderBy(*order)))
    far = lambda kept, x: ~F.exists(kept, lambda k: F.abs(F.datediff(k["d"], x["d"])) <= x["gap"])
    fold = F.aggregate(
        F.array_sort(F.collect_list(F.struct("_r", "d", gap.alias("gap")))),
        F.array().cast("array<struct<_r: int, d: date, gap: int>>"),
        lambda kept, x: F.when(far(kept, x), F.concat(kept, F.array(x))).otherwise(kept),
    )
    kept = ranked.groupBy(*keys, "_c").agg(F.transform(fold, lambda k: k["_r"]).alias("_k"))
    flagged = ranked.join(kept, [*keys, "_c"]).withColumn("kept", F.array_contains("_k", F.col("_r")))
    in_cluster, mark = W.partitionBy(*keys, "_c").orderBy("d"), F.when(F.col("kept"), F.col("d"))
    flagged = flagged.withColumns({"_a": F.max(mark).over(in_cluster.rangeBetween(W.unboundedPreceding, W.currentRow)), "_b": F.min(mark).over(in_cluster.rangeBetween(W.currentRow, W.unboundedFollowing))})
    back_first = F.col("_b").isNull() | (F.datediff("d", "_a") <= F.datediff("_b", "d"))
    return flagged.withColumn("nearest", F.when(~F.col("kept"), F.when(back_first, F.col("_a")).otherwise(F.col("_b")))).drop("_c", "_r", "_k", "_a", "_b")


def spaced(candidates: DataFrame, gap: int, order: list[Column], most: int | None = None, group: list[str] | None = None) -> DataFrame:
    """``candidates`` with ``kept``: taken in order, each unless one within ``gap`` days was kept before, ``most`` at most in a group. Of several rows of a day the first in order stands for it."""
    keys = group or []
    out = _greedy(candidates, keys, F.lit(gap), order).drop("nearest")
    if most is None:
        return out
    # what comes after the last one allowed changes nothing before it, so the limit cuts the full choice
    place = F.row_number().over(W.partitionBy(*keys).orderBy(F.col("kept").desc(), *order))
    return out.withColumn("_n", place).withColumn("kept", F.col("kept") & (F.col("_n") <= most)).drop("_n")


def auto_candidates(dense: DataFrame, manual: DataFrame, value: str = "crisis", q: float = 0.99, gap: int = 21, radius: int = 14, most: int = 80) -> DataFrame:
    """Peaks of a series as shock candidates: at or above a percentile of the non-zero values, locally highest, away from manual dates and from one another."""
    from .windows import local_peaks

    thr = dense.agg(F.coalesce(F.percentile(F.when(F.col(value) > 0, F.col(value).cast("double")), q), F.lit(0.0)).alias("thr"))
    near = manual.select(F.explode(F.sequence(F.date_sub("d", radius), F.date_add("d", radius))).alias("d")).distinct()
    peaks = local_peaks(dense, value).where("peak").join(F.broadcast(thr)).where(F.col(value) >= F.col("thr")).join(near, "d", "left_anti")  # one row
    return spaced(peaks.select("d", value), gap, [F.col(value).desc(), F.col("d").desc()], most)


def non_overlapping(entries: DataFrame, gaps: list[int]) -> DataFrame:
    """``gap, d, priority, score, kept, nearest``: for each gap the entries that stay, by priority, score and date, and for the others the nearest that did. All gaps in one pass; a catalog's days are bounded by the calendar."""
    each = entries.select(F.explode(F.array(*[F.lit(g) for g in sorted({g for g in gaps if g > 0})])).alias("gap"), "d", "priority", "score")
    out = _greedy(each, ["gap"], F.col("gap"), [F.col("priority").desc(), F.col("score").desc(), F.col("d").desc()])
    return out.select("gap", "d", "priority", "score", "kept", "nearest")


def support(series: DataFrame, shocks: DataFrame, least: int = 12, ratio: float = 0.002) -> DataFrame:
    """Whether there are enough treated days, and how many more it takes."""
    n = series.join(F.broadcast(shocks.select("d").withColumn("_s", F.lit(True))), "d", "left").agg(F.count("*").alias("n"), F.count("_s").alias("treated"))  # at most a row a day
    required = F.greatest(F.lit(least), F.floor(ratio * F.greatest(F.lit(1), F.col("n")) + 0.999999))
    return n.withColumns({"ratio": F.round(F.try_divide(F.col("treated"), F.col("n")), 6), "required": required.cast("long")}).withColumns({"passed": (F.col("treated") >= least) & (F.col("treated") >= ratio * F.col("n")), "missing": F.greatest(F.lit(0), F.col("required") - F.col("treated"))})
