"""Effects in windows around trigger days, lead-lag correlation and lag features, over one-row-per-day series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stats import pearson
from .panel import by_day


def by_date() -> WindowSpec:
    return W.orderBy(F.unix_date("d"))


def sum_effects(dense: DataFrame, value: str, windows: Sequence[int]) -> DataFrame:
    """Adds ``e{w}`` per day: the sum of the w days after less that of the w days before; beyond the panel's ends, 0."""
    v = F.sum(F.col(value).cast("double"))
    return dense.withColumns({f"e{w}": F.coalesce(v.over(by_day().rowsBetween(1, w)), F.lit(0.0)) - F.coalesce(v.over(by_day().rowsBetween(-w, -1)), F.lit(0.0)) for w in windows})


def long_effects(wide: DataFrame, windows: Sequence[int], keep: Sequence[str] = ("d",)) -> DataFrame:
    """``e{w}`` columns as rows ``w, effect``."""
    rows = F.explode(F.array(*[F.struct(F.lit(w).alias("w"), F.col(f"e{w}").alias("effect")) for w in windows]))
    return wide.select(*keep, rows.alias("x")).select(*keep, "x.*")


def window_effect(dense: DataFrame, shocks: DataFrame, value: str, windows: Sequence[int]) -> DataFrame:
    """Mean sum effect over the shock days, by window; 0 without any."""
    hit = sum_effects(dense, value, windows).join(F.broadcast(shocks.select("d")), "d", "left_semi")  # at most a row a day
    return hit.agg(*[F.coalesce(F.avg(f"e{w}"), F.lit(0.0)).alias(f"e{w}") for w in windows], F.count("*").alias("n_shocks")).transform(lambda x: long_effects(x, windows, ["n_shocks"]))


def mean_effects(series: DataFrame, value: str, windows: Sequence[int], days: DataFrame) -> DataFrame:
    """``d, e{w}`` for ``days``: the mean of observed days in the w days after less that before; null with under max(3, w // 3) on a side."""
    all_days = series.select("d", F.col(value).cast("double").alias("v")).join(days.select("d"), "d", "full")
    out = {}
    for w in windows:
        after, before = by_date().rangeBetween(1, w), by_date().rangeBetween(-w, -1)
        enough = (F.count("v").over(after) >= max(3, w // 3)) & (F.count("v").over(before) >= max(3, w // 3))
        out[f"e{w}"] = F.when(enough, F.avg("v").over(after) - F.avg("v").over(before))
    return all_days.withColumns(out).drop("v").join(days.select("d"), "d", "left_semi")


def baseline(series: DataFrame, value: str, days: DataFrame) -> DataFrame:
    """``d, base``: the mean of the observed days from 21 to 8 days before; null for under five."""
    all_days = series.select("d", F.col(value).cast("double").alias("v")).join(days.select("d"), "d", "full")
    w = by_date().rangeBetween(-21, -8)
    return all_days.select("d", F.when(F.count("v").over(w) >= 5, F.avg("v").over(w)).alias("base")).join(days.select("d"), "d", "left_semi")


def event_diffs(series: DataFrame, value: str, days: DataFrame, reach: int = 14) -> DataFrame:
    """``d, k, diff`` for each of ``days`` and offset k: the value k days later less the day's baseline."""
    b = baseline(series, value, days).where("base IS NOT NULL")
    at = b.select("d", "base", F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("k")).withColumn("at", F.date_add("d", F.col("k")))
    v = series.select(F.col("d").alias("at"), F.col(value).cast("double").alias("v"))
    return at.join(v, "at").select("d", "k", (F.col("v") - F.col("base")).alias("diff"))


def wide_diffs(diffs: DataFrame, reach: int = 14) -> DataFrame:
    """``d`` and a column for each offset from 1 to ``reach`` of :func:`event_diffs`, a row for each day with a baseline."""
    cells = [F.max(F.when(F.col("k") == k, F.col("diff"))).alias(str(k)) for k in range(1, reach + 1)]
    return diffs.groupBy("d").agg(*cells)


def event_curve(series: DataFrame, value: str, shocks: DataFrame, reach: int = 14) -> DataFrame:
    """``k, effect, n``: the mean difference over the shocks by offset, rounded to 6 places; null where none has it."""
    means = event_diffs(series, value, shocks, reach).groupBy("k").agg(F.round(F.avg("diff"), 6).alias("effect"), F.count("*").alias("n"))
    ks = series.sparkSession.range(-reach, reach + 1).select(F.col("id").cast("int").alias("k"))
    return ks.join(means, "k", "left").select("k", "effect", F.coalesce("n", F.lit(0)).alias("n"))


def lead_lag(dense: DataFrame, x: str, y: str, most: int = 30) -> DataFrame:
    """``lag, corr, n`` for lags from -most to most of ``y`` behind ``x``, over pairs inside the panel."""
    lags = F.explode(F.sequence(F.lit(-most), F.lit(most)))
    left = dense.select("d", F.col(x).alias("x"), lags.alias("lag")).withColumn("at", F.date_add("d", F.col("lag")))
    right = dense.select(F.col("d").alias("at"), F.col(y).alias("y"))
    return left.join(right, "at").groupBy("lag").agg(F.round(pearson(F.col("x"), F.col("y")), 6).alias("corr"), F.count("*").alias("n"))


def best_lags(corrs: DataFrame) -> DataFrame:
    """The best lag, the best positive lag and lag 0; of equals the smallest lag."""
    best = lambda c: F.max_by(F.struct("lag", "corr"), F.struct(F.when(c, F.col("corr")), -F.col("lag")))
    out = corrs.agg(best(F.lit(True)).alias("b"), F.max_by(F.struct("lag", "corr"), F.when(F.col("lag") >= 1, F.struct("corr", -F.col("lag")))).alias("p"), F.max(F.when(F.col("lag") == 0, F.col("corr"))).alias("corr0"))
    return out.select(F.col("b.lag").alias("best_lag"), F.col("b.corr").alias("best_corr"), F.col("p.lag").alias("best_positive_lag"), F.col("p.corr").alias("best_positive_corr"), "corr0")


def local_peaks(dense: DataFrame, value: str, radius: int = 3) -> DataFrame:
    """Days with no strictly higher neighbour within the radius; beyond the panel's ends, 0."""
    top = F.greatest(*[F.coalesce(F.max(value).over(w), F.lit(0)) for w in (by_day().rowsBetween(-radius, -1), by_day().rowsBetween(1, radius))])
    return dense.withColumn("peak", F.col(value) >= top)


def lag_features(dense: DataFrame, shocks: DataFrame, start: int = 1, window: int = 7) -> DataFrame:
    """A row for each day that has all lags and leads observed: 16 features, ``y`` the mean outcome of the days ahead, ``t`` whether it is a shock."""

    def known(c: str, k: int) -> Column:
        return F.lag(F.when(F.col("observed"), F.col(c).cast("double")), k).over(by_day())

    ahead = by_day().rowsBetween(start, window)
    feats = {f"y{k}": known("outcome", k) for k in (1, 2, 3, 7)} | {f"c{k}": known("crisis", k) for k in (1, 2, 3, 7)} | {"ctl0": known("control", 0), "ctl1": known("control", 1), "den0": known("density", 0), "den1": known("density", 1)}
    wd, mo = F.weekday("d") * (2 * 3.141592653589793 / 7), (F.month("d") - 1) * (2 * 3.141592653589793 / 12)
    feats |= {"wd_sin": F.sin(wd), "wd_cos": F.cos(wd), "mo_sin": F.sin(mo), "mo_cos": F.cos(mo)}
    seen = F.when(F.col("observed"), F.col("outcome").cast("double"))
    out = dense.withColumns({**feats, "y": F.avg(seen).over(ahead), "_n": F.count(seen).over(ahead)}).where((F.col("_n") == window - start + 1) & F.col("observed"))
    out = out.na.drop(subset=list(feats)).join(F.broadcast(shocks.select("d").withColumn("_s", F.lit(True))), "d", "left")  # at most a row a day
    return out.select("d", *feats, "y", F.coalesce("_s", F.lit(False)).cast("int").alias("t"), "crisis")
