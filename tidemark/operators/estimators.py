"""Synthetic control, ridge regression and orthogonal treatment effects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .draws import fold_of

def pre_post(days: DataFrame, shocks: DataFrame, reach: int = 7) -> DataFrame:
    """``d, phase``: post if a shock is 1 to ``reach`` days before, pre if it is neither that nor a shock; other days are left out."""
    post = shocks.select(F.explode(F.sequence(F.date_add("d", 1), F.date_add("d", reach))).alias("d")).distinct().withColumn("_post", F.lit(True))
    hit = shocks.select("d").distinct().withColumn("_shock", F.lit(True))
    j = days.select("d").join(post, "d", "left").join(hit, "d", "left")
    return j.where(F.col("_post").isNotNull() | F.col("_shock").isNull()).select("d", F.when(F.col("_post"), "post").otherwise("pre").alias("phase"))


def synth_weights(treated: DataFrame, donors: DataFrame, pre: DataFrame) -> DataFrame:
    """``unit, mse, weight``: inverse mean squared error over the common pre days; donors without any count as an error of 10**6."""
    err = F.pow(F.col("y") - F.col("v"), 2)
    fit = donors.join(pre.select("d"), "d", "left_semi").join(treated.select("d", F.col("v").alias("y")), "d").groupBy("unit").agg(F.avg(err).alias("mse"))
    units = donors.select("unit").distinct().join(fit, "unit", "left").select("unit", F.coalesce("mse", F.lit(1e6)).alias("mse")).withColumn("w", 1 / (F.col("mse") + 1e-6))
    return units.withColumn("weight", F.col("w") / F.sum("w").over(W.partitionBy())).drop("w")  # a row per donor unit


def synth_gap(treated: DataFrame, donors: DataFrame, weights: DataFrame) -> DataFrame:
    """``d, gap``: the treated value less the donors' weighted mean, over the donors present that day."""
    s = donors.join(F.broadcast(weights.select("unit", "weight")), "unit").groupBy("d").agg((F.sum(F.col("weight") * F.col("v")) / F.sum("weight")).alias("synth"))  # donor units
    return treated.select("d", F.col("v").alias("y")).join(s, "d").select("d", (F.col("y") - F.col("synth")).alias("gap"))


def synth_effect(gap: DataFrame, phases: DataFrame) -> DataFrame:
    j = gap.join(phases, "d")
    m = lambda p: F.avg(F.when(F.col("phase") == p, F.col("gap")))
    return j.agg(F.count_if(F.col("phase") == "pre").alias("n_pre"), F.count_if(F.col("phase") == "post").alias("n_post"), m("pre").alias("gap_pre"), m("post").alias("gap_post")).withColumn("att", F.col("gap_post") - F.col("gap_pre"))


def gram(data: DataFrame, features: list[str], target: str, weight: Column | None = None, keys: list[str] | None = None) -> DataFrame:
    """``i, j, value``: the weighted normal equations with an intercept, in one aggregation; j = -1 is the target's side. A fit of all but one fold is a difference of such sums."""
    w = weight if weight is not None else F.lit(1.0)
    cols = [F.lit(1.0), *[F.col(f).cast("double") for f in features]]
    cells = {(i, j): F.sum(w * cols[i] * cols[j]) for i in range(len(cols)) for j in range(i, len(cols))} | {(i, -1): F.sum(w * cols[i] * F.col(target)) for i in range(len(cols))}
    wide = data.groupBy(*(keys or [])).agg(*[c.alias(f"g_{i}_{j}") for (i, j), c in cells.items()])
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"g_{i}_{j}").alias("value")) for i, j in cells]))
    return wide.select(*(keys or []), rows.alias("x")).select(*(keys or []), "x.*")


def solve_ridge(cells: list[tuple[int, int, float]], alpha: float) -> list[float]:
    """Coefficients, the unpenalised intercept first, from the cells of :func:`gram`: a system as large as the features are many."""
    import numpy as np

    n = 1 + max(i for i, _, _ in cells)
    a, b = np.zeros((n, n)), np.zeros(n)
    for i, j, v in cells:
        if j < 0:
            b[i] = v
        else:
            a[i, j] = a[j, i] = v
    return np.linalg.lstsq(a + alpha * np.diag([0.0] + [1.0] * (n - 1)), b, rcond=None)[0].tolist()


def cross_fit(data: DataFrame, features: list[str], fold: Column, folds: int, alpha: float = 2.0, clip: tuple[float, float] = (0.03, 0.97)) -> DataFrame:
    """``data`` with ``y_hat`` and ``t_hat`` of ridge fits on the other folds, propensities clipped. The sums of all folds come in one pass, and only those reach the driver."""
    data = data.withColumn("fold", fold)
    sums = {t: gram(data, features, t, keys=["fold"]).collect() for t in ("y", "t")}
    expr: dict[str, Column] = {}
    for t, rows in sums.items():
        out = F.lit(None).cast("double")
        for f in range(folds):
            total: dict[tuple[int, int], float] = {}
            for r in rows:
                if r.fold != f:
                    total[r.i, r.j] = total.get((r.i, r.j), 0.0) + (r.value or 0.0)
            if total:
                beta = solve_ridge([(i, j, v) for (i, j), v in total.items()], alpha)
                out = F.when(F.col("fold") == f, sum((F.lit(b) * F.col(c) for b, c in zip(beta[1:], features)), F.lit(beta[0]))).otherwise(out)
        expr[f"{t}_hat"] = out if t == "y" else F.least(F.lit(clip[1]), F.greatest(F.lit(clip[0]), out))
    return data.withColumns(expr)


def seeded_folds(data: DataFrame, folds: int, seed: int, day: str = "d") -> DataFrame:
    """``data``, a row a day, with ``fold``: days in order, shuffled by the recorded generator and dealt round-robin."""
    days = [r[day] for r in data.select(day).orderBy(day).collect()]  # a row a day
    dealt = zip(days, fold_of(len(days), folds, seed).tolist())
    return data.join(F.broadcast(data.sparkSession.createDataFrame(list(dealt), f"{day} date, fold int")), day)  # a row a day


def orthogonal_effects(data: DataFrame, y_hat: str = "y_hat", t_hat: str = "t_hat") -> DataFrame:
    """``ate, att``: residual on residual, over all and over the treated; 0 without variation."""
    ty, tt = (F.col("t") - F.col(t_hat)) * (F.col("y") - F.col(y_hat)), F.pow(F.col("t") - F.col(t_hat), 2)
    ratio = lambda a, b: F.when(b > 1e-9, a / b).otherwise(0.0)
    on = lambda c: F.sum(F.when(F.col("t") == 1, c))
    return data.agg(ratio(F.sum(ty), F.sum(tt)).alias("ate"), F.coalesce(ratio(on(ty), on(tt)), F.lit(0.0)).alias("att"), F.count("*").alias("n"), F.sum("t").cast("long").alias("treated"))


def overlap(data: DataFrame, p: str = "t_hat") -> DataFrame:
    x = F.col(p)
    return data.agg(F.avg(F.when(F.col("t") == 1, x)).alias("mean_treated"), F.avg(F.when(F.col("t") == 0, x)).alias("mean_control"), F.percentile(x, 0.05).alias("p05"), F.percentile(x, 0.95).alias("p95"), F.avg(x.between(0.05, 0.95).cast("double")).alias("share_inside"))


def heterogeneity(effects: DataFrame, tau: str = "tau") -> DataFrame:
    """Thirds of the effects and their means; nulls for under nine."""
    x = F.col(tau)
    q = effects.agg(F.count(x).alias("n"), F.percentile(x, 0.33).alias("q33"), F.percentile(x, 0.67).alias("q67"))
    j = effects.join(F.broadcast(q))  # one row
    out = j.groupBy("n", "q33", "q67").agg(F.avg(F.when(x <= F.col("q33"), x)).alias("low"), F.avg(F.when(x >= F.col("q67"), x)).alias("high"))
    null = lambda c: F.when(F.col("n") >= 9, F.round(c, 6))
    return out.select("n", null("q33").alias("q33"), null("q67").alias("q67"), null("low").alias("low"), null("high").alias("high"), null(F.col("high") - F.col("low")).alias("spread"))
