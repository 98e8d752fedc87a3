"""Forests for treatment effects: cross-fitted nuisance models and the spread of effects, by Spark's own forests."""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The least rows for a model, and the limits of propensities.
LEAST_ROWS, CLIP = 20, (0.03, 0.97)


def _assembled(data: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="error").transform(data)


def cross_fit_forest(data: DataFrame, features: list[str], folds: int, seed: int, trees: int = 300, depth: int = 8, leaf: int = 5, parallel: int = 4) -> tuple[DataFrame, str]:
    """``data (fold, y, t, ...)`` with ``y_hat, t_hat`` from forests grown on the other folds, and the method's name.

    Classes weigh alike in the propensity's forest; where a fold's other rows are of one class, their mean stands in.
    Propensities are clipped. Under LEAST_ROWS rows means stand in for both. ``data`` should be a written table, as
    each fit reads it; fits run side by side, each of them a Spark job.
    """
    seen = data.agg(F.count("*").alias("n"), F.avg("y").alias("y"), F.avg(F.col("t").cast("double")).alias("t")).first()
    clipped = lambda c: F.least(F.lit(CLIP[1]), F.greatest(F.lit(CLIP[0]), c))
    if seen["n"] < LEAST_ROWS:
        return data.withColumns({"y_hat": F.lit(seen["y"]).cast("double"), "t_hat": clipped(F.lit(seen["t"]).cast("double"))}), "mean_fallback"
    table = _assembled(data, features)
    counts = {r["fold"]: (r["n"], r["k"]) for r in data.groupBy("fold").agg(F.count("*").alias("n"), F.sum(F.col("t").cast("long")).alias("k")).collect()}  # a row a fold

    def one(fold: int) -> DataFrame:
        train, test = table.where(F.col("fold") != fold), table.where(F.col("fold") == fold)
        n, k = (sum(c[i] for f, c in counts.items() if f != fold) for i in (0, 1))
        outcome = RandomForestRegressor(featuresCol="_x", labelCol="y", predictionCol="y_hat", numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, featureSubsetStrategy="all", seed=seed + fold + 1)
        out = outcome.fit(train).transform(test)
        if 0 < k < n:
            weight = F.when(F.col("t") == 1, n / (2.0 * k)).otherwise(n / (2.0 * (n - k)))
            label = F.col("t").cast("double")
            treated = RandomForestClassifier(featuresCol="_x", labelCol="_t", weightCol="_w", probabilityCol="_p", rawPredictionCol="_r", predictionCol="_c", numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, seed=seed + 101 + fold)
            # a copy has no training summary: that one holds the session, which tasks can't take once a query has been observed
            out = treated.fit(train.withColumns({"_w": weight, "_t": label})).copy().transform(out).withColumn("t_hat", clipped(vector_to_array("_p")[1])).drop("_p", "_r", "_c")
        else:
            out = out.withColumn("t_hat", clipped(F.lit(k / n if n else seen["t"]).cast("double")))
        return out.drop("_x")

    with ThreadPool(max(1, parallel)) as pool:
        parts = pool.map(one, sorted(counts))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole, "cross_fitted_forest"


def forest_cate(fit: DataFrame, features: list[str], seed: int, trees: int = 500, depth: int = 8, leaf: int = 6) -> tuple[DataFrame, str]:
    """``fit`` with ``tau``: each day's effect by a forest on the ratio of residuals, weighted by the squared treatment residual; under LEAST_ROWS rows the one ratio of all stands in."""
    tr = F.col("t") - F.col("t_hat")
    yr = F.col("y") - F.col("y_hat")
    safe = F.when(F.abs(tr) >= 1e-3, tr).when(tr >= 0, 1e-3).otherwise(-1e-3)
    n = fit.count()
    if n < LEAST_ROWS:
        ratio = fit.agg(F.when(F.sum(tr * tr) > 1e-9, F.sum(tr * yr) / F.sum(tr * tr)).otherwise(0.0).alias("r")).first()["r"] if n else 0.0
        return fit.withColumn("tau", F.lit(ratio).cast("double")), "constant_cate_fallback" if n else "no_data"
    table = _assembled(fit.withColumns({"_target": yr / safe, "_weight": F.greatest(F.lit(1e-6), tr * tr)}), features)
    model = RandomForestRegressor(featuresCol="_x", labelCol="_target", weightCol="_weight", predictionCol="tau", numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, featureSubsetStrategy="all", seed=seed + 201)
    return model.fit(table).transform(table).drop("_x", "_target", "_weight"), "orthogonal_forest_proxy"
