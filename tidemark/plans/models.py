"""Queries that run the models over the panel: tests against drawn days, and their gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SEED, WINDOWS
from ..operators import gates as G
from ..operators import models as M
from ..operators import panel as P
from ..operators import permute as T
from ..operators import shocks as S
from ..operators import windows as WN
from ..sources import views as V
from ..sources.views import DENSE_SQL, SHOCKS_SQL
from . import series

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
#: Draws of the panel's windows and of the models.
PERMUTATIONS, DRAWS = 20_000, 2_000


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def effects_by_window(dense: DataFrame, shocks: DataFrame) -> DataFrame:
    """``w, adj, raw, reverse, control``: the outcome's effects around shocks, the crises' around the outcome's own shocks, the controls' around shocks."""
    back = S.shock_days(dense, "outcome", 0.75)
    parts = {"adj": (shocks, "adj"), "raw": (shocks, "outcome"), "reverse": (back, "crisis"), "control": (shocks, "density")}
    out = None
    for name, (days, value) in parts.items():
        one = WN.window_effect(dense, days, value, WINDOWS).select("w", F.col("effect").alias(name))
        out = one if out is None else out.join(one, "w")
    return out


def _sum(value: str, w: int, name: str) -> str:
    return f"coalesce(sum({value}) OVER (ORDER BY d ROWS BETWEEN 1 FOLLOWING AND {w} FOLLOWING), 0) - coalesce(sum({value}) OVER (ORDER BY d ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING), 0) AS {name}{w}"


VALUES = {"adj": "adj", "raw": "outcome", "reverse": "crisis", "control": "density"}
WINDOW_SQL = f"""{DENSE_SQL}, {SHOCKS_SQL}, ot AS (SELECT greatest(2.0, coalesce(quantile_cont(CAST(outcome AS DOUBLE), 0.75) FILTER (outcome > 0), 2.0)) AS t FROM dense), back AS (SELECT d FROM dense, ot WHERE outcome >= t),
e AS (SELECT d, {', '.join(_sum(v, w, n) for n, v in VALUES.items() for w in WINDOWS)} FROM dense)"""


@query(f"WITH {WINDOW_SQL} " + " UNION ALL ".join(f"SELECT {w} AS w, " + ", ".join(f"round((SELECT avg({n}{w}) FROM e WHERE d IN (SELECT d FROM {'back' if n == 'reverse' else 'shocks'})), 6) AS {n}" for n in VALUES) for w in WINDOWS))
def panel_window_effects(spark: SparkSession, sf: str) -> DataFrame:
    dense = V.dense(spark, sf)
    return effects_by_window(dense, series.shocks_of(spark, sf)).select("w", *[F.round(n, 6).alias(n) for n in VALUES])


def panel_metrics(dense: DataFrame, shocks: DataFrame, draws: int, seed: int = SEED) -> DataFrame:
    """``w, adj, raw, reverse, control, placebo, p_adj, p_raw, p_placebo``: effects by window, of placebo shocks too, with shares of drawn days that reach them; p_placebo is null without placebo shocks.

    Placebo shocks are days apart from shocks, as many as these, by one draw; days near shocks come in where too few are left.
    """
    days = dense.count()
    n = shocks.count()
    apart, others = T.placebo_pool(dense, shocks, M.BUFFER), dense.select("d").join(shocks.select("d"), "d", "left_anti")
    fake = M.placebo_days(apart if apart.count() >= n else others, n, seed + 7919 + days + n)
    n_fake = fake.count()
    wide = WN.sum_effects(WN.sum_effects(dense, "adj", WINDOWS).withColumnsRenamed({f"e{w}": f"adj{w}" for w in WINDOWS}), "outcome", WINDOWS).withColumnsRenamed({f"e{w}": f"raw{w}" for w in WINDOWS})
    columns = [f"{k}{w}" for k in ("adj", "raw") for w in WINDOWS]
    wide = wide.select("d", *columns)
    mean = lambda on: wide.join(F.broadcast(on.select("d")), "d", "left_semi").agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in columns]).first().asDict()  # noqa: E731  # at most a row a day
    seen, faked = mean(shocks), mean(fake)
    null = T.null_table(wide, columns, dense, n, draws, seed)
    p = {r["name"]: r["p"] for r in T.p_of(null, seen).collect()}
    null = null if n_fake == n else T.null_table(wide, columns, dense, n_fake, draws, seed)
    q = {r["name"]: r["p"] for r in T.p_of(null, faked).collect()} if n_fake else {}
    one = lambda x: 1.0 if x is None else x
    rows = [(w, faked[f"raw{w}"], one(p.get(f"adj{w}")), one(p.get(f"raw{w}")), one(q.get(f"raw{w}")) if n_fake else None) for w in WINDOWS]
    tested = dense.sparkSession.createDataFrame(rows, "w int, placebo double, p_adj double, p_raw double, p_placebo double")
    return effects_by_window(dense, shocks).join(F.broadcast(tested), "w")  # a row per window


@query()
def panel_analysis(spark: SparkSession, sf: str) -> DataFrame:
    """Eight metrics for each of five windows."""
    out = panel_metrics(V.dense(spark, sf), series.shocks_of(spark, sf), PERMUTATIONS)
    return out.select("w", *[F.round(c, 6).alias(c) for c in (*VALUES, "placebo")], "p_adj", "p_raw", "p_placebo")


def state_of(spark: SparkSession, sf: str, draws: int) -> DataFrame:
    metrics = panel_metrics(V.dense(spark, sf), series.shocks_of(spark, sf), draws)
    n = series.shocks_of(spark, sf).agg(F.count("*").alias("shock_days"))
    facts = P.progress(V.panel(spark, sf)).drop("shock_days").withColumn("catalog", F.lit(False))
    return facts.join(F.broadcast(n)).join(F.broadcast(series.lead_lag_best(spark, sf))).join(F.broadcast(G.panel_state(metrics)))  # a row each


@query()
def approval_gates(spark: SparkSession, sf: str) -> DataFrame:
    out = G.verdict(G.approval(state_of(spark, sf, PERMUTATIONS)))
    return out.select("status", "level", "verdict", F.array_join(F.transform(F.filter("gates", lambda g: g["passed"]), lambda g: g["name"]), ",").alias("passed"), "significant_windows", "standing_windows", "reverse_violations", "placebo_estimated", "placebo_violations", "placebo_dominant")


#: States of many kinds, one for each customer with orders: the gates' rules are held against SQL on them.
RULES_SQL = """st AS (SELECT o_custkey AS k, 150 + o_custkey % 80 AS observed_days, o_custkey % 23 AS shock_days, (70 + o_custkey % 31) / 100.0 AS observed_ratio, o_custkey % 4 = 0 AS catalog, o_custkey % 4 AS significant_windows, o_custkey // 3 % 4 AS standing_windows, o_custkey % 3 AS reverse_violations, o_custkey % 5 AS placebo_estimated, o_custkey // 5 % 7 // 6 AS placebo_violations, o_custkey // 7 % 5 // 4 AS placebo_dominant, o_custkey % 33 AS best_positive_lag, (o_custkey % 40) / 100.0 AS best_positive_corr, (o_custkey // 2 % 30) / 100.0 AS corr0 FROM orders GROUP BY o_custkey),
g AS (SELECT *, CASE WHEN catalog THEN 5 ELSE 12 END AS least, corr0 >= best_positive_corr - 0.08 AS same_day, placebo_estimated > 0 AND placebo_violations = 0 AND placebo_dominant = 0 AS placebo_ok FROM st),
h AS (SELECT *, observed_days >= 180 AND shock_days >= least AND observed_ratio >= 0.8 AS enough, best_positive_lag BETWEEN 1 AND 30 AND best_positive_corr >= 0.1 AND NOT same_day AS lead_ok, best_positive_lag BETWEEN 1 AND 30 AND best_positive_corr > 0.1 AND NOT same_day AS lead_over FROM g)"""


@query(
    f"WITH {RULES_SQL} SELECT k, CASE WHEN enough AND significant_windows >= 2 AND lead_ok AND reverse_violations <= 1 AND placebo_ok THEN 'APPROVED' ELSE 'REJECTED' END AS status, "
    "CASE WHEN enough AND significant_windows >= 2 AND lead_ok AND reverse_violations <= 1 AND placebo_ok THEN 'CAUSAL_SIGNAL' WHEN NOT enough THEN 'INSUFFICIENT_EVIDENCE' ELSE 'WEAK_SIGNAL' END AS level, "
    "CASE WHEN NOT enough THEN 'temporal_correlation_only' WHEN standing_windows >= 2 AND lead_over AND placebo_ok THEN 'causal_signal' WHEN standing_windows >= 2 AND lead_over THEN 'windows_but_placebo_fails' WHEN standing_windows >= 2 THEN 'windows_without_clear_lead' WHEN standing_windows >= 1 THEN 'weak_signal' ELSE 'correlation_or_weak' END AS verdict, "
    "CAST(enough AS INT) + CAST(observed_days >= 180 AS INT) + CAST(shock_days >= least AS INT) + CAST(observed_ratio >= 0.8 AS INT) + CAST(significant_windows >= 2 AS INT) + CAST(lead_ok AS INT) + CAST(reverse_violations <= 1 AS INT) + CAST(placebo_ok AS INT) AS n_passed FROM h"
)
def approval_rules(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("k")
    cut = lambda a, b: F.floor(k / a) % b
    d = lambda c: (c / F.lit(100)).cast("decimal(10,4)")
    st = V.table(spark, sf, "orders").select(F.col("o_custkey").alias("k")).distinct().select("k", (150 + k % 80).alias("observed_days"), (k % 23).alias("shock_days"), d(70 + k % 31).alias("observed_ratio"), (k % 4 == 0).alias("catalog"), (k % 4).alias("significant_windows"), cut(3, 4).alias("standing_windows"), (k % 3).alias("reverse_violations"), (k % 5).alias("placebo_estimated"), F.floor(cut(5, 7) / 6).alias("placebo_violations"), F.floor(cut(7, 5) / 4).alias("placebo_dominant"), (k % 33).alias("best_positive_lag"), d(k % 40).alias("best_positive_corr"), d(cut(2, 30)).alias("corr0"))
    return G.verdict(G.approval(st)).select("k", "status", "level", "verdict", F.size(F.filter("gates", lambda g: g["passed"])).alias("n_passed"))


@query()
def did_gate(spark: SparkSession, sf: str) -> DataFrame:
    return M.record(spark, M.did(V.panel(spark, sf), V.topics(spark, sf), series.shocks_of(spark, sf), DRAWS, SEED))


@query()
def event_study_gate(spark: SparkSession, sf: str) -> DataFrame:
    return M.record(spark, M.event_study(V.panel(spark, sf), series.shocks_of(spark, sf), DRAWS, SEED))


@query()
def synth_placebo(spark: SparkSession, sf: str) -> DataFrame:
    c = V.country(spark, sf)
    return M.record(spark, M.synth_test(c.where("unit = 0").select("d", "v"), c.where("unit <> 0"), series.shocks_of(spark, sf), DRAWS, SEED))


@query()
def causal_ml_gate(spark: SparkSession, sf: str) -> DataFrame:
    """By ridge fits."""
    return M.record(spark, M.causal_ml(series.ml_table(spark, sf), series.FEATURES, DRAWS, SEED))


@query()
def causal_forest_gate(spark: SparkSession, sf: str) -> DataFrame:
    """By forests; a test holds them against data with a known effect."""
    return M.record(spark, M.causal_ml(series.ml_table(spark, sf), series.FEATURES, DRAWS, SEED, forest=True))
