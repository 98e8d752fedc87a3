"""Queries on panels, windows, shocks, permutations and estimators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import MEAN_WINDOWS, SEED, WINDOWS
from ..functions.stats import shock_threshold
from ..operators import estimators as E
from ..operators import gates as G
from ..operators import panel as P
from ..operators import permute as T
from ..operators import shocks as S
from ..operators import windows as WN
from ..sources import readers as R
from ..sources import sinks as K
from ..sources import views as V
from ..sources.shared import shared_table
from ..sources.views import DENSE_SQL, PANEL_SQL, SHOCKS_SQL

#: The draws of the window test and of the placebo tests, and the windows of the latter.
PERMUTATIONS, PLACEBOS, PLACEBO_WINDOWS = 20_000, 2_000, (7, 14, 30)
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(*cols: str) -> list:
    return [F.round(c, 6).alias(c) for c in cols]


def shocks_of(spark: SparkSession, sf: str) -> DataFrame:
    return S.shock_ladder(V.panel(spark, sf))


@query(f"WITH {PANEL_SQL} SELECT d, crisis, outcome, control FROM panel")
def daily_counts(spark, sf):  # noqa: ANN001, ANN201
    return V.panel(spark, sf)


@query(f"WITH {DENSE_SQL} SELECT d, observed, crisis, outcome, control, round(density, 6) AS density, round(adj, 6) AS adj FROM dense")
def dense_panel(spark, sf):  # noqa: ANN001, ANN201
    return V.dense(spark, sf).select("d", "observed", "crisis", "outcome", "control", *r6("density", "adj"))


@query(f"WITH {PANEL_SQL}, {SHOCKS_SQL} SELECT t75, t90, (SELECT count(*) FROM panel WHERE crisis >= t90) AS days90 FROM thr")
def shock_thresholds(spark, sf):  # noqa: ANN001, ANN201
    p = V.panel(spark, sf)
    t = p.agg(shock_threshold(F.col("crisis"), 0.75).alias("t75"), shock_threshold(F.col("crisis"), 0.9).alias("t90"))
    return p.join(F.broadcast(t)).groupBy("t75", "t90").agg(F.count_if(F.col("crisis") >= F.col("t90")).alias("days90"))  # one row


@query(f"WITH {PANEL_SQL}, {SHOCKS_SQL} SELECT d, threshold FROM shocks")
def shock_days_ladder(spark, sf):  # noqa: ANN001, ANN201
    return shocks_of(spark, sf).select("d", "threshold")


def _sum_sql(value: str, windows=WINDOWS) -> str:  # noqa: ANN001
    e = ", ".join(f"coalesce(sum({value}) OVER (ORDER BY d ROWS BETWEEN 1 FOLLOWING AND {w} FOLLOWING), 0) - coalesce(sum({value}) OVER (ORDER BY d ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING), 0) AS e{w}" for w in windows)
    return f"SELECT d, {e} FROM dense"


@query(f"WITH {DENSE_SQL}, {SHOCKS_SQL}, e AS ({_sum_sql('adj')}), m AS (SELECT count(*) AS n_shocks, {', '.join(f'avg(e{w}) AS e{w}' for w in WINDOWS)} FROM e WHERE d IN (SELECT d FROM shocks)) " + " UNION ALL ".join(f"SELECT n_shocks, {w} AS w, round(e{w}, 6) AS effect FROM m" for w in WINDOWS))
def window_effect_sum(spark, sf):  # noqa: ANN001, ANN201
    return WN.window_effect(V.dense(spark, sf), shocks_of(spark, sf), "adj", WINDOWS).select("n_shocks", "w", *r6("effect"))


def _mean_sql(windows=MEAN_WINDOWS) -> str:  # noqa: ANN001
    def side(w: int, a: str, b: str, f: str) -> str:
        return f"{f}(CAST(outcome AS DOUBLE)) OVER (ORDER BY d RANGE BETWEEN INTERVAL {a} DAY {'PRECEDING' if b.startswith('-') else 'FOLLOWING'} AND INTERVAL {b.lstrip('-')} DAY {'PRECEDING' if b.startswith('-') else 'FOLLOWING'})"

    cols = []
    for w in windows:
        aft, bef = (1, str(w)), (w, "-1")
        n = max(3, w // 3)
        cols.append(f"CASE WHEN {side(w, aft[0], aft[1], 'count')} >= {n} AND {side(w, bef[0], bef[1], 'count')} >= {n} THEN {side(w, aft[0], aft[1], 'avg')} - {side(w, bef[0], bef[1], 'avg')} END AS e{w}")
    return "SELECT d, " + ", ".join(cols) + " FROM panel"


@query(f"WITH {PANEL_SQL}, {SHOCKS_SQL}, e AS ({_mean_sql()}) SELECT d, {', '.join(f'round(e{w}, 6) AS e{w}' for w in MEAN_WINDOWS)} FROM e WHERE d IN (SELECT d FROM shocks)")
def window_effect_mean(spark, sf):  # noqa: ANN001, ANN201
    return WN.mean_effects(V.panel(spark, sf), "outcome", MEAN_WINDOWS, shocks_of(spark, sf)).select("d", *r6(*[f"e{w}" for w in MEAN_WINDOWS]))


@query()
def window_effect_permutation(spark, sf):  # noqa: ANN001, ANN201
    """Too many draws for SQL; tests hold it against a plain version."""
    dense, shocks = V.dense(spark, sf), shocks_of(spark, sf)
    wide = WN.sum_effects(dense, "adj", WINDOWS).select("d", *[f"e{w}" for w in WINDOWS])
    hit = wide.join(F.broadcast(shocks.select("d")), "d", "left_semi")  # at most a row a day
    seen = hit.agg(F.count("*").alias("n"), *[F.avg(f"e{w}").alias(f"e{w}") for w in WINDOWS]).first()
    null = T.null_table(wide, [f"e{w}" for w in WINDOWS], dense, seen["n"], PERMUTATIONS, SEED)
    tested = T.p_of(null, {f"e{w}": seen[f"e{w}"] for w in WINDOWS})
    effects = spark.createDataFrame([(w, f"e{w}", seen[f"e{w}"]) for w in WINDOWS], "w int, name string, effect double")
    return effects.join(F.broadcast(tested), "name").select("w", F.round("effect", 6).alias("effect"), F.coalesce("p", F.lit(1.0)).alias("p"), "draws")  # a row per window


@query()
def did_placebo(spark, sf):  # noqa: ANN001, ANN201
    """By window; the effect is null where under half of the shocks, or under three, have one, and p where that or a pool with fewer days leaves no draws. Too many draws for SQL; tests hold it against a plain version."""
    panel, shocks = V.panel(spark, sf), shocks_of(spark, sf)
    wide = WN.mean_effects(panel, "outcome", PLACEBO_WINDOWS, panel)
    hit = wide.join(F.broadcast(shocks.select("d")), "d", "left_semi")  # at most a row a day
    seen = hit.agg(F.count("*").alias("n"), *[x for w in PLACEBO_WINDOWS for x in (F.count(f"e{w}").alias(f"n{w}"), F.avg(f"e{w}").alias(f"e{w}"))]).first()
    asked = shocks.count()
    pool = T.placebo_pool(panel, shocks, 7)
    out = None
    for w in PLACEBO_WINDOWS:
        enough = seen[f"n{w}"] >= max(3, asked // 2)
        att = seen[f"e{w}"] if enough else None
        known = wide.where(F.col(f"e{w}").isNotNull()).select("d", F.col(f"e{w}").alias("e"))
        one = T.p_of(T.null_table(known, ["e"], pool, seen[f"n{w}"] if enough else 0, PLACEBOS, SEED + w), {"e": att})
        one = one.select(F.lit(w).alias("w"), F.round(F.lit(att).cast("double"), 6).alias("att"), "p", "draws", *r6("null_low", "null_high"))
        out = one if out is None else out.unionByName(one)
    return out


BASE_SQL = "b AS (SELECT s.d, avg(CAST(p.outcome AS DOUBLE)) AS base FROM {days} s JOIN panel p ON p.d BETWEEN s.d - 21 AND s.d - 8 GROUP BY s.d HAVING count(*) >= 5), diff AS (SELECT b.d, CAST(k AS INT) AS k, p.outcome - base AS diff FROM b, range(-14, 15) AS r(k) JOIN panel p ON p.d = b.d + CAST(k AS INT))"


@query(f"WITH {PANEL_SQL}, {SHOCKS_SQL}, {BASE_SQL.format(days='shocks')}, m AS (SELECT k, round(avg(diff), 6) AS effect, count(*) AS n FROM diff GROUP BY k) SELECT CAST(r.k AS INT) AS k, effect, coalesce(n, 0) AS n FROM range(-14, 15) AS r(k) LEFT JOIN m ON m.k = r.k")
def event_study_curve(spark, sf):  # noqa: ANN001, ANN201
    return WN.event_curve(V.panel(spark, sf), "outcome", shocks_of(spark, sf))


@query()
def event_study_peak(spark, sf):  # noqa: ANN001, ANN201
    """Too many draws for SQL; tests hold it against a plain version."""
    panel, shocks = V.panel(spark, sf), shocks_of(spark, sf)
    diffs = WN.event_diffs(panel, "outcome", panel)
    curve = diffs.join(F.broadcast(shocks.select("d")), "d", "left_semi").where("k >= 1").groupBy("k").agg(F.round(F.avg("diff"), 6).alias("m"))  # at most a row a day
    seen = curve.agg(F.coalesce(F.max("m"), F.lit(0.0)).alias("peak")).first()["peak"]
    pool = T.placebo_pool(diffs.select("d").distinct(), shocks, 14)  # days with a baseline
    null = T.null_table(WN.wide_diffs(diffs), [str(k) for k in range(1, 15)], pool, shocks.count(), PLACEBOS, SEED, peak=6)
    return T.p_of(null, {"peak": seen}).select(F.lit(seen).alias("peak"), F.coalesce("p", F.lit(1.0)).alias("p"), "draws")


LAG_SQL = f"{DENSE_SQL}, c AS (SELECT CAST(k AS INT) AS lag, round(CASE WHEN count(*) >= 3 AND stddev_pop(a.crisis) > 0 AND stddev_pop(b.adj) > 0 THEN covar_pop(a.crisis, b.adj) / (stddev_pop(a.crisis) * stddev_pop(b.adj)) ELSE 0 END, 6) AS corr, count(*) AS n FROM dense a, range(-30, 31) AS r(k) JOIN dense b ON b.d = a.d + CAST(k AS INT) GROUP BY k)"


@query(f"WITH {LAG_SQL} SELECT lag, corr, n FROM c")
def lead_lag_corr(spark, sf):  # noqa: ANN001, ANN201
    return WN.lead_lag(V.dense(spark, sf), "crisis", "adj")


@query(f"WITH {LAG_SQL}, b AS (SELECT * FROM c ORDER BY corr DESC, lag LIMIT 1), p AS (SELECT * FROM c WHERE lag >= 1 ORDER BY corr DESC, lag LIMIT 1) SELECT b.lag AS best_lag, b.corr AS best_corr, p.lag AS best_positive_lag, p.corr AS best_positive_corr, (SELECT corr FROM c WHERE lag = 0) AS corr0 FROM b, p")
def lead_lag_best(spark, sf):  # noqa: ANN001, ANN201
    return WN.best_lags(lead_lag_corr(spark, sf))


PROGRESS_SQL = f"""{PANEL_SQL}, {SHOCKS_SQL}, q AS (SELECT min(d) AS first, max(d) AS last, count(*) AS observed_days, (SELECT t75 FROM thr) AS threshold, count(*) FILTER (crisis >= (SELECT t75 FROM thr)) AS shock_days, CAST(max(d) - min(d) + 1 AS BIGINT) AS span_days FROM panel),
m AS (SELECT CAST(coalesce(max(gap), 0) AS BIGINT) AS max_missing_streak FROM (SELECT d - lag(d) OVER (ORDER BY d) - 1 AS gap FROM panel)),
progress AS (SELECT *, span_days - observed_days AS missing_days, round(observed_days / span_days, 6) AS observed_ratio, greatest(0, 180 - observed_days) AS remaining_days, greatest(0, 12 - shock_days) AS remaining_shocks FROM q, m)"""


@query(f"WITH {PROGRESS_SQL} SELECT *, last + CAST(greatest(remaining_days, remaining_shocks) AS INT) AS earliest, round(least(1.0, observed_days / 180, shock_days / 12), 6) AS progress FROM progress")
def panel_progress(spark, sf):  # noqa: ANN001, ANN201
    return P.progress(V.panel(spark, sf))


@query(f"WITH {DENSE_SQL}, {SHOCKS_SQL} SELECT dense.d, CAST(min(abs(dense.d - shocks.d)) AS INT) AS distance FROM dense, shocks GROUP BY dense.d")
def min_distance(spark, sf):  # noqa: ANN001, ANN201
    return S.min_distance(V.dense(spark, sf), shocks_of(spark, sf))


def _two(status: str) -> str:
    return f"SELECT CAST(o_orderdate AS DATE) AS d, count(*) FILTER (o_orderpriority IN ('1-URGENT', '3-MEDIUM')) AS crisis, count(*) FILTER (o_orderpriority IN ('2-HIGH', '4-NOT SPECIFIED')) AS outcome FROM orders WHERE o_orderstatus IN ({status}) GROUP BY 1"


@query(
    f"WITH a AS ({_two(chr(39) + 'F' + chr(39))}), b AS ({_two(chr(39) + 'F' + chr(39) + ', ' + chr(39) + 'O' + chr(39))}), j AS (SELECT a.crisis AS c1, b.crisis AS c2, a.outcome AS o1, b.outcome AS o2 FROM a JOIN b USING (d)), "
    "t AS (SELECT greatest(2.0, coalesce(quantile_cont(CAST(c1 AS DOUBLE), 0.75) FILTER (c1 > 0), 2.0)) AS t1, greatest(2.0, coalesce(quantile_cont(CAST(c2 AS DOUBLE), 0.75) FILTER (c2 > 0), 2.0)) AS t2 FROM j), "
    "r AS (SELECT count(*) AS overlap_days, round(avg(abs(c1 - c2)), 6) AS mean_abs_delta, round(sum(abs(c1 - c2)) / sum(greatest(1.0, (c1 + c2) / 2)), 6) AS crisis_delta, round(sum(abs(o1 - o2)) / sum(greatest(1.0, (o1 + o2) / 2)), 6) AS outcome_delta, round(corr(c1, c2), 6) AS correlation, round(avg(CAST((c1 >= t1) = (c2 >= t2) AS INT)), 6) AS shock_agreement FROM j, t) "
    "SELECT *, overlap_days >= 30 AND shock_agreement >= 0.7 AND crisis_delta <= 0.6 AND outcome_delta <= 0.6 AS stable FROM r"
)
def dual_policy_review(spark, sf):  # noqa: ANN001, ANN201
    o = V.table(spark, sf, "orders")
    return P.dual_review(V.orders_panel(o.where("o_orderstatus = 'F'")), V.orders_panel(o.where("o_orderstatus IN ('F', 'O')")))


ROWS_SQL = "rows_ AS (SELECT o_orderkey AS ord, strftime(o_orderdate, '%Y-%m-%d') AS date, CASE WHEN o_orderstatus = 'F' THEN 'strict' ELSE 'strict-balanced' END AS policy, CASE WHEN o_orderpriority = '1-URGENT' THEN 'run_day_only' END AS date_scope, CAST(round(o_totalprice) AS BIGINT) AS n FROM orders)"


def _panel_rows(spark: SparkSession, sf: str) -> DataFrame:
    o = V.table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("ord"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.when(F.col("o_orderstatus") == "F", "strict").otherwise("strict-balanced").alias("policy"), F.when(F.col("o_orderpriority") == "1-URGENT", "run_day_only").alias("date_scope"), F.round("o_totalprice").cast("long").alias("n"))


@query(f"WITH {ROWS_SQL} SELECT date, ord, n FROM rows_ WHERE date_scope = 'run_day_only' AND policy = 'strict' QUALIFY row_number() OVER (PARTITION BY date ORDER BY ord DESC) = 1")
def panel_last_wins(spark, sf):  # noqa: ANN001, ANN201
    return R.panel_rows(_panel_rows(spark, sf), "strict").select("date", "ord", "n")


@query(f"WITH {ROWS_SQL}, best AS (SELECT policy FROM rows_ GROUP BY policy ORDER BY (policy = 'lenient') DESC, count(*) DESC, min(ord) LIMIT 1) SELECT policy, count(*) AS n FROM rows_ WHERE policy IN (SELECT policy FROM best) GROUP BY policy")
def policy_fallback(spark, sf):  # noqa: ANN001, ANN201
    return R.preferred_policy(_panel_rows(spark, sf), "lenient").groupBy("policy").agg(F.count("*").alias("n"))


@query(f"WITH {PANEL_SQL}, new AS (SELECT d, crisis + 1 AS crisis, outcome, control FROM panel WHERE day(d) = 1) SELECT * FROM new UNION ALL SELECT * FROM panel WHERE d NOT IN (SELECT d FROM new)")
def panel_upsert(spark, sf):  # noqa: ANN001, ANN201
    p = V.panel(spark, sf)
    return K.upsert(p, p.where(F.dayofmonth("d") == 1).withColumn("crisis", F.col("crisis") + 1), ["d"])


@query(
    f"WITH {DENSE_SQL}, old AS (SELECT d, CASE WHEN day(d) % 2 = 0 THEN 'timeline_backfill_v1' ELSE 'live' END AS data_source FROM panel WHERE day(d) <= 20), bad AS (SELECT d FROM panel WHERE day(d) = 7) "
    "SELECT n.d, n.crisis, CASE WHEN bad.d IS NOT NULL THEN 'skip_failed' WHEN n.crisis = 0 THEN 'skip_zero' WHEN old.d IS NULL THEN 'insert' WHEN data_source LIKE 'timeline_backfill%' THEN 'replace' ELSE 'skip_existing' END AS action FROM dense n LEFT JOIN old ON old.d = n.d LEFT JOIN bad ON bad.d = n.d"
)
def backfill_insert(spark, sf):  # noqa: ANN001, ANN201
    p, dense = V.panel(spark, sf), V.dense(spark, sf).select("d", "crisis")
    old = p.where(F.dayofmonth("d") <= 20).select("d", F.when(F.dayofmonth("d") % 2 == 0, "timeline_backfill_v1").otherwise("live").alias("data_source"))
    return K.guarded_insert(old, dense, p.where(F.dayofmonth("d") == 7).select("d"), ["d"], "crisis", overwrite=True, skip_zero=True)


TOPIC_SQL = "t AS (SELECT CAST(o_orderdate AS DATE) AS d, c_mktsegment AS topic, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL), g AS (SELECT CAST(unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS DATE) AS d FROM t)"
COUNTRY_SQL = "c AS (SELECT CAST(o_orderdate AS DATE) AS d, n_regionkey AS unit, count(*) AS v FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)"


@query(f"WITH {TOPIC_SQL} SELECT g.d, x.topic, coalesce(t.n, 0) AS n FROM g CROSS JOIN (SELECT DISTINCT topic FROM t) x LEFT JOIN t ON t.d = g.d AND t.topic = x.topic")
def topic_panel(spark, sf):  # noqa: ANN001, ANN201
    t = V.topics(spark, sf)
    return P.cross_fill(t, P.grid(t), "topic", "n").select("d", "topic", "n")


@query(f"WITH {COUNTRY_SQL}, g AS (SELECT CAST(unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS DATE) AS d FROM c) SELECT g.d, x.unit, coalesce(c.v, 0) AS v FROM g CROSS JOIN (SELECT DISTINCT unit FROM c) x LEFT JOIN c ON c.d = g.d AND c.unit = x.unit")
def country_panel(spark, sf):  # noqa: ANN001, ANN201
    c = V.country(spark, sf)
    return P.cross_fill(c, P.grid(c), "unit", "v").select("d", "unit", "v")


SYNTH_SQL = f"""{PANEL_SQL}, {SHOCKS_SQL}, {COUNTRY_SQL}, tr AS (SELECT d, v FROM c WHERE unit = 0), dn AS (SELECT * FROM c WHERE unit <> 0), top AS (SELECT d FROM shocks),
post AS (SELECT DISTINCT top.d + CAST(k AS INT) AS d FROM top, range(1, 8) AS r(k)), ph AS (SELECT d, CASE WHEN d IN (SELECT d FROM post) THEN 'post' ELSE 'pre' END AS phase FROM tr WHERE d IN (SELECT d FROM post) OR d NOT IN (SELECT d FROM top)),
m AS (SELECT unit, avg((tr.v - dn.v) * (tr.v - dn.v)) AS mse FROM dn JOIN tr USING (d) JOIN ph USING (d) WHERE phase = 'pre' GROUP BY unit), w AS (SELECT u.unit, coalesce(mse, 1e6) AS mse, 1 / (coalesce(mse, 1e6) + 1e-6) AS w FROM (SELECT DISTINCT unit FROM dn) u LEFT JOIN m USING (unit)), ww AS (SELECT unit, mse, w / (SELECT sum(w) FROM w) AS weight FROM w),
s AS (SELECT d, sum(weight * v) / sum(weight) AS synth FROM dn JOIN ww USING (unit) GROUP BY d), gap AS (SELECT d, tr.v - synth AS gap FROM tr JOIN s USING (d))"""


def _synth(spark: SparkSession, sf: str):  # noqa: ANN202
    c = V.country(spark, sf)
    treated, donors = c.where("unit = 0").select("d", "v"), c.where("unit <> 0")
    phases = E.pre_post(treated, shocks_of(spark, sf).select("d"))
    weights = E.synth_weights(treated, donors, phases.where("phase = 'pre'"))
    return treated, donors, phases, weights


@query(f"WITH {SYNTH_SQL} SELECT unit, round(mse, 6) AS mse, round(weight, 6) AS weight FROM ww")
def synth_weights(spark, sf):  # noqa: ANN001, ANN201
    return _synth(spark, sf)[3].select("unit", *r6("mse", "weight"))


@query(f"WITH {SYNTH_SQL} SELECT d, round(gap, 6) AS gap FROM gap")
def synth_gap(spark, sf):  # noqa: ANN001, ANN201
    t, d, _, w = _synth(spark, sf)
    return E.synth_gap(t, d, w).select("d", *r6("gap"))


@query(f"WITH {SYNTH_SQL}, e AS (SELECT count(*) FILTER (phase = 'pre') AS n_pre, count(*) FILTER (phase = 'post') AS n_post, avg(gap) FILTER (phase = 'pre') AS gap_pre, avg(gap) FILTER (phase = 'post') AS gap_post FROM gap JOIN ph USING (d)) SELECT n_pre, n_post, round(gap_pre, 6) AS gap_pre, round(gap_post, 6) AS gap_post, round(gap_post - gap_pre, 6) AS att FROM e")
def synth_att(spark, sf):  # noqa: ANN001, ANN201
    t, d, ph, w = _synth(spark, sf)
    return E.synth_effect(E.synth_gap(t, d, w), ph).select("n_pre", "n_post", *r6("gap_pre", "gap_post", "att"))


def _lag(c: str, k: int, name: str) -> str:
    return f"lag(CASE WHEN observed THEN CAST({c} AS DOUBLE) END, {k}) OVER (ORDER BY d) AS {name}"


FEATURES = [f"y{k}" for k in (1, 2, 3, 7)] + [f"c{k}" for k in (1, 2, 3, 7)] + ["ctl0", "ctl1", "den0", "den1", "wd_sin", "wd_cos", "mo_sin", "mo_cos"]
ML_SQL = f"""{DENSE_SQL}, {SHOCKS_SQL}, f AS (SELECT d, observed, crisis, {', '.join(_lag('outcome', k, f'y{k}') for k in (1, 2, 3, 7))}, {', '.join(_lag('crisis', k, f'c{k}') for k in (1, 2, 3, 7))}, {_lag('control', 0, 'ctl0')}, {_lag('control', 1, 'ctl1')}, {_lag('density', 0, 'den0')}, {_lag('density', 1, 'den1')},
sin((isodow(d) - 1) * 2 * pi() / 7) AS wd_sin, cos((isodow(d) - 1) * 2 * pi() / 7) AS wd_cos, sin((month(d) - 1) * 2 * pi() / 12) AS mo_sin, cos((month(d) - 1) * 2 * pi() / 12) AS mo_cos,
avg(CASE WHEN observed THEN CAST(outcome AS DOUBLE) END) OVER (ORDER BY d ROWS BETWEEN 1 FOLLOWING AND 7 FOLLOWING) AS y, count(CASE WHEN observed THEN 1 END) OVER (ORDER BY d ROWS BETWEEN 1 FOLLOWING AND 7 FOLLOWING) AS n FROM dense),
ml AS (SELECT d, {', '.join(FEATURES)}, y, CAST(d IN (SELECT d FROM shocks) AS INT) AS t, crisis FROM f WHERE n = 7 AND observed AND {' AND '.join(f'{c} IS NOT NULL' for c in FEATURES)})"""


@query(f"WITH {ML_SQL} SELECT d, {', '.join(f'round({c}, 6) AS {c}' for c in FEATURES)}, round(y, 6) AS y, t FROM ml")
def ml_features(spark, sf):  # noqa: ANN001, ANN201
    return WN.lag_features(V.dense(spark, sf), shocks_of(spark, sf)).select("d", *r6(*FEATURES, "y"), "t")


GRAM = ("y1", "c1", "ctl0")


@query(f"WITH {ML_SQL}, z AS (SELECT 1.0 AS x0, {', '.join(f'{c} AS x{i + 1}' for i, c in enumerate(GRAM))}, y FROM ml) " + " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, round(sum(x{i} * {'y' if j < 0 else f'x{j}'}), 4) AS value FROM z" for i in range(4) for j in [-1, *range(i, 4)]))
def ridge_gram(spark, sf):  # noqa: ANN001, ANN201
    return E.gram(WN.lag_features(V.dense(spark, sf), shocks_of(spark, sf)), list(GRAM), "y").select("i", "j", F.round("value", 4).alias("value"))


@query(f"WITH {ML_SQL}, h AS (SELECT *, (y1 + y2 + y3) / 3 AS yh, 0.03 + 0.5 * c1 / (1 + c1 + c2) AS th FROM ml), q AS (SELECT t, (t - th) * (y - yh) AS a, (t - th) * (t - th) AS b FROM h) SELECT coalesce(round(sum(a) / sum(b), 6), 0) AS ate, round(coalesce(sum(a) FILTER (t = 1) / sum(b) FILTER (t = 1), 0), 6) AS att, count(*) AS n, CAST(sum(t) AS BIGINT) AS treated FROM q")
def ate_residual(spark, sf):  # noqa: ANN001, ANN201
    ml = WN.lag_features(V.dense(spark, sf), shocks_of(spark, sf)).withColumns({"y_hat": (F.col("y1") + F.col("y2") + F.col("y3")) / 3, "t_hat": 0.03 + 0.5 * F.col("c1") / (1 + F.col("c1") + F.col("c2"))})
    return E.orthogonal_effects(ml).select(*r6("ate", "att"), "n", "treated")


def ml_table(spark: SparkSession, sf: str) -> DataFrame:
    """The features with their folds, computed once: fits read them several times."""
    return shared_table(E.seeded_folds(WN.lag_features(V.dense(spark, sf), shocks_of(spark, sf)), 5, SEED + 9), "ml-features")


@query()
def causal_cross_fit(spark, sf):  # noqa: ANN001, ANN201
    """Folds of the recorded generator: no SQL; a test holds it against a plain version."""
    fit = E.cross_fit(ml_table(spark, sf), FEATURES, F.col("fold"), 5)
    return E.orthogonal_effects(fit).crossJoin(E.overlap(fit)).select(*r6("ate", "att", "mean_treated", "mean_control", "p05", "p95", "share_inside"), "n", "treated")


@query(f"WITH {ML_SQL}, e AS (SELECT y - y1 AS tau FROM ml), q AS (SELECT count(*) AS n, quantile_cont(tau, 0.33) AS q33, quantile_cont(tau, 0.67) AS q67 FROM e) SELECT n, round(q33, 6) AS q33, round(q67, 6) AS q67, round(avg(tau) FILTER (tau <= q33), 6) AS low, round(avg(tau) FILTER (tau >= q67), 6) AS high, round(avg(tau) FILTER (tau >= q67) - avg(tau) FILTER (tau <= q33), 6) AS spread FROM e, q GROUP BY n, q33, q67")
def heterogeneity(spark, sf):  # noqa: ANN001, ANN201
    return E.heterogeneity(WN.lag_features(V.dense(spark, sf), shocks_of(spark, sf)).select((F.col("y") - F.col("y1")).alias("tau")))


@query(f"WITH {PANEL_SQL}, {SHOCKS_SQL}, q AS (SELECT count(*) AS n, count(*) FILTER (d IN (SELECT d FROM shocks)) AS treated FROM panel), z AS (SELECT n, treated, round(treated / n, 6) AS ratio, CAST(greatest(12, floor(0.002 * greatest(1, n) + 0.999999)) AS BIGINT) AS required FROM q) SELECT *, treated >= 12 AND treated >= 0.002 * n AS passed, greatest(0, required - treated) AS missing FROM z")
def support_projection(spark, sf):  # noqa: ANN001, ANN201
    return S.support(V.panel(spark, sf), shocks_of(spark, sf))


@query(f"WITH {DENSE_SQL} SELECT d, crisis FROM (SELECT d, crisis, coalesce(max(crisis) OVER (ORDER BY d ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 0) AS a, coalesce(max(crisis) OVER (ORDER BY d ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), 0) AS b FROM dense) WHERE crisis >= a AND crisis >= b")
def local_peaks(spark, sf):  # noqa: ANN001, ANN201
    return WN.local_peaks(V.dense(spark, sf), "crisis").where("peak").select("d", "crisis")


@query(f"WITH {DENSE_SQL}, manual AS (SELECT d FROM dense WHERE day(d) = 15 AND month(d) % 6 = 0), near AS (SELECT DISTINCT d + CAST(k AS INT) AS d FROM manual, range(-14, 15) AS r(k)) SELECT d, crisis FROM dense WHERE crisis >= 4 AND d NOT IN (SELECT d FROM near)")
def near_manual_anti(spark, sf):  # noqa: ANN001, ANN201
    dense = V.dense(spark, sf)
    manual = dense.where((F.dayofmonth("d") == 15) & (F.month("d") % 6 == 0))
    return T.placebo_pool(dense.where("crisis >= 4"), manual, 14).join(dense.select("d", "crisis"), "d")


GREEDY_SQL = """cand AS (SELECT d, row_number() OVER (ORDER BY crisis DESC, d DESC) AS r FROM shocks JOIN panel USING (d)), rec AS (SELECT 0 AS r, CAST([] AS DATE[]) AS kept UNION ALL SELECT rec.r + 1, CASE WHEN len(list_filter(kept, lambda k: abs(k - c.d) <= 21)) > 0 THEN kept ELSE list_append(kept, c.d) END FROM rec JOIN cand c ON c.r = rec.r + 1)"""


@query(f"WITH RECURSIVE {PANEL_SQL}, {SHOCKS_SQL}, {GREEDY_SQL}, k AS (SELECT unnest(kept) AS d FROM rec WHERE r = (SELECT max(r) FROM rec)) SELECT d, d IN (SELECT d FROM k) AS kept FROM cand")
def greedy_spacing(spark, sf):  # noqa: ANN001, ANN201
    cand = shocks_of(spark, sf).select("d").join(V.panel(spark, sf).select("d", "crisis"), "d")
    return S.spaced(cand, 21, [F.col("crisis").desc(), F.col("d").desc()]).select("d", "kept")


GREEDY_LIST = "CASE WHEN len(list_filter(kept, lambda k: abs(k - c.d) <= {gap})) > 0 {more}THEN kept ELSE list_append(kept, c.d) END"
NONOVERLAP_SQL = f"""{DENSE_SQL}, manual AS (SELECT d FROM dense WHERE day(d) = 15 AND month(d) % 6 = 0), near AS (SELECT DISTINCT d + CAST(k AS INT) AS d FROM manual, range(-14, 15) AS r(k)),
lp AS (SELECT d, crisis, coalesce(max(crisis) OVER (ORDER BY d ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 0) AS a, coalesce(max(crisis) OVER (ORDER BY d ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), 0) AS b FROM dense),
cand AS (SELECT d, crisis, row_number() OVER (ORDER BY crisis DESC, d DESC) AS r FROM lp WHERE crisis >= a AND crisis >= b AND d NOT IN (SELECT d FROM near) AND crisis >= (SELECT coalesce(quantile_cont(CAST(crisis AS DOUBLE), 0.99) FILTER (crisis > 0), 0) FROM dense)),
rec AS (SELECT CAST(0 AS BIGINT) AS r, CAST([] AS DATE[]) AS kept UNION ALL SELECT rec.r + 1, {GREEDY_LIST.format(gap=21, more='OR len(kept) >= 80 ')} FROM rec JOIN cand c ON c.r = rec.r + 1),
auto AS (SELECT unnest(kept) AS d FROM rec WHERE r = (SELECT max(r) FROM rec)),
ent AS (SELECT *, row_number() OVER (ORDER BY priority DESC, score DESC, d DESC) AS r FROM (SELECT d, 3 AS priority, 1e18 AS score FROM manual UNION ALL SELECT d, 1, CAST(crisis AS DOUBLE) FROM cand JOIN auto USING (d))),
rec2 AS (SELECT CAST(g AS INT) AS gap, CAST(0 AS BIGINT) AS r, CAST([] AS DATE[]) AS kept FROM (VALUES (30), (45), (60)) AS v(g) UNION ALL SELECT gap, rec2.r + 1, {GREEDY_LIST.format(gap='gap', more='')} FROM rec2 JOIN ent c ON c.r = rec2.r + 1),
k AS (SELECT gap, unnest(kept) AS k FROM rec2 WHERE r = (SELECT max(r) FROM rec2))"""


@query(f"WITH RECURSIVE {NONOVERLAP_SQL} SELECT gap, d, priority, score, bool_or(k = d) AS kept, CASE WHEN NOT bool_or(k = d) THEN arg_min(k, (abs(k - d), k)) END AS nearest FROM ent, k GROUP BY gap, d, priority, score")
def nonoverlap_catalog(spark, sf):  # noqa: ANN001, ANN201
    dense = V.dense(spark, sf)
    manual = dense.where((F.dayofmonth("d") == 15) & (F.month("d") % 6 == 0)).select("d")
    auto = S.auto_candidates(dense, manual).where("kept").select("d", F.lit(1).alias("priority"), F.col("crisis").cast("double").alias("score"))
    entries = manual.select("d", F.lit(3).alias("priority"), F.lit(1e18).alias("score")).unionByName(auto)
    return S.non_overlapping(entries, [30, 45, 60])


@query(f"WITH {PANEL_SQL}, {SHOCKS_SQL}, s AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS i, count(*) OVER () AS n FROM shocks) SELECT d FROM s WHERE n <= 12 OR i IN (SELECT CAST(k * (n - 1) // 11 AS BIGINT) FROM range(12) AS r(k))")
def downsample_even(spark, sf):  # noqa: ANN001, ANN201
    return S.downsample(shocks_of(spark, sf), 12)


RANGES_SQL = "rng AS (SELECT l_suppkey AS q, CAST(min(l_shipdate) AS DATE) AS a, CAST(min(l_shipdate) AS DATE) + CAST(count(*) % 40 AS INT) AS b FROM lineitem GROUP BY l_suppkey)"


def _ranges(spark: SparkSession, sf: str) -> DataFrame:
    g = V.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("query")).agg(F.min("l_shipdate").cast("date").alias("start"), F.count("*").alias("n"))
    return g.select("query", "start", F.date_add("start", (F.col("n") % 40).cast("int")).alias("end"))


@query(f"WITH {RANGES_SQL} SELECT DISTINCT CAST(unnest(generate_series(greatest(a, DATE '1995-01-10'), least(b, DATE '1995-03-10'), INTERVAL 1 DAY)) AS DATE) AS d FROM rng")
def range_expand(spark, sf):  # noqa: ANN001, ANN201
    return G.failed_days(_ranges(spark, sf), F.lit("1995-01-10").cast("date"), F.lit("1995-03-10").cast("date"))


@query(f"WITH {RANGES_SQL}, s AS (SELECT q, a + CAST(7 * k AS INT) AS s, b, CAST(k AS INT) AS k FROM rng, range(0, 7) AS r(k)) SELECT q AS query, s AS start, least(b, s + 6) AS \"end\", k AS part FROM s WHERE s <= b")
def range_slice(spark, sf):  # noqa: ANN001, ANN201
    return G.slice_ranges(_ranges(spark, sf), 7)


@query(f"WITH {RANGES_SQL} SELECT q AS query, CASE WHEN b = a THEN a ELSE a + CAST((b - a + 1) // 2 - 1 AS INT) END AS left_end, CASE WHEN b > a THEN a + CAST((b - a + 1) // 2 AS INT) END AS right_start FROM rng")
def range_bisect(spark, sf):  # noqa: ANN001, ANN201
    r = _ranges(spark, sf).withColumn("h", G.split_range(F.col("start"), F.col("end")))
    return r.select("query", F.col("h")[0]["end"].alias("left_end"), F.try_element_at("h", F.lit(2))["start"].alias("right_start"))


@query(f"WITH {RANGES_SQL}, s AS (SELECT q, a + CAST(7 * k AS INT) AS s, b FROM rng, range(0, 7) AS r(k)) SELECT q AS query, s AS start, least(b, s + 6) AS \"end\", CAST(least(b, s + 6) - s + 1 AS INT) AS days FROM s WHERE s <= b")
def replay_jobs(spark, sf):  # noqa: ANN001, ANN201
    failed = _ranges(spark, sf).withColumns({"run_id": F.lit("r1"), "ord": F.col("query")})
    return G.collect_jobs(failed, 7).select("query", "start", "end", "days")


HIST_SQL = "h AS (SELECT o_orderkey AS ord, CAST(o_custkey % 200 AS VARCHAR) AS query, o_orderdate AS at_, CASE o_orderstatus WHEN 'F' THEN 'full_success' WHEN 'O' THEN 'failed' ELSE 'partial_success' END AS status FROM orders)"


@query(f"WITH {HIST_SQL}, l AS (SELECT query, arg_max(status, (at_, -ord)) AS status, max(at_) AS at_ FROM h GROUP BY query), j AS (SELECT CAST(k AS VARCHAR) AS query FROM range(0, 250) AS r(k)) SELECT j.query, CASE WHEN status = 'full_success' THEN 'already_full_success' WHEN status IN ('failed', 'partial_success') AND epoch(TIMESTAMP '2001-07-01 00:00:00' - at_) / 3600 < 6 THEN 'cooldown_active' END AS skip FROM j LEFT JOIN l USING (query)")
def replay_history(spark, sf):  # noqa: ANN001, ANN201
    fixed = {"start": F.lit("a"), "end": F.lit("b"), "policy": F.lit("strict")}
    h = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("ord"), (F.col("o_custkey") % 200).cast("string").alias("query"), F.col("o_orderdate").alias("at"), F.when(F.col("o_orderstatus") == "F", "full_success").when(F.col("o_orderstatus") == "O", "failed").otherwise("partial_success").alias("status")).withColumns(fixed)
    jobs = spark.range(250).select(F.col("id").cast("string").alias("query")).withColumns(fixed)
    return G.replay_filter(jobs, h, F.lit("2001-07-01 00:00:00").cast("timestamp")).select("query", "skip")


@query("WITH r AS (SELECT CAST(o_custkey % 300 AS VARCHAR) AS signature, o_orderdate + to_hours(CAST(o_orderkey % 24 AS INT)) AS at_, o_orderstatus = 'F' AS passed FROM orders), n AS (SELECT signature, max(at_) AS at_ FROM r GROUP BY signature), j AS (SELECT n.signature, n.at_, count(*) FILTER (CAST(r.at_ AS DATE) < CAST(n.at_ AS DATE)) AS earlier_runs, count(*) FILTER (CAST(r.at_ AS DATE) = CAST(n.at_ AS DATE) AND r.at_ < n.at_ AND passed) AS same_day_passed FROM n JOIN r USING (signature) GROUP BY ALL) SELECT signature, strftime(at_, '%Y-%m-%d %H') AS \"at\", earlier_runs, same_day_passed, earlier_runs > 0 OR same_day_passed > 0 AS reproduced FROM j")
def reproducibility(spark, sf):  # noqa: ANN001, ANN201
    o = V.table(spark, sf, "orders")
    runs = o.select((F.col("o_custkey") % 300).cast("string").alias("signature"), F.expr("o_orderdate + make_dt_interval(0, cast(o_orderkey % 24 AS int), 0, 0)").alias("at"), (F.col("o_orderstatus") == "F").alias("passed"))
    out = G.reproducibility(runs, runs.groupBy("signature").agg(F.max("at").alias("at")))
    return out.withColumn("at", F.date_format("at", "yyyy-MM-dd HH"))
