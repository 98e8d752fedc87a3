"""Queries of the review: matches under quotas, leads, the mechanism and what it all amounts to, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SEED
from ..operators import draws as D
from ..operators import events as EV
from ..operators import gates as G
from ..operators import matching as M
from ..operators import models as MD
from ..operators import permute as T
from ..sources import views as V
from . import models, records
from .records import CLAIM_SQL, LAG_SQL, PAIR_SQL, TODAY, names_official_sql

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def claims(spark: SparkSession, sf: str, items: DataFrame | None = None) -> DataFrame:
    return EV.collapse_claims(records.corroborated(spark, sf, items=items))


def history(spark: SparkSession, sf: str) -> DataFrame:
    """Curated cases, one for each nation: ``title, date, region, government_action, gap_days``."""
    k = F.col("n_nationkey")
    region = F.when(F.col("n_regionkey") == 0, "us").when(F.col("n_regionkey") == 1, " USA ").when(F.col("n_regionkey") >= 3, "UK")
    return V.table(spark, sf, "nation").select(F.col("n_name").alias("title"), F.date_add(F.lit("2023-08-01").cast("date"), (k * 11).cast("int")).alias("date"), region.alias("region"), (k % 3 == 0).alias("government_action"), F.when(k % 11 != 0, (k % 9 - 4).cast("double")).alias("gap_days"))


HISTORY_SQL = "hist AS (SELECT n_name AS title, DATE '2023-08-01' + CAST(n_nationkey * 11 AS INT) AS date, CASE WHEN n_regionkey = 0 THEN 'us' WHEN n_regionkey = 1 THEN ' USA ' WHEN n_regionkey >= 3 THEN 'UK' END AS region, n_nationkey % 3 = 0 AS act, CASE WHEN n_nationkey % 11 <> 0 THEN CAST(n_nationkey % 9 - 4 AS DOUBLE) END AS gap FROM nation)"
#: The sequential choice, pair after pair, over the sorted candidates ``cand (l, r, gap, score)``.
GREEDY_SQL = """o AS (SELECT *, row_number() OVER (ORDER BY gap < 0, abs(gap), -score, l, r) AS k FROM cand),
rec AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS VARCHAR[]) AS ls, CAST([] AS VARCHAR[]) AS rs, false AS took UNION ALL SELECT o.k, CASE WHEN ok THEN list_append(ls, l) ELSE ls END, CASE WHEN ok THEN list_append(rs, r) ELSE rs END, ok FROM (SELECT rec.ls, rec.rs, o.*, len(list_filter(rec.ls, lambda x: x = o.l)) < 3 AND len(list_filter(rec.rs, lambda x: x = o.r)) < 2 AS ok FROM rec JOIN o ON o.k = rec.k + 1) o)
SELECT l, r, gap, score FROM o JOIN rec USING (k) WHERE took"""


def known(events: DataFrame, category: str) -> DataFrame:
    """Events of at least medium confidence as one side of a match."""
    return events.where((F.col("category") == category) & (F.col("final_score") >= 60)).select(F.col("fingerprint").alias("id"), "date", F.col("final_score").alias("score"))


@query(f"WITH RECURSIVE {CLAIM_SQL}, ev AS (SELECT category, fingerprint AS id, date, final_score AS score FROM best WHERE final_score >= 60 AND date IS NOT NULL), cand AS (SELECT c.id AS l, u.id AS r, CAST(u.date - c.date AS INT) AS gap, CAST(u.score + c.score AS BIGINT) AS score FROM ev c JOIN ev u ON c.category = 'crisis' AND u.category = 'ufo' AND abs(u.date - c.date) <= 60), {GREEDY_SQL}")
def quota_matches(spark: SparkSession, sf: str) -> DataFrame:
    """Claims of crises against claims of outcomes within 60 days either way: three for each crisis and two for each outcome at most."""
    e = claims(spark, sf).select("category", "fingerprint", "date", "final_score")
    return M.temporal_correlations(known(e, "crisis"), known(e, "ufo"))


QUOTA_SQL = f"""{CLAIM_SQL}, ev AS (SELECT category, fingerprint AS id, date, final_score AS score FROM best WHERE final_score >= 60 AND date IS NOT NULL), cand AS (SELECT c.id AS l, u.id AS r, CAST(u.date - c.date AS INT) AS gap, CAST(u.score + c.score AS BIGINT) AS score FROM ev c JOIN ev u ON c.category = 'crisis' AND u.category = 'ufo' AND abs(u.date - c.date) <= 60),
{GREEDY_SQL.rpartition("SELECT l, r")[0].rstrip()},
qp AS (SELECT ev.date AS a, ev.date + gap AS b FROM o JOIN rec USING (k) JOIN ev ON ev.category = 'crisis' AND ev.id = l WHERE took)"""
GAP_SQL = "gs AS (SELECT count(*) AS n, round(coalesce(avg(b - a), 0), 6) AS mean_gap, round(coalesce(avg(abs(b - a)), 0), 6) AS mean_abs, count(*) FILTER (b - a BETWEEN 0 AND 30) AS within_30, count(*) FILTER (b - a BETWEEN 0 AND 60) AS within_60, count(*) FILTER (b >= a) AS positive, count(*) FILTER (b < a) AS negative FROM qp)"


def matched_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """``a, b``: the days of crises and of the outcomes matched to them under quotas."""
    e = claims(spark, sf).select("category", "fingerprint", "date", "final_score")
    crises = known(e, "crisis")
    pairs = M.temporal_correlations(crises, known(e, "ufo"))
    return pairs.join(crises.select(F.col("id").alias("l"), F.col("date").alias("a")), "l").select("a", F.date_add("a", F.col("gap")).alias("b"))


@query(f"WITH RECURSIVE {QUOTA_SQL}, {GAP_SQL} SELECT * FROM gs")
def gap_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return T.gap_stats(matched_pairs(spark, sf)).select("n", F.round("mean_gap", 6).alias("mean_gap"), F.round("mean_abs", 6).alias("mean_abs"), "within_30", "within_60", "positive", "negative")


PAIRINGS = 20_000


@query(
    f"""WITH RECURSIVE {QUOTA_SQL}, {GAP_SQL}, hb AS MATERIALIZED (SELECT n, {D.HALF_SQL} AS h FROM gs), pa AS MATERIALIZED (SELECT a, row_number() OVER (ORDER BY a) - 1 AS r FROM qp), pb AS MATERIALIZED (SELECT b, row_number() OVER (ORDER BY b) - 1 AS x FROM qp),
walk AS (SELECT draw, r, {D.network_sql('r', 'draw', SEED, 'h')} AS x FROM range(0, {PAIRINGS}) AS t(draw), pa, hb UNION ALL SELECT draw, r, {D.network_sql('x', 'draw', SEED, 'h')} FROM walk, hb WHERE x >= n),
nu AS (SELECT draw, sum(abs(b - a)) AS t, count(*) FILTER (b - a BETWEEN 0 AND 30) AS w30, count(*) FILTER (b - a BETWEEN 0 AND 60) AS w60 FROM walk JOIN pa USING (r) JOIN pb USING (x) GROUP BY draw)
SELECT (SELECT n FROM gs) AS n, count(*) AS draws, coalesce(avg(CAST(t <= (SELECT sum(abs(b - a)) FROM qp) AS INT)), 1) AS p_abs, coalesce(avg(CAST(w30 >= (SELECT within_30 FROM gs) AS INT)), 1) AS p_30, coalesce(avg(CAST(w60 >= (SELECT within_60 FROM gs) AS INT)), 1) AS p_60,
  (SELECT CASE WHEN any_value(n) IS NULL THEN 1 ELSE round(sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2))), 6) END FROM gs, range(0, 100000) AS s(i) WHERE i BETWEEN positive AND n) AS p_direction FROM nu"""
)
def pairing_permutation(spark: SparkSession, sf: str) -> DataFrame:
    """How often pairing the matched days anew comes as close as they are."""
    got = T.pairing_of(matched_pairs(spark, sf), PAIRINGS, SEED)
    return MD.record(spark, {k: got[k] for k in ("n", "draws", "p_abs", "p_30", "p_60")} | {"p_direction": round(got["p_direction"], 6)})


@query(f"WITH RECURSIVE {CLAIM_SQL}, {HISTORY_SQL}, cand AS (SELECT h.title AS l, u.fingerprint AS r, CAST(u.date - h.date AS INT) AS gap, CAST(u.final_score AS BIGINT) AS score FROM hist h JOIN best u ON u.category = 'ufo' AND u.final_score >= 60 AND abs(u.date - h.date) <= 60 WHERE h.date >= DATE '{TODAY}' - 180), {GREEDY_SQL}")
def history_matches(spark: SparkSession, sf: str) -> DataFrame:
    """Curated cases of the last 180 days against claims, under the same quotas."""
    recent = history(spark, sf).where(F.col("date") >= F.date_sub(records.today(), 180)).select(F.col("title").alias("id"), "date", F.lit(0).alias("score"))
    return M.temporal_correlations(recent, known(claims(spark, sf), "ufo"))


LEAD_SQL = f"{LAG_SQL}, dg AS (SELECT why.*, cluster_size, best.date, coalesce(lag_days >= 0, false) AS lead_day, coalesce(lag_days > 0 OR (lag_days = 0 AND lag_hours > 0), false) AS lead_strict FROM why JOIN agg USING (category, fingerprint) JOIN best USING (category, fingerprint) WHERE category = 'ufo')"


def diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    return EV.lead_diagnostics(EV.lag_metrics(claims(spark, sf).where("category = 'ufo'")))


@query(f"WITH {LEAD_SQL} SELECT fingerprint, lag_days, lead_day, lead_strict, reason, row_number() OVER (ORDER BY NOT lead_strict, NOT lead_day, coalesce(-lag_days, 999), -cluster_size, coalesce(CAST(date AS VARCHAR), ''), fingerprint) AS place FROM dg ORDER BY place LIMIT 200")
def lead_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    """The first 200 events, as a report."""
    df = diagnostics(spark, sf).orderBy("place").limit(200).select("fingerprint", "lag_days", "lead_day", "lead_strict", "reason", F.col("place").alias("_p"))
    return df.withColumn("place", F.row_number().over(M.W.orderBy("_p"))).drop("_p")  # 200 rows


@query(f"WITH {LEAD_SQL} SELECT count(*) AS events, count(*) FILTER (n_off > 0) AS with_official, count(*) FILTER (n_med > 0) AS with_media, count(lag_days) AS with_lag_days, count(lag_hours) AS with_lag_hours, count(*) FILTER (lead_day) AS lead_day, count(*) FILTER (lead_strict) AS lead_strict FROM dg")
def lead_summary(spark: SparkSession, sf: str) -> DataFrame:
    return EV.lead_summary(diagnostics(spark, sf))


@query(f"WITH {LEAD_SQL} SELECT reason, count(*) AS n FROM dg GROUP BY reason ORDER BY n DESC, reason LIMIT 10")
def lead_blockers(spark: SparkSession, sf: str) -> DataFrame:
    return diagnostics(spark, sf).groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "reason").limit(10)


PAIR_BEST_SQL = f"{PAIR_SQL}, bp AS (SELECT * FROM tr QUALIFY row_number() OVER (PARTITION BY m_ord ORDER BY CASE tier WHEN 'strict' THEN 0 WHEN 'proxy_strict' THEN 1 WHEN 'balanced' THEN 2 ELSE 3 END, semantic DESC, CASE WHEN lag_days = 0 THEN 9999 ELSE lag_days END, o_ord) = 1), ps AS (SELECT count(*) AS pairs, count(*) FILTER (tier = 'strict') AS strict, count(*) FILTER (tier = 'proxy_strict') AS proxy_strict, count(*) FILTER (tier = 'balanced') AS balanced, count(*) FILTER (tier = 'strict' AND lag_days >= 0) AS strict_nonnegative, count(*) FILTER (tier = 'strict' AND lag_days > 0) AS strict_positive, count(*) FILTER (tier = 'proxy_strict' AND lag_days > 0) AS proxy_positive, count(*) FILTER (tier = 'strict' AND pa IS NOT NULL) AS strict_timed, count(*) FILTER (pub <> '') AS with_publisher, count(DISTINCT o_ord) FILTER (tier = 'strict') AS followed_officials FROM bp)"


@query(f"WITH {PAIR_BEST_SQL} SELECT * FROM ps")
def pair_summary(spark: SparkSession, sf: str) -> DataFrame:
    return G.pair_summary(M.official_media_pairs(records.scored(spark, sf)))


@query(f"WITH {HISTORY_SQL}, u AS (SELECT coalesce(act, false) AS act, coalesce(gap >= 0, false) AS pos FROM hist WHERE upper(trim(coalesce(region, 'USA'))) IN ('USA', 'US')) SELECT count(*) AS events, count(*) FILTER (act) AS government_action, round(coalesce(avg(CAST(act AS INT)), 0), 6) AS government_action_share, count(*) FILTER (pos) AS positive_gap, round(coalesce(avg(CAST(pos AS INT)), 0), 6) AS positive_gap_share, count(*) FILTER (act AND pos) AS \"both\" FROM u")
def historical_mechanism(spark: SparkSession, sf: str) -> DataFrame:
    return G.historical_mechanism(history(spark, sf))


HIST_TOTALS = "hm AS (SELECT count(*) AS he, count(*) FILTER (act) AS ho FROM hist WHERE upper(trim(coalesce(region, 'USA'))) IN ('USA', 'US'))"
MECH_SQL = f"""{LAG_SQL}, {PAIR_BEST_SQL[PAIR_BEST_SQL.index('pr AS ('):]}, {HISTORY_SQL}, {HIST_TOTALS},
src AS (SELECT category, fingerprint, bool_or({names_official_sql('source')}) AS any_off, bool_or(NOT {names_official_sql('source')}) AS any_other FROM corr GROUP BY ALL),
me AS (SELECT {names_official_sql('best.source')} AS prim, any_off, any_other, lag_days FROM best JOIN src USING (category, fingerprint) JOIN lags USING (category, fingerprint) WHERE category = 'ufo'),
mm AS (SELECT count(*) AS events, count(*) FILTER (any_off) AS official_involved, count(*) FILTER (prim) AS official_primary, count(*) FILTER (prim AND any_other) AS official_primary_followed, count(*) FILTER (NOT prim AND any_off) AS media_primary_official_second, count(lag_days) AS lags_known, count(*) FILTER (lag_days >= 0) AS lag_leads, round(avg(lag_days), 6) AS lag_mean, round(quantile_cont(lag_days, 0.5), 6) AS lag_q50 FROM me),
mt AS (SELECT mm.*, ps.*, he AS history_events, ho AS history_official, events + he AS effective_events, round(CASE WHEN events + he > 0 THEN (official_involved + ho) / (events + he) ELSE 0 END, 6) AS effective_share, CASE WHEN strict_positive > 0 THEN strict_positive ELSE strict_nonnegative END AS pl FROM mm, ps, hm),
mx AS (SELECT * EXCLUDE (pl), CASE WHEN lags_known > 0 THEN lag_leads WHEN pl > 0 THEN pl ELSE official_primary_followed END AS lead_events, CASE WHEN lags_known > 0 THEN 'lag' WHEN pl > 0 THEN 'pair_strict_lag' ELSE 'source_order' END AS lead_basis FROM mt)"""


def mechanism_of(spark: SparkSession, sf: str, items: DataFrame | None = None) -> DataFrame:
    """``items`` are those of :func:`records.scored_table`, which are scored once for claims and pairs."""
    items = records.scored_table(spark, sf) if items is None else items
    e = EV.lag_metrics(claims(spark, sf, items).where("category = 'ufo'")).select(F.col("source").alias("primary_source"), "sources", "lag_days")
    h = G.historical_mechanism(history(spark, sf)).select("events", "government_action")
    return G.mechanism(e, h, G.pair_summary(M.official_media_pairs(items)))


@query(f"WITH {MECH_SQL} SELECT *, effective_events >= 3 AND effective_share >= 0.3 AND lead_events >= 1 AS passed FROM mx")
def mechanism_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return mechanism_of(spark, sf)


PROFILE_SQL = "pf_ AS (SELECT * FROM (VALUES ('strict_primary', 12, 0.9, 1), ('balanced_proxy', 10, 0.8, 2), ('exploratory_proxy', 8, 0.7, 3)) AS v(profile, least_events, least_share, modes)), pp_ AS (SELECT *, greatest(lead_events, CASE WHEN modes >= 2 THEN proxy_positive ELSE 0 END, CASE WHEN modes >= 3 THEN official_primary_followed ELSE 0 END) AS profile_leads FROM mx, pf_), pq_ AS (SELECT *, effective_events >= least_events AND effective_share >= least_share AND profile_leads >= 1 AS profile_passed FROM pp_)"


@query(f"WITH {MECH_SQL}, {PROFILE_SQL} SELECT profile, least_events, CAST(least_share AS DOUBLE) AS least_share, profile_leads, profile_passed, CASE WHEN (SELECT profile_passed FROM pq_ WHERE profile = 'strict_primary') THEN 'not_over_strict' WHEN (SELECT bool_or(profile_passed) FROM pq_ WHERE profile <> 'strict_primary') THEN 'conservative_but_not_excessive' ELSE 'evidence_limited' END AS judgement FROM pq_")
def mechanism_sensitivity(spark: SparkSession, sf: str) -> DataFrame:
    m = mechanism_of(spark, sf).select("effective_events", "effective_share", "lead_events", "proxy_positive", "official_primary_followed")
    return G.sensitivity(m, 12, 0.9, 1).select("profile", "least_events", "least_share", "profile_leads", "profile_passed", "judgement")


@query("SELECT o_custkey AS k, CASE WHEN o_custkey % 7 = 0 THEN 'NO_TEMPORAL_SIGNAL' WHEN NOT (o_custkey % 2 = 0 AND o_custkey % 3 <> 0) THEN 'TEMPORAL_ASSOCIATION_ONLY' WHEN o_custkey % 5 <> 0 THEN 'CAUSAL_SIGNAL_WITHOUT_STRATEGIC_MECHANISM' ELSE 'STRATEGIC_COMMUNICATION_INDICATION' END AS level FROM orders GROUP BY o_custkey")
def inference_rules(spark: SparkSession, sf: str) -> DataFrame:
    """The rules on states of every kind, one for each customer with orders."""
    k = F.col("o_custkey")
    return V.table(spark, sf, "orders").select("o_custkey").distinct().select(k.alias("k"), G.inference(k % 7 != 0, k % 2 == 0, k % 3 != 0, k % 5 == 0).alias("level"))


@query()
def inference_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """The level of evidence that panel, models and mechanism amount to."""
    a = models.approval_gates(spark, sf).select("status", "verdict")
    d = models.did_gate(spark, sf).select(F.col("passed").alias("did_passed"), (F.col("control_violations") == 0).alias("controls_clean"))
    m = mechanism_of(spark, sf).select(F.col("passed").alias("mechanism_passed"))
    df = a.join(F.broadcast(d)).join(F.broadcast(m))  # a row each
    temporal = F.col("verdict") != "correlation_or_weak"
    return df.select("status", "verdict", "did_passed", "mechanism_passed", G.inference(temporal, F.col("status") == "APPROVED", F.col("did_passed") & F.col("controls_clean"), F.col("mechanism_passed")).alias("level"))
