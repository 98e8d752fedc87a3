"""Queries of audits, country controls and the review's rules, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..operators import audit as A
from ..operators import country as CO
from ..operators import gates as G
from ..operators import review as RV
from ..sources import views as V
from . import models, records, review, series
from .records import any_sql

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
TODAY = "2001-01-15"


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def today():  # noqa: ANN201
    return F.lit(TODAY).cast("date")


def audited(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Sources, their status, items and runs: suppliers as sources, shipments up to today as items and as runs, whose return flag says how they ended."""
    k = F.col("s_suppkey")
    sources = V.table(spark, sf, "supplier").select(k.alias("source"), F.concat(F.lit("c"), (k % 4).cast("string")).alias("category"), F.when(k % 3 != 0, "rss").otherwise("json").alias("type"), (k % 4).cast("int").alias("weight"), (k % 6 != 0).alias("active"), k.alias("ord"))
    runs = V.table(spark, sf, "lineitem").where(F.col("l_shipdate") < F.date_add(today(), 1)).select(F.col("l_suppkey").alias("source"), F.col("l_shipdate").alias("at"), F.when(F.col("l_returnflag") == "R", "failed").when(F.col("l_returnflag") == "A", "ok").otherwise("empty").alias("status"), F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey").alias("o"))
    last = runs.groupBy("source").agg(F.max_by("status", "o").alias("status"), F.count("*").alias("item_count"))
    error = F.element_at(F.array(*map(F.lit, ("connection timed out", "http 503", "xml parse", "odd"))), (F.col("source") % 4 + 1).cast("int"))
    failed = F.col("status") == "failed"
    status = sources.where("active").join(last, "source", "left").select("source", "category", "type", "weight", "ord", F.coalesce("status", F.lit("failed")).alias("status"), F.coalesce("item_count", F.lit(0)).alias("item_count"), F.when(failed | F.col("status").isNull(), error).alias("error"), (F.col("source") % 9 == 0).alias("used_fallback"), F.when(F.col("source") % 5 == 0, "http://a.b/c").alias("fallback_url"), F.when(F.col("source") % 7 == 0, F.array(F.lit("u"))).alias("fallback_urls"))
    items = runs.where(F.col("source") % 13 != 0).select("source", F.to_date("at").alias("date"))
    return sources.withColumnRenamed("source", "name"), status, items, runs.drop("o")


AUDIT_SQL = f"""su AS (SELECT s_suppkey AS source, 'c' || (s_suppkey % 4) AS category, CASE WHEN s_suppkey % 3 <> 0 THEN 'rss' ELSE 'json' END AS type, CAST(s_suppkey % 4 AS INT) AS weight, s_suppkey % 6 <> 0 AS active FROM supplier),
ru AS (SELECT l_suppkey AS source, l_shipdate AS at_, CASE l_returnflag WHEN 'R' THEN 'failed' WHEN 'A' THEN 'ok' ELSE 'empty' END AS status, (l_shipdate, l_orderkey, l_linenumber, l_partkey) AS o FROM lineitem WHERE l_shipdate < DATE '{TODAY}' + 1),
la AS (SELECT source, arg_max(status, o) AS status, count(*) AS item_count FROM ru GROUP BY source),
st AS (SELECT su.source, category, type, weight, coalesce(status, 'failed') AS status, coalesce(item_count, 0) AS item_count, CASE WHEN coalesce(status, 'failed') = 'failed' THEN ['timeout', 'http_5xx', 'parse_error', 'other'][CAST(su.source % 4 + 1 AS INT)] END AS kind, su.source % 9 = 0 AS used_fallback, su.source % 5 = 0 OR su.source % 7 = 0 AS has_fallback FROM su LEFT JOIN la ON la.source = su.source WHERE active),
sp AS (SELECT source, CAST(min(at_) AS DATE) AS min_date, CAST(max(at_) AS DATE) AS max_date FROM ru WHERE source % 13 <> 0 GROUP BY source),
wi AS (SELECT st.*, min_date, max_date, CAST(coalesce(max_date - min_date + 1, 0) AS INT) AS span_days, coalesce(max_date >= DATE '{TODAY}' - 3, false) AS has_recent_items FROM st LEFT JOIN sp ON sp.source = st.source)"""


@query(f"WITH {AUDIT_SQL}, ls AS (SELECT source, max(at_) FILTER (status <> 'failed') AS last_success FROM ru GROUP BY source) SELECT wi.source, wi.status, item_count, min_date, max_date, span_days, has_recent_items, used_fallback, CAST(last_success AS DATE) AS last_success, (SELECT count(*) FROM ru WHERE ru.source = wi.source AND ru.status = 'failed' AND (last_success IS NULL OR ru.at_ > last_success)) AS failures_since FROM wi LEFT JOIN ls ON ls.source = wi.source")
def source_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Each source's status beside what it delivered, and its last success."""
    _, status, items, runs = audited(spark, sf)
    out = A.with_last_success(A.source_windows(status, items, today()), runs, F.date_add(today(), 1).cast("timestamp"))
    return out.select("source", "status", "item_count", "min_date", "max_date", "span_days", "has_recent_items", "used_fallback", F.to_date("last_success").alias("last_success"), "failures_since")


@query(f"WITH {AUDIT_SQL}, c AS (SELECT count(*) AS sources_total, count(*) FILTER (status <> 'failed') AS sources_available, count(*) FILTER (has_recent_items) AS sources_with_recent_items FROM wi) SELECT *, CASE WHEN sources_available >= greatest(1, floor(sources_total * 0.9)) AND sources_with_recent_items >= greatest(1, floor(sources_total * 0.7)) THEN 'high' WHEN sources_available >= greatest(1, floor(sources_total * 0.75)) AND sources_with_recent_items >= greatest(1, floor(sources_total * 0.5)) THEN 'medium' ELSE 'low' END AS coverage_confidence FROM c")
def coverage_confidence(spark: SparkSession, sf: str) -> DataFrame:
    _, status, items, _ = audited(spark, sf)
    return A.coverage(A.source_windows(status, items, today()))


@query(f"WITH {AUDIT_SQL}, k AS (SELECT kind, count(*) AS n FROM st WHERE status = 'failed' GROUP BY kind), c AS (SELECT count(*) AS total_active_sources, count(*) FILTER (status <> 'failed') AS available_sources, count(*) FILTER (status = 'ok') AS sources_with_items, count(*) FILTER (status = 'failed') AS failed_sources, count(*) FILTER (used_fallback) AS fallback_used_count FROM st) SELECT *, coalesce((SELECT string_agg(kind || '=' || n, ',' ORDER BY kind) FROM k), '') AS failed_error_types, round(available_sources / total_active_sources, 4) AS availability_rate, round(sources_with_items / total_active_sources, 4) AS success_rate_with_items FROM c")
def source_health_report(spark: SparkSession, sf: str) -> DataFrame:
    kinds = F.transform(F.map_entries("failed_error_types"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return A.health(audited(spark, sf)[1]).withColumn("failed_error_types", F.coalesce(F.array_join(kinds, ","), F.lit("")))


CATEGORY_SQL = "ca AS (SELECT category, count(*) AS active, count(*) FILTER (status <> 'failed') AS available, count(*) FILTER (status = 'ok') AS success_with_items, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (type = 'rss' AND weight >= 2) AS trusted_active, count(*) FILTER (type = 'rss' AND weight >= 2 AND status = 'ok') AS trusted_success_with_items FROM st GROUP BY category)"


@query(f"WITH {AUDIT_SQL}, {CATEGORY_SQL} SELECT * FROM ca")
def source_categories(spark: SparkSession, sf: str) -> DataFrame:
    return A.by_category(audited(spark, sf)[1])


@query(
    f"""WITH {AUDIT_SQL}, {CATEGORY_SQL}, sb AS (SELECT category, list(source ORDER BY weight DESC, source)[1:3] AS backups FROM su WHERE NOT active GROUP BY category),
fa AS (SELECT * FROM st WHERE status = 'failed' ORDER BY source LIMIT 8),
ad AS (SELECT 0 AS part, 0 AS o, category, 'trusted_source_coverage_low' AS issue, NULL AS source, coalesce(backups, []) AS backups FROM ca LEFT JOIN sb USING (category) WHERE trusted_success_with_items < 2 UNION ALL SELECT 1, source, category, 'missing_fallback_url', source, [] FROM fa WHERE type = 'rss' AND NOT has_fallback)
SELECT row_number() OVER (ORDER BY part, o, category) AS place, category, issue, source, array_to_string(backups, ',') AS backups FROM ad ORDER BY place LIMIT 12"""
)
def source_recommendations(spark: SparkSession, sf: str) -> DataFrame:
    """At most twelve, as a report."""
    sources, status, _, _ = audited(spark, sf)
    return A.recommendations(status, sources).withColumn("backups", F.array_join(F.transform("backups", lambda b: b.cast("string")), ","))


@query("SELECT l_shipinstruct AS reason, n, row_number() OVER (ORDER BY n DESC, f) AS place FROM (SELECT r AS l_shipinstruct, count(*) AS n, min((ord, k)) AS f FROM (SELECT event_id AS ord, unnest(range(2)) AS k, unnest([event_type, json_extract_string(props, '$.k')]) AS r FROM events) WHERE r IS NOT NULL GROUP BY r) ORDER BY place LIMIT 10")
def top_reasons(spark: SparkSession, sf: str) -> DataFrame:
    """The ten most frequent of joined reasons, of equals the one seen first."""
    e = V.table(spark, sf, "events")
    return A.reject_reasons(e.select(F.col("event_id").alias("ord"), F.concat_ws(" , ", "event_type", F.get_json_object("props", "$.k")).alias("reason")))


ZONE = "America/New_York"


def country_feeds(spark: SparkSession, sf: str) -> DataFrame:
    """A feed of one entry for each document: a headline, the text's first words in front of a keyword, and a time near midnight."""
    i = F.col("doc_id")
    title = F.element_at(F.array(*map(F.lit, V.HEADLINES)), ((i * 5 + F.floor(i / 7)) % len(V.HEADLINES) + 1).cast("int"))
    when = F.concat(F.lpad((1 + i % 28).cast("string"), 2, "0"), F.lit(" Feb 2024 "), F.when(i % 2 == 0, "23:30:00 -0500").otherwise("02:00:00 GMT"))
    desc = F.when(i % 3 == 0, "an indictment").when(i % 3 == 1, "an official hearing").otherwise("nothing")
    payload = F.concat(F.lit("<rss><channel><item><title>"), F.when(i % 17 != 0, title).otherwise(""), F.lit("</title><pubDate>"), F.when(i % 19 != 0, when).otherwise("soon"), F.lit("</pubDate><description>"), desc, F.lit("</description></item></channel></rss>"))
    return V.table(spark, sf, "documents").select(F.concat(F.lit("land"), (i % 5).cast("string")).alias("country"), i.alias("source"), payload.alias("payload"))


def _country_sql() -> str:
    title = f"([{', '.join(repr(v) for v in V.HEADLINES)}])[CAST(doc_id * 5 + doc_id // 7 AS BIGINT) % {len(V.HEADLINES)} + 1]"
    body = "lower(title || ' ' || descr)"
    return f"""en AS (SELECT 'land' || (doc_id % 5) AS country, {title} AS title, CASE doc_id % 3 WHEN 0 THEN 'an indictment' WHEN 1 THEN 'an official hearing' ELSE 'nothing' END AS descr, make_date(2024, 2, CAST(1 + doc_id % 28 AS INT)) - CAST(doc_id % 2 AS INT) AS d FROM documents WHERE doc_id % 17 <> 0 AND doc_id % 19 <> 0),
co AS (SELECT d, country, count(*) FILTER ({any_sql(body, C.COUNTRY_UFO)} AND {any_sql(body, C.COUNTRY_POLICY)}) AS ufo_policy_news, count(*) FILTER ({any_sql(body, C.COUNTRY_CRISIS)}) AS crisis_index FROM en GROUP BY ALL),
gr AS (SELECT CAST(g AS DATE) AS d, 'land' || k AS country FROM generate_series(DATE '2024-01-25', DATE '2024-03-05', INTERVAL 1 DAY) AS t(g), range(6) AS c(k))"""


@query(f"WITH {_country_sql()} SELECT gr.d, gr.country, coalesce(ufo_policy_news, 0) AS ufo_policy_news, coalesce(crisis_index, 0) AS crisis_index FROM gr LEFT JOIN co ON co.d = gr.d AND co.country = gr.country")
def country_controls(spark: SparkSession, sf: str) -> DataFrame:
    """Feeds of six countries, one of them without any, by local days on a whole grid."""
    entries = CO.country_entries(country_feeds(spark, sf), ZONE)
    lands = spark.range(6).select(F.concat(F.lit("land"), F.col("id").cast("string")).alias("country"))
    window = CO.grid_window(spark.sql("SELECT DATE'2024-01-25' AS date"), F.lit("2024-03-05").cast("date"))
    return CO.country_controls(entries, lands, window, C.COUNTRY_UFO, C.COUNTRY_POLICY, C.COUNTRY_CRISIS)


#: States of many kinds, one for each customer with orders: the review's rules are held against SQL on them.
GATES = ("observed_days>=180", "shock_days", "observed_ratio>=0.80", "significant_windows>=2", "lead_lag_positive", "reverse_not_dominant")


def review_states(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("k")
    pick = lambda n, *values: F.element_at(F.array(*map(F.lit, values)), (k % n % len(values) + 1).cast("int"))
    ok = lambda n: k % n != 0
    return V.table(spark, sf, "orders").select(F.col("o_custkey").alias("k")).distinct().select(
        "k", F.when(ok(11), "APPROVED").otherwise("REJECTED").alias("approval_status"), F.lit("CAUSAL_SIGNAL").alias("approval_level"),
        G.gate_array({g: ok(23 + 2 * i) for i, g in enumerate(GATES)}).alias("approval_gates"), pick(6, "causal_signal", "windows_but_placebo_fails", "weak_signal").alias("verdict"),
        F.when(ok(13), "strict-balanced").otherwise("strict").alias("scraped_policy"), F.when(ok(9), "strict-balanced").alias("causal_policy"), F.lit("").alias("progress_policy"),
        ((85 + k % 16) / 100).alias("availability"), F.floor(k % 8 / 2).alias("failed_sources"), (k % 40).alias("total_sources"),
        F.when(ok(29), 200 + k % 50).otherwise(0).alias("observed_days"), F.when(ok(31), k % 30 + 1).otherwise(0).alias("shock_days"), ((80 + k % 21) / 100).alias("observed_ratio"), (k % 33).alias("max_missing_streak"),
        pick(4, "catalog", "p90").alias("shock_source"), pick(5, "shock_dates", "", "other").alias("shock_key"), ok(37).alias("has_catalog"), F.when(ok(41), True).alias("has_lock"),
        F.when(ok(43), "a").alias("catalog_signature"), F.when(ok(47), "a").otherwise("b").alias("lock_signature"), F.array(F.lit("shock_dates")).alias("catalog_keys"),
        F.when(ok(17), "stable").otherwise("unstable").alias("dual_status"), F.when(ok(19), F.array(F.struct(F.lit("x").alias("name"), F.lit(True).alias("passed")))).otherwise(F.array().cast("array<struct<name: string, passed: boolean>>")).alias("dual_gates"),
        F.when(ok(14), "ok").alias("did_status"), ok(15).alias("did_passed"), F.when(ok(16), True).alias("did_controls"), F.lit("ok").alias("event_status"), ok(18).alias("event_passed"), F.when(ok(20), "ok").otherwise("few_donors").alias("synth_status"), ok(21).alias("synth_passed"),
        pick(3, "ok", "blocked").alias("ml_status"), (k % 2 == 0).alias("ml_passed"), F.when(k % 10 == 1, False).when(k % 10 == 2, True).alias("ml_ready"),
        (k % 3).alias("n_ufo"), (k % 2).alias("n_crisis"), (k % 5 != 0).alias("mechanism_passed"), F.timestamp_seconds(1_700_000_000 + k % 5 * 3600).alias("generated_at"),
    )


def _pick_sql(n: int, *values: str) -> str:
    return f"([{', '.join(repr(v) for v in values)}])[CAST(k % {n} % {len(values)} + 1 AS INT)]"


LOCK_SQL = f"CASE WHEN {_pick_sql(4, 'catalog', 'p90')} <> 'catalog' THEN 'not_required' WHEN k % 37 = 0 THEN 'catalog_missing_or_invalid' WHEN k % 41 = 0 THEN 'lock_missing_or_invalid' WHEN k % 43 = 0 OR k % 47 = 0 THEN 'catalog_lock_signature_mismatch' WHEN {_pick_sql(5, 'shock_dates', '', 'other')} = 'other' THEN 'panel_shock_key_missing_in_catalog' ELSE 'ok' END"
REVIEW_SQL = f"""ks AS (SELECT DISTINCT o_custkey AS k FROM orders),
g1 AS (SELECT k, {LOCK_SQL} AS lock_reason, k % 11 <> 0 AS approved, k % 23 <> 0 AND k % 25 <> 0 AND k % 27 <> 0 AS sample_gates_passed, k % 29 <> 0 AND k % 31 <> 0 AND k % 33 <> 0 AS directional_gates_passed, 80 + k % 21 >= 85 AND k % 33 <= 30 AS continuity_gate_passed,
  85 + k % 16 >= 90 AND k % 8 // 2 <= CASE WHEN k % 40 > 0 THEN greatest(1, k % 40 // 10) ELSE 0 END AS source_gate_passed, k % 17 <> 0 AND k % 19 <> 0 AS dual_stable_passed, k % 13 <> 0 AS policy_consistency_passed,
  (k % 29 <> 0 AND k % 31 <> 0) OR (k % 3 > 0 AND k % 2 > 0) AS has_temporal_signal, {_pick_sql(6, 'causal_signal', 'windows_but_placebo_fails', 'weak_signal')} <> 'windows_but_placebo_fails' AS verdict_speaks,
  k % 14 <> 0 AND k % 20 <> 0 AND k % 15 <> 0 AND k % 18 <> 0 AND k % 21 <> 0 AND k % 16 <> 0 AND (k % 3 % 2 <> 0 OR k % 2 = 0 OR k % 10 = 1) AS falsification_passed FROM ks),
g2 AS (SELECT *, approved AND sample_gates_passed AND directional_gates_passed AND continuity_gate_passed AND lock_reason IN ('ok', 'not_required') AND source_gate_passed AND dual_stable_passed AND policy_consistency_passed AS core_passed FROM g1),
g3 AS (SELECT *, CASE WHEN NOT (has_temporal_signal OR verdict_speaks) THEN 'NO_TEMPORAL_SIGNAL' WHEN NOT (core_passed AND falsification_passed) THEN 'TEMPORAL_ASSOCIATION_ONLY' WHEN k % 5 = 0 THEN 'CAUSAL_SIGNAL_WITHOUT_STRATEGIC_MECHANISM' ELSE 'STRATEGIC_COMMUNICATION_INDICATION' END AS inference FROM g2)"""


@query(f"WITH {REVIEW_SQL} SELECT k, lock_reason, sample_gates_passed, directional_gates_passed, continuity_gate_passed, source_gate_passed, dual_stable_passed, policy_consistency_passed, has_temporal_signal, core_passed, falsification_passed, inference, CASE inference {' '.join(f'WHEN {n!r} THEN {s[0]!r}' for n, s in RV.NEXT_ACTIONS.items())} END AS next_action FROM g3")
def review_rules(spark: SparkSession, sf: str) -> DataFrame:
    out = RV.assemble(review_states(spark, sf))
    return out.select("k", "lock_reason", "sample_gates_passed", "directional_gates_passed", "continuity_gate_passed", "source_gate_passed", "dual_stable_passed", "policy_consistency_passed", "has_temporal_signal", "core_passed", "falsification_passed", "inference", F.col("next_actions")[0].alias("next_action"))


@query(
    f"""WITH {REVIEW_SQL}, sg AS (SELECT *, (approved, core_passed, falsification_passed, lock_reason IN ('ok', 'not_required'), policy_consistency_passed, k % 15 <> 0, k % 18 <> 0, k % 21 <> 0, k % 2 = 0, CASE WHEN k % 29 <> 0 THEN 200 + k % 50 ELSE 0 END, CASE WHEN k % 31 <> 0 THEN k % 30 + 1 ELSE 0 END, k % 17 <> 0, inference) AS signature, to_timestamp(1700000000 + k % 5 * 3600)::TIMESTAMP AS at_ FROM g3),
hi AS (SELECT signature, at_ - to_hours(CAST(k % 40 AS INT)) AS was, k % 4 = 0 AS passed FROM sg WHERE k % 3 = 0),
ma AS (SELECT k, count(was) AS matched_runs, coalesce(bool_or(CAST(was AS DATE) < CAST(at_ AS DATE)), false) AS cross_day_repeat, coalesce(bool_or(CAST(was AS DATE) = CAST(at_ AS DATE) AND passed), false) AS same FROM sg LEFT JOIN hi USING (signature) GROUP BY k)
SELECT k, matched_runs, cross_day_repeat, cross_day_repeat OR same AS reproduced, CASE WHEN core_passed AND falsification_passed AND (cross_day_repeat OR same) THEN CASE WHEN k % 7 = 0 THEN 'L4' ELSE 'L3' END WHEN core_passed THEN 'L2' WHEN has_temporal_signal OR verdict_speaks THEN 'L1' ELSE 'L0' END AS level FROM sg JOIN ma USING (k)"""
)
def review_levels(spark: SparkSession, sf: str) -> DataFrame:
    """The level of each state, given a history in which some states stand at earlier hours."""
    states = review_states(spark, sf)
    past = RV.assemble(states).where(F.col("k") % 3 == 0)
    history = past.select("signature", F.expr("generated_at - make_dt_interval(0, cast(k % 40 AS int), 0, 0)").alias("at"), (F.col("k") % 4 == 0).alias("passed"))
    return RV.review(states, history, external=F.col("k") % 7 == 0).select("k", "matched_runs", "cross_day_repeat", "reproduced", "level")


@query()
def strict_review(spark: SparkSession, sf: str) -> DataFrame:
    """The review of the tables as they are: approval, sources, both policies, four models and the mechanism, in one row. Its rules are held against SQL in review_rules; draws take too long in SQL."""
    one = lambda df, **names: df.select(*[F.col(v).alias(k) for k, v in names.items()])
    panel = G.verdict(G.approval(models.state_of(spark, sf, models.PERMUTATIONS)))
    items = records.scored_table(spark, sf)
    parts = [
        one(panel, approval_status="status", approval_level="level", approval_gates="gates", verdict="verdict", observed_days="observed_days", shock_days="shock_days", observed_ratio="observed_ratio", max_missing_streak="max_missing_streak"),
        one(A.health(audited(spark, sf)[1]), availability="availability_rate", failed_sources="failed_sources", total_sources="total_active_sources"),
        series.dual_policy_review(spark, sf).select(F.when(F.col("stable"), "stable").otherwise("unstable").alias("dual_status"), G.gate_array({"stable": F.col("stable")}).alias("dual_gates")),
        models.did_gate(spark, sf).select(F.col("status").alias("did_status"), F.col("passed").alias("did_passed"), (F.col("controls_estimated") > 0).alias("did_controls")),
        one(models.event_study_gate(spark, sf), event_status="status", event_passed="passed"),
        one(models.synth_placebo(spark, sf), synth_status="status", synth_passed="passed"),
        models.causal_ml_gate(spark, sf).select(F.col("status").alias("ml_status"), F.col("passed").alias("ml_passed"), F.lit(True).alias("ml_ready")),
        review.mechanism_of(spark, sf, items).select(F.col("passed").alias("mechanism_passed"), F.col("events").alias("n_ufo")),
        items.where(F.size("reasons") == 0).agg(F.count_if(F.col("category") == "crisis").alias("n_crisis")),
    ]
    state = parts[0]
    for p in parts[1:]:
        state = state.join(F.broadcast(p))  # a row each
    fixed = {"scraped_policy": "strict-balanced", "causal_policy": "strict-balanced", "progress_policy": "strict-balanced", "shock_source": "p90", "shock_key": "", "catalog_signature": "", "lock_signature": ""}
    state = state.withColumns({k: F.lit(v) for k, v in fixed.items()} | {"has_catalog": F.lit(False), "has_lock": F.lit(False), "catalog_keys": F.array().cast("array<string>"), "generated_at": F.lit("2024-06-01").cast("timestamp")})
    history = spark.createDataFrame([], "signature string, at timestamp, passed boolean")
    out = RV.review(state, history)
    gates = [c for c in out.columns if c.endswith("_passed") and c not in ("did_passed", "event_passed", "synth_passed", "ml_passed", "mechanism_passed")]
    return out.select("approval_status", "verdict", "did_status", "event_status", "synth_status", "ml_status", *sorted(gates), "inference", F.array_join("next_actions", "; ").alias("next_actions"), "reproduced", "level")
