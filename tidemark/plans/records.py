"""Queries on items, events, pairs, URLs and streams of records, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config as C
from ..config import STRICT_BALANCED
from ..functions import text as T
from ..functions.once import once
from ..operators import events as EV
from ..operators import items as I
from ..operators import matching as M
from ..sources import readers as R
from ..sources import views as V
from ..sources.shared import shared_table
from ..sources.views import ITEMS_SQL

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
TODAY = "2024-04-15"
#: Days between the two events of a pair, either way.
PAIR_DAYS = 60


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def today():  # noqa: ANN201
    return F.lit(TODAY).cast("date")


# the same rules in SQL
def kw_sql(text: str, k: str) -> str:
    return f"regexp_matches({text}, '(^|[^a-z0-9]){k}([^a-z0-9]|$)')" if k.isalnum() else f"contains({text}, '{k}')"


def hits_sql(text: str, words: list[str]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {kw_sql(text, k)} THEN '{k}' END" for k in words) + "], lambda x: x IS NOT NULL)"


def any_sql(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(kw_sql(text, k) for k in words) + ")"


def imm_sql(text: str) -> str:
    return f"({any_sql(text, ['alien', 'aliens'])} AND NOT {any_sql(text, C.ALIEN_ANCHORS)} AND {any_sql(text, C.IMMIGRATION_CONTEXT)})"


def official_sql(source: str) -> str:
    return f"(regexp_matches(lower({source}), '{'|'.join(C.OFFICIAL_HINTS)}') AND NOT contains(lower({source}), 'google news'))"


def names_official_sql(source: str) -> str:
    return f"regexp_matches(lower(coalesce({source}, '')), '{'|'.join(C.OFFICIAL_HINTS)}')"


def tokens_sql(title: str) -> str:
    stop = ", ".join(f"'{w}'" for w in C.CLAIM_STOPWORDS)
    raw = f"regexp_extract_all(lower({title}), '[a-z0-9]+')"
    good = f"list_filter({raw}, lambda w: length(w) > 2 AND w NOT IN ({stop}))"
    pick = f"CASE WHEN len({good}) > 0 THEN {good} ELSE {raw}[1:6] END"
    return f"list_filter({pick}, lambda w, i: list_position({pick}, w) = i)[1:8]"


def chain_sql(pairs: list[tuple[str, str]], other: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in pairs) + f" ELSE {other} END"


def action_sql(text: str) -> str:
    return chain_sql([(any_sql(text, w), f"'{t}'") for t, w in C.ACTIONS.items()], "'na'")


def topic_sql(text: str) -> str:
    nhi = f"{any_sql(text, C.TOPIC_NHI)} AND ({any_sql(text, C.TOPIC_NHI_ANCHORS)} OR NOT {imm_sql(text)})"
    return chain_sql([(any_sql(text, C.TOPIC_UFO), "'ufo_uap'"), (nhi, "'alien_nhi'"), (any_sql(text, C.TOPIC_RETRIEVAL), "'retrieval_claim'"), (any_sql(text, ["aaro"]), "'aaro'")], "'na'")


def first_sql(text: str, words: list[str]) -> str:
    return chain_sql([(kw_sql(text, k), f"'{k}'") for k in words], "'na'")


def longest_sql(text: str, words: list[str]) -> str:
    return first_sql(text, sorted(set(words), key=lambda k: (-len(k), k)))


NORM = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"
CORE = [k for k in C.UFO_KEYWORDS if k not in C.AMBIGUOUS_KEYWORDS]
TEXT_SQL = f"""{ITEMS_SQL},
t AS (SELECT *, {NORM.format('title')} AS nt, lower({NORM.format('title')}) AS low, lower({NORM.format('title')} || ' ' || {NORM.format('description')}) AS txt FROM items)"""
SCORE_SQL = f"""{TEXT_SQL},
h0 AS (SELECT *, CASE WHEN {imm_sql('txt')} THEN list_filter({hits_sql('txt', CORE)}, lambda x: x <> 'alien') ELSE {hits_sql('txt', CORE)} END AS core, {hits_sql('txt', C.AMBIGUOUS_KEYWORDS)} AS amb, len({hits_sql('txt', C.CRISIS_KEYWORDS)}) AS crisis, len({hits_sql('txt', C.CRISIS_HARD_KEYWORDS)}) AS hard, len({hits_sql('txt', C.OFFICIAL_ACTIONS)}) AS act, len({hits_sql('txt', C.POLITICAL_KEYWORDS)}) AS pol, {official_sql('source')} AS official, contains(lower(source), 'google news') AS aggregator FROM t),
h1 AS (SELECT *, CASE WHEN len(core) > 0 THEN len(core) + len(amb) ELSE 0 END AS sig, crisis + hard + act AS strength FROM h0),
h2 AS (SELECT * EXCLUDE (category), CASE WHEN sig > strength THEN 'ufo' WHEN strength > sig THEN 'crisis' ELSE category END AS category, date > DATE '{TODAY}' + 1 AS late, date < DATE '{TODAY}' - 120 AS early FROM h1),
h3 AS (SELECT *, greatest(0, CASE WHEN weight >= 3 THEN 40 WHEN weight = 2 THEN 30 ELSE 15 END + CASE source_type WHEN 'rss' THEN 15 WHEN 'reddit' THEN 4 ELSE 0 END - CASE WHEN aggregator THEN 12 ELSE 0 END + CASE WHEN url LIKE 'https://%' THEN 5 WHEN url LIKE 'http://%' THEN -4 ELSE -8 END + CASE WHEN domain <> '' THEN 3 ELSE -6 END
  + CASE WHEN length(nt) BETWEEN 25 AND 180 THEN 6 ELSE -6 END - CASE WHEN regexp_matches(nt, '!{{3,}}|\\?{{3,}}') OR regexp_full_match(nt, '[^a-z]{{16,}}') THEN 10 ELSE 0 END + CASE WHEN date_parsed_ok THEN 8 ELSE -12 END + CASE WHEN published_at IS NOT NULL THEN CASE WHEN official THEN 6 ELSE 2 END WHEN official THEN -5 ELSE 0 END
  + CASE WHEN date IS NOT NULL AND NOT late AND NOT early THEN 6 ELSE 0 END + least(sig + crisis, 8) + least(act, 4) + CASE WHEN category = 'crisis' THEN least(pol, 4) ELSE 0 END) AS base_score,
  category = 'crisis' AS cr, category = 'ufo' AND NOT official AS uf FROM h2),
scored AS MATERIALIZED (SELECT *, list_sort(list_filter([CASE WHEN nt = '' THEN 'empty_title' END, CASE WHEN sig = 0 AND strength = 0 THEN 'no_relevance_keywords' END,
  CASE WHEN {' OR '.join(f"contains(low, '{h}')" for h in C.OPINION_HINTS)} OR contains(nt, ' | ') THEN 'opinion_or_commentary' END, CASE WHEN {' OR '.join(f"contains(low, '{h}')" for h in C.ROUNDUP_HINTS)} THEN 'roundup_or_mixed_headline' END,
  CASE WHEN NOT date_parsed_ok THEN 'date_parse_failed' END, CASE WHEN date IS NULL THEN 'invalid_date' END, CASE WHEN late THEN 'future_dated_item' END, CASE WHEN early THEN 'stale_item_outside_lookback' END,
  CASE WHEN cr AND pol = 0 THEN 'crisis_without_political_context' END, CASE WHEN cr AND NOT {any_sql('txt', C.NATIONAL_KEYWORDS)} THEN 'crisis_without_national_context' END,
  CASE WHEN cr AND NOT ({any_sql('low', C.CRISIS_KEYWORDS)} OR {any_sql('low', C.CRISIS_HARD_KEYWORDS)} OR {any_sql('low', C.OFFICIAL_ACTIONS)}) THEN 'crisis_signal_only_in_description' END,
  CASE WHEN uf AND NOT {any_sql('txt', C.STRONG_KEYWORDS)} THEN 'ufo_without_strong_signal' END, CASE WHEN uf AND NOT {any_sql('txt', C.GOVERNANCE_KEYWORDS)} THEN 'ufo_without_government_context' END, CASE WHEN uf AND NOT {any_sql('txt', C.GOVERNANCE_HARD_KEYWORDS)} THEN 'ufo_without_hard_government_context' END], lambda x: x IS NOT NULL)) AS reasons FROM h3)"""
CORR_SQL = f"""{SCORE_SQL},
f0 AS (SELECT *, substr(sha1(category || '-' || array_to_string({tokens_sql('title')}, ' ')), 1, 16) AS fingerprint, NOT aggregator AND source_type = 'rss' AND weight >= 2 AS trusted FROM scored WHERE len(reasons) = 0),
f1 AS (SELECT category, fingerprint, count(DISTINCT source) AS corroboration, count(DISTINCT source) FILTER (trusted) AS trusted_corroboration FROM f0 GROUP BY ALL),
corr AS MATERIALIZED (SELECT f0.*, corroboration, trusted_corroboration, least(100, base_score + CASE WHEN trusted_corroboration >= 3 THEN 22 WHEN trusted_corroboration = 2 THEN 13 WHEN trusted_corroboration = 1 THEN 5 ELSE 0 END + CASE WHEN corroboration >= 5 THEN 5 WHEN corroboration >= 3 THEN 2 ELSE 0 END) AS final_score FROM f0 JOIN f1 USING (category, fingerprint))"""


def scored(spark, sf):  # noqa: ANN001, ANN201
    return I.evaluate(V.items(spark, sf), STRICT_BALANCED, today())


def scored_table(spark, sf):  # noqa: ANN001, ANN201
    """Scored items as a table, for claims and pairs alike; descriptions are kept where pairs need them."""
    return shared_table(scored(spark, sf).withColumn("description", F.when(M.pairable(), F.col("description"))), "scored-items")


def corroborated(spark, sf, texts=False, items=None):  # noqa: ANN001, ANN201
    """Accepted items, scored once for all that reads them (or given as ``items``); their descriptions are kept only if asked for."""
    accepted = (scored(spark, sf) if items is None else items).where(F.size("reasons") == 0)
    return I.corroborate(shared_table(accepted if texts else accepted.drop("description"), "accepted-items"))


def with_found(items, keywords):  # noqa: ANN001, ANN201
    """``items`` with ``_found``: those of the keywords that title and description hold, looked for once a row."""
    text = F.lower(F.concat_ws(" ", T.normalize(F.col("title")), T.normalize(F.col("description"))))
    df = once(items.withColumn("_text", text).drop("description"))
    return once(df.withColumn("_found", T.found_keywords(F.col("_text"), keywords)).drop("_text"))


@query(f"WITH {TEXT_SQL} SELECT ord, array_to_string({hits_sql('txt', C.UFO_KEYWORDS)}, ',') AS ufo, array_to_string({hits_sql('txt', C.CRISIS_KEYWORDS)}, ',') AS crisis, {imm_sql('txt')} AS immigration FROM t")
def keyword_hits(spark, sf):  # noqa: ANN001, ANN201
    df = with_found(V.items(spark, sf).select("ord", "title", "description"), [*C.UFO_KEYWORDS, *C.CRISIS_KEYWORDS, "alien", "aliens", *C.ALIEN_ANCHORS, *C.IMMIGRATION_CONTEXT])
    found = F.col("_found")
    return df.select("ord", F.array_join(T.hits_of(found, C.UFO_KEYWORDS), ",").alias("ufo"), F.array_join(T.hits_of(found, C.CRISIS_KEYWORDS), ",").alias("crisis"), T.immigration_context(found, T.any_of).alias("immigration"))


@query(f"WITH {ITEMS_SQL} SELECT ord, array_to_string({tokens_sql('title')}, ' ') AS tokens, substr(sha1(category || '-' || array_to_string({tokens_sql('title')}, ' ')), 1, 16) AS fingerprint FROM items")
def claim_fingerprint(spark, sf):  # noqa: ANN001, ANN201
    return V.items(spark, sf).select("ord", F.array_join(T.claim_tokens(F.col("title")), " ").alias("tokens"), T.claim_fingerprint(F.col("category"), F.col("title")).alias("fingerprint"))


@query(f"WITH {TEXT_SQL} SELECT ord, {action_sql('txt')} AS action, {topic_sql('txt')} AS topic, {first_sql('txt', C.ACTOR_KEYWORDS)} AS actor, coalesce(CAST(date AS VARCHAR), 'na') || '|act:' || {longest_sql('txt', C.OFFICIAL_ACTIONS + C.CRISIS_HARD_KEYWORDS)} || '|topic:' || {longest_sql('txt', C.CRISIS_TOPICS)} || '|actor:' || {longest_sql('low', C.CRISIS_ACTORS)} AS crisis_sig, CASE WHEN {action_sql('txt')} <> 'na' OR {first_sql('txt', C.ACTOR_KEYWORDS)} <> 'na' THEN coalesce(CAST(CAST(date_trunc('week', date) AS DATE) AS VARCHAR), 'na') || '|act:' || {action_sql('txt')} || '|topic:' || {topic_sql('txt')} || '|actor:' || {first_sql('txt', C.ACTOR_KEYWORDS)} END AS ufo_sig FROM t")
def tags_and_signatures(spark, sf):  # noqa: ANN001, ANN201
    df = with_found(V.items(spark, sf).select("ord", "title", "description", "date"), [*T.TAG_KEYWORDS, *T.CRISIS_SIGNS])
    low, found = F.lower(T.normalize(F.col("title"))), F.col("_found")
    return df.select("ord", T.action_tag(found, T.any_of).alias("action"), T.topic_tag(found, T.any_of).alias("topic"), T.first_found(found, C.ACTOR_KEYWORDS).alias("actor"), T.crisis_signature(F.col("date"), low, found).alias("crisis_sig"), T.ufo_signature(F.col("date"), found).alias("ufo_sig"))


@query(f"WITH {SCORE_SQL} SELECT ord, category, official, aggregator, base_score, array_to_string(reasons, ',') AS reasons FROM scored")
def base_scores(spark, sf):  # noqa: ANN001, ANN201
    return scored(spark, sf).select("ord", "category", "official", "aggregator", "base_score", F.array_join("reasons", ",").alias("reasons"))


@query(f"WITH {SCORE_SQL} SELECT reason, count(*) AS n FROM (SELECT unnest(reasons) AS reason FROM scored) GROUP BY reason ORDER BY n DESC, reason LIMIT 10")
def reject_histogram(spark, sf):  # noqa: ANN001, ANN201
    return I.reason_counts(scored(spark, sf).where(F.size("reasons") > 0))


@query(f"WITH {ITEMS_SQL}, u AS (SELECT *, min(ord) OVER (PARTITION BY source, url) AS fu FROM items), v AS (SELECT *, min(ord) OVER (PARTITION BY source, lower(title), coalesce(CAST(date AS VARCHAR), 'url:' || url)) AS ft FROM u WHERE ord = fu) SELECT ord, CASE WHEN ord <> ft THEN 'title' END AS duplicate FROM v UNION ALL SELECT ord, 'url' FROM u WHERE ord <> fu")
def dedupe_two_stage(spark, sf):  # noqa: ANN001, ANN201
    return I.dedupe(V.items(spark, sf)).select("ord", "duplicate")


@query(f"WITH {CORR_SQL} SELECT ord, fingerprint, corroboration, trusted_corroboration, final_score FROM corr")
def corroboration(spark, sf):  # noqa: ANN001, ANN201
    return corroborated(spark, sf).select("ord", "fingerprint", "corroboration", "trusted_corroboration", "final_score")


@query(f"WITH {CORR_SQL} SELECT ord, final_score, CASE WHEN final_score >= 80 THEN 'HIGH' WHEN final_score >= 60 THEN 'MEDIUM' ELSE 'LOW' END AS label, NOT (final_score < 55 OR (weight = 1 AND trusted_corroboration < 2) OR (source_type = 'reddit' AND trusted_corroboration < 2) OR (aggregator AND trusted_corroboration < 2) OR (weight = 2 AND trusted_corroboration = 0 AND final_score < 78)) AS accepted FROM corr")
def policy_filter(spark, sf):  # noqa: ANN001, ANN201
    df = I.policy_filter(corroborated(spark, sf), STRICT_BALANCED)
    return df.select("ord", "final_score", T.confidence(F.col("final_score")).alias("label"), (F.size("policy_reasons") == 0).alias("accepted"))


CLAIM_SQL = f"""{CORR_SQL}, best AS (SELECT * FROM corr QUALIFY row_number() OVER (PARTITION BY category, fingerprint ORDER BY final_score DESC, weight DESC, published_at IS NOT NULL DESC, source_type = 'rss' DESC, length(title) DESC, ord) = 1),
agg AS (SELECT category, fingerprint, count(*) AS cluster_size, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources, array_to_string(list_sort(list(DISTINCT url))[1:12], ' ') AS urls, count(DISTINCT source) > 1 AS multi_source, min(date) FILTER (official) AS official_day, min(date) FILTER (NOT official AND source_type = 'rss') AS rss_day, min(date) FILTER (NOT official) AS other_day, count(*) FILTER (NOT official AND source_type = 'rss') AS n_rss FROM corr GROUP BY ALL)"""


@query(f"WITH {CLAIM_SQL} SELECT category, fingerprint, best.ord, best.final_score, cluster_size, sources, urls, multi_source FROM agg JOIN best USING (category, fingerprint)")
def claim_collapse(spark, sf):  # noqa: ANN001, ANN201
    e = EV.collapse_claims(corroborated(spark, sf))
    return e.select("category", "fingerprint", "ord", "final_score", "cluster_size", F.array_join("sources", ",").alias("sources"), F.array_join("evidence_urls", " ").alias("urls"), "multi_source")


LAG_SQL = f"""{CLAIM_SQL},
tl AS (SELECT * FROM (SELECT DISTINCT category, fingerprint, source, date, published_at, url, weight, source_type FROM corr) QUALIFY row_number() OVER (PARTITION BY category, fingerprint ORDER BY published_at IS NULL, published_at, date IS NULL, date, -weight, source, url, source_type) <= 24),
tw AS (SELECT *, {official_sql('source')} AS off, coalesce(bool_or(NOT {official_sql('source')} AND source_type = 'rss') OVER (PARTITION BY category, fingerprint), false) AS has_rss FROM tl),
lg AS (SELECT category, fingerprint, min(date) FILTER (off) AS official_day, min(date) FILTER (NOT off AND (NOT has_rss OR source_type = 'rss')) AS media_day, min(published_at) FILTER (off) AS oa, min(published_at) FILTER (NOT off AND (NOT has_rss OR source_type = 'rss')) AS ma, count(*) FILTER (off) AS n_off, count(*) FILTER (NOT off AND (NOT has_rss OR source_type = 'rss')) AS n_med, count(*) AS n_reports FROM tw GROUP BY ALL),
lags AS (SELECT lg.*, CAST(media_day - official_day AS INT) AS lag_days, CASE WHEN oa IS NOT NULL AND ma IS NOT NULL THEN round((epoch(ma) - epoch(oa)) / 3600, 3) END AS lag_hours, CASE WHEN oa IS NOT NULL AND ma IS NOT NULL THEN 'timestamp' WHEN media_day - official_day IS NOT NULL THEN 'date' ELSE 'none' END AS lag_basis FROM lg),
why AS (SELECT *, CASE WHEN n_off = 0 AND n_med = 0 THEN 'no_reports' WHEN n_off = 0 THEN 'no_official_report' WHEN n_med = 0 THEN 'no_media_report' WHEN lag_days IS NULL THEN 'missing_dates' WHEN lag_hours > 0 THEN 'strict_official_lead' WHEN lag_hours = 0 THEN 'same_time' WHEN lag_hours < 0 THEN 'media_lead' WHEN lag_days > 0 THEN 'official_lead_by_date' WHEN lag_days = 0 THEN 'same_day' ELSE 'media_lead' END AS reason FROM lags)"""


@query(f"WITH {LAG_SQL} SELECT category, fingerprint, official_day, media_day, lag_days, lag_hours, lag_basis, reason, n_reports FROM why")
def event_lags(spark, sf):  # noqa: ANN001, ANN201
    e = EV.lag_metrics(EV.collapse_claims(corroborated(spark, sf)))
    return e.select("category", "fingerprint", "official_day", "media_day", "lag_days", "lag_hours", "lag_basis", EV.lead_reason().alias("reason"), F.size("timeline").alias("n_reports"))


CRISIS_SIG = f"coalesce(CAST(date AS VARCHAR), 'na') || '|act:' || {longest_sql('txt', C.OFFICIAL_ACTIONS + C.CRISIS_HARD_KEYWORDS)} || '|topic:' || {longest_sql('txt', C.CRISIS_TOPICS)} || '|actor:' || {longest_sql('low', C.CRISIS_ACTORS)}"
UFO_SIG = f"CASE WHEN {action_sql('txt')} <> 'na' OR {first_sql('txt', C.ACTOR_KEYWORDS)} <> 'na' THEN coalesce(CAST(CAST(date_trunc('week', date) AS DATE) AS VARCHAR), 'na') || '|act:' || {action_sql('txt')} || '|topic:' || {topic_sql('txt')} || '|actor:' || {first_sql('txt', C.ACTOR_KEYWORDS)} END"
MERGE_SQL = f"""{LAG_SQL},
sg AS (SELECT best.category, fingerprint, ord, final_score, cluster_size, CASE WHEN best.category = 'crisis' THEN {CRISIS_SIG} ELSE coalesce({UFO_SIG}, 'solo:' || fingerprint) END AS sig FROM best JOIN agg USING (category, fingerprint)),
s1 AS (SELECT category, sig, source, min(ord * 100000 + p) AS place FROM sg JOIN (SELECT *, row_number() OVER (PARTITION BY category, fingerprint ORDER BY source) AS p FROM (SELECT DISTINCT category, fingerprint, source FROM corr)) USING (category, fingerprint) GROUP BY ALL),
s2 AS (SELECT category, sig, string_agg(source, ',' ORDER BY place) AS sources FROM s1 GROUP BY ALL),
u1 AS (SELECT category, sig, count(DISTINCT url) AS nu FROM sg JOIN (SELECT * FROM (SELECT DISTINCT category, fingerprint, url FROM corr) QUALIFY row_number() OVER (PARTITION BY category, fingerprint ORDER BY url) <= 12) USING (category, fingerprint) GROUP BY ALL),
r1 AS (SELECT category, sig, count(*) AS nr FROM (SELECT DISTINCT category, sig, tl.source, tl.date, tl.published_at, tl.url, tl.weight, tl.source_type FROM sg JOIN tl USING (category, fingerprint)) GROUP BY ALL),
b1 AS (SELECT category, sig, arg_max(ord, (final_score, cluster_size, -ord)) AS ord, count(*) AS merged_claims, CAST(sum(cluster_size) AS BIGINT) AS cluster_size FROM sg GROUP BY ALL)"""


@query(f"WITH {MERGE_SQL} SELECT sig, ord, sources, CAST(least(nu, CASE category WHEN 'crisis' THEN 16 ELSE 20 END) AS INT) AS n_urls, CAST(least(nr, CASE category WHEN 'crisis' THEN 24 ELSE 32 END) AS INT) AS n_reports, merged_claims, cluster_size FROM b1 JOIN s2 USING (category, sig) JOIN u1 USING (category, sig) JOIN r1 USING (category, sig)")
def event_merges(spark, sf):  # noqa: ANN001, ANN201
    e = EV.collapse_claims(corroborated(spark, sf, texts=True))
    e = with_found(e, [*T.TAG_KEYWORDS, *T.CRISIS_SIGNS])
    low, found = F.lower(T.normalize(F.col("title"))), F.col("_found")
    crisis = EV.merge_by_signature(e.where("category = 'crisis'"), T.crisis_signature(F.col("date"), low, found), 16, 24)
    ufo = EV.merge_by_signature(e.where("category = 'ufo'"), T.ufo_signature(F.col("date"), found), 20, 32)
    return crisis.unionByName(ufo).select("sig", "ord", F.array_join("sources", ",").alias("sources"), F.size("evidence_urls").alias("n_urls"), F.size("timeline").alias("n_reports"), "merged_claims", "cluster_size")


SNAP = ", ".join(f"count(*) FILTER (regexp_matches(lower(title), '{'|'.join(w)}')) AS control_{t}" for t, w in C.CONTROL_TOPICS.items())


@query(f"WITH {SCORE_SQL}, s AS (SELECT date, count(*) FILTER (category = 'ufo') AS ufo_count, count(*) FILTER (category = 'crisis') AS crisis_count, {SNAP}, round(coalesce(avg(base_score) FILTER (category = 'ufo'), 0.0), 3) AS ufo_score_mean FROM scored WHERE date IS NOT NULL GROUP BY date) SELECT date, ufo_count, crisis_count, control_economy, control_security, control_immigration, ufo_score_mean, control_economy + control_security + control_immigration AS control_total, round((control_economy + control_security + control_immigration) / greatest(1, ufo_count + crisis_count), 6) AS control_density FROM s")
def daily_snapshot(spark, sf):  # noqa: ANN001, ANN201
    return I.snapshot(scored(spark, sf).where("date IS NOT NULL"), F.col("date"), ["date"]).drop("window_ufo_count", "window_crisis_count")


TOPICS_SQL = " UNION ALL ".join(f"SELECT date AS d, '{t}' AS topic, count(*) AS n FROM t WHERE {any_sql('txt', w)} GROUP BY date" for t, w in C.PANEL_TOPICS.items())


@query(f"WITH {TEXT_SQL} {TOPICS_SQL}")
def topic_controls(spark, sf):  # noqa: ANN001, ANN201
    return I.topic_days(V.items(spark, sf), C.PANEL_TOPICS)


@query(f"WITH {ITEMS_SQL} SELECT source, count(*) AS n, min(date) AS first, max(date) AS last, CAST(max(date) - min(date) + 1 AS BIGINT) AS span_days, count(*) FILTER (DATE '{TODAY}' - date <= 3) AS fresh, count(*) FILTER (date < DATE '{TODAY}' - 120) AS stale FROM items GROUP BY source")
def source_coverage(spark, sf):  # noqa: ANN001, ANN201
    return I.source_coverage(V.items(spark, sf), today())


STATUS_SQL = f"{ITEMS_SQL}, st AS (SELECT source, category, max(weight) AS weight, CASE WHEN count(*) % 3 = 0 THEN 'failed' ELSE 'ok' END AS status, CASE count(*) % 6 WHEN 0 THEN 'connection timed out' WHEN 3 THEN 'http 503' END AS error FROM items GROUP BY ALL)"


@query(f"WITH {STATUS_SQL} SELECT category, count(*) AS sources, count(*) FILTER (status <> 'failed') AS available, round(avg(CAST(status <> 'failed' AS INT)), 6) AS availability, count(*) FILTER (status <> 'failed' AND weight >= 2 AND NOT contains(lower(source), 'google news')) AS trusted_available, count(*) FILTER (error = 'connection timed out') AS timeouts, count(*) FILTER (error = 'http 503') AS http_errors FROM st GROUP BY category")
def source_health(spark, sf):  # noqa: ANN001, ANN201
    g = V.items(spark, sf).groupBy("source", "category").agg(F.max("weight").alias("weight"), F.count("*").alias("n"))
    st = g.select("source", "category", "weight", F.when(F.col("n") % 3 == 0, "failed").otherwise("ok").alias("status"), F.when(F.col("n") % 6 == 0, "connection timed out").when(F.col("n") % 6 == 3, "http 503").alias("error"))
    return I.source_health(st)


EVT_SQL = "ev AS (SELECT event_id, CAST(ts AS DATE) AS d, event_type, value FROM events), cr AS (SELECT event_id AS cid, d AS cd FROM ev WHERE event_type = 'error'), ou AS (SELECT event_id AS uid, d AS ud FROM ev WHERE event_type = 'purchase')"


def _sides(spark, sf):  # noqa: ANN001, ANN202
    e = V.table(spark, sf, "events").select("event_id", F.col("ts").cast("date").alias("d"), "event_type")
    return e.where("event_type = 'error'").select(F.col("event_id").alias("cid"), F.col("d").alias("cd")), e.where("event_type = 'purchase'").select(F.col("event_id").alias("uid"), F.col("d").alias("ud"))


@query(f"WITH {EVT_SQL} SELECT cd, CAST(ud - cd AS INT) AS gap, count(*) AS n, sum(cid % 97 * (uid % 89)) AS checksum FROM cr JOIN ou ON ud - cd BETWEEN -60 AND 60 GROUP BY ALL")
def temporal_pairs(spark, sf):  # noqa: ANN001, ANN201
    """Events are summed by day before the join: the pairs of two days are the product of their sums."""
    c, u = _sides(spark, sf)
    c = c.groupBy("cd").agg(F.count("*").alias("nc"), F.sum(F.col("cid") % 97).alias("sc"))
    u = u.groupBy("ud").agg(F.count("*").alias("nu"), F.sum(F.col("uid") % 89).alias("su"))
    p = M.band_join(c, u, "cd", "ud", PAIR_DAYS, PAIR_DAYS)
    return p.select("cd", F.datediff("ud", "cd").alias("gap"), (F.col("nc") * F.col("nu")).alias("n"), (F.col("sc") * F.col("su")).alias("checksum"))


PAIR_SQL = f"""{SCORE_SQL}, pr AS (SELECT *, {action_sql('txt')} AS action, {topic_sql('txt')} AS topic, {first_sql('txt', C.ACTOR_KEYWORDS)} AS a0, {tokens_sql('title')} AS tk, CASE WHEN len({tokens_sql('title')}) < 3 THEN {tokens_sql('txt')} ELSE [] END AS tk2 FROM scored WHERE category = 'ufo' AND base_score >= 50 AND date IS NOT NULL),
pf AS MATERIALIZED (SELECT * EXCLUDE (a0, tk), {chain_sql([(f"a0 = '{k}'", f"'{v}'") for k, v in C.ACTOR_GROUPS.items()], 'a0')} AS actor, CASE WHEN len(tk) < 3 THEN list_distinct(tk || tk2) ELSE tk END AS tk FROM pr),
dm AS (SELECT DISTINCT domain FROM pf WHERE NOT official AND NOT aggregator AND domain <> '' AND source_type = 'rss' AND weight >= 2),
pp AS (SELECT m.ord AS m_ord, o.ord AS o_ord, CAST(m.date - o.date AS INT) AS lag_days, m.source_type AS st, m.weight AS w, m.aggregator AS ag, m.publisher AS pub, m.published_at AS pa, m.publisher IN (SELECT domain FROM dm) AS mir,
  CASE WHEN o.action <> 'na' AND o.action = m.action THEN 2 ELSE 0 END + CASE WHEN o.topic <> 'na' AND o.topic = m.topic THEN 2 ELSE 0 END + CASE WHEN o.actor <> 'na' AND o.actor = m.actor THEN 1 ELSE 0 END + CASE WHEN len(list_intersect(o.tk, m.tk)) >= 3 THEN 2 WHEN len(list_intersect(o.tk, m.tk)) >= 2 THEN 1 ELSE 0 END AS semantic
  FROM pf o JOIN pf m ON o.official AND NOT m.official AND m.date - o.date BETWEEN 0 AND 30),
tr AS (SELECT *, CASE WHEN st = 'rss' AND NOT ag AND w >= 2 AND semantic >= 3 THEN 'strict' WHEN st = 'rss' AND ag AND pub <> '' AND pa IS NOT NULL AND semantic >= 3 THEN CASE WHEN coalesce(mir, false) THEN 'strict' ELSE 'proxy_strict' END WHEN st = 'rss' AND (NOT ag OR pub <> '') AND semantic >= 2 THEN 'balanced' ELSE 'exploratory' END AS tier FROM pp WHERE semantic >= 2)"""


@query(f"WITH {PAIR_SQL} SELECT m_ord, o_ord, lag_days, semantic, tier FROM tr QUALIFY row_number() OVER (PARTITION BY m_ord ORDER BY CASE tier WHEN 'strict' THEN 0 WHEN 'proxy_strict' THEN 1 WHEN 'balanced' THEN 2 ELSE 3 END, semantic DESC, CASE WHEN lag_days = 0 THEN 9999 ELSE lag_days END, o_ord) = 1")
def official_media_pairs(spark, sf):  # noqa: ANN001, ANN201
    return M.official_media_pairs(scored(spark, sf)).select("m_ord", "o_ord", "lag_days", "semantic", "tier")


def _url_sql() -> str:
    key = "lower(split_part(kv, '=', 1))"
    drop = f"{key} LIKE 'utm\\_%' ESCAPE '\\' OR {key} IN ({', '.join(repr(k) for k in C.TRACKING_KEYS)}) OR kv = ''"
    day = lambda pattern: "CAST(try_strptime(" + " || '-' || ".join(f"regexp_extract(coalesce(url, ''), '{pattern}', {i})" for i in (1, 2, 3)) + ", '%Y-%m-%d') AS DATE)"
    return f"""pu AS (SELECT page_id, url, trim(coalesce(url, '')) AS u FROM pages),
pp AS (SELECT *, regexp_matches(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+') AS known, lower(regexp_extract(u, '^([^:/?#]+)://', 1)) AS scheme, regexp_replace(lower(regexp_extract(u, '^[^:/?#]+://([^/?#]*)', 1)), '^www\\.', '') AS host, regexp_replace(regexp_extract(u, '^[^:/?#]+://[^/?#]*([^?#]*)', 1), '/+$', '') AS path, list_filter(string_split(regexp_extract(u, '^[^?#]*\\?([^#]*)', 1), '&'), lambda kv: NOT ({drop})) AS kvs FROM pu),
uf AS (SELECT page_id, CASE WHEN known THEN scheme || '://' || host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN len(kvs) > 0 THEN '?' || array_to_string(list_transform(kvs, lambda kv: CASE WHEN contains(kv, '=') THEN kv ELSE kv || '=' END), '&') ELSE '' END ELSE u END AS canonical, CASE WHEN known THEN regexp_replace(host, ':[0-9]+$', '') ELSE '' END AS domain, coalesce({day('/([0-9]{4})/([0-9]{1,2})/([0-9]{1,2})(?:/|$)')}, {day('/([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})(?:[-_/]|$)')}, {day('[?&]date=([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})')}) AS day FROM pp)"""


@query(f"WITH {_url_sql()} SELECT * FROM uf")
def url_functions(spark, sf):  # noqa: ANN001, ANN201
    u = F.col("url")
    return V.table(spark, sf, "pages").select("page_id", T.canonical_url(u).alias("canonical"), T.domain_of(u).alias("domain"), T.date_from_url(u).alias("day"))


@query("SELECT doc_id, CAST(try_strptime((2000 + doc_id % 25) || '/' || (doc_id % 14) || '/' || (doc_id % 33), '%Y/%m/%d') AS DATE) AS day FROM documents")
def url_dates(spark, sf):  # noqa: ANN001, ANN201
    i = F.col("doc_id")
    df = V.table(spark, sf, "documents")
    return df.select("doc_id", T.date_from_url(F.concat(F.lit("/a/"), (2000 + i % 25).cast("string"), F.lit("/"), (i % 14).cast("string"), F.lit("/"), (i % 33).cast("string"), F.lit("/x"))).alias("day"))


@query("SELECT event_type, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k, count(*) AS n FROM events GROUP BY ALL")
def json_access(spark, sf):  # noqa: ANN001, ANN201
    return V.table(spark, sf, "events").groupBy("event_type", F.get_json_object("props", "$.k").alias("k")).agg(F.count("*").alias("n"))


@query("SELECT CAST(date_trunc('week', ts) AS DATE) AS week, CAST(isodow(ts) - 1 AS INT) AS weekday, count(*) AS n FROM events GROUP BY ALL")
def week_buckets(spark, sf):  # noqa: ANN001, ANN201
    d = F.col("ts").cast("date")
    return V.table(spark, sf, "events").groupBy(T.week_of(d).alias("week"), F.weekday(d).alias("weekday")).agg(F.count("*").alias("n"))


@query("SELECT page_id, page_id || ' title' AS title, DATE '2002-10-02' AS date, url, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)), '^www\\.', '') AS domain, 'text' AS description FROM pages")
def feed_scan(spark, sf):  # noqa: ANN001, ANN201
    p = V.table(spark, sf, "pages").select("page_id", F.concat(F.lit("<rss><channel><item><title>"), F.col("page_id").cast("string"), F.lit(" title</title><link>"), F.regexp_replace("url", "&", "&amp;"), F.lit("</link><pubDate>Wed, 02 Oct 2002 13:00:00 GMT</pubDate><description>text</description></item></channel></rss>")).alias("payload"))
    return R.feed_items(p).select("page_id", "title", "date", "url", "domain", "description")
