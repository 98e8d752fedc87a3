"""Items: deduplication within sources, scores, corroboration and the policy filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import config as C
from ..config import Policy
from ..functions import text as T
from ..functions.once import once


def first_per_key(df: DataFrame, key: Column, order: str = "ord") -> DataFrame:
    """Adds ``first``: whether a row is its key's first; rows with a null key are. Keys get their first by aggregation, so that a hot key isn't sorted."""
    keyed = df.withColumn("_key", key)
    least = keyed.where("_key IS NOT NULL").groupBy("_key").agg(F.min(order).alias("_least"))
    return keyed.join(least, "_key", "left").withColumn("first", F.coalesce(F.col(order) == F.col("_least"), F.lit(True))).drop("_key", "_least")


def dedupe(items: DataFrame, order: str = "ord") -> DataFrame:
    """``items`` with ``duplicate``: null, ``url`` for a later row of a source's URL, ``title`` for a later row of a source's title and date (or URL, without a date).

    A row that falls in the second step has claimed its URL in the first; one that falls in the first claims no title.
    """
    blank = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit(""))
    by_url = first_per_key(items, F.when(blank("url") != "", F.concat_ws("\x00", blank("source"), blank("url"))), order)
    day = F.when(blank("date") != "", blank("date")).otherwise(F.concat(F.lit("url:"), blank("url")))
    left = first_per_key(by_url.where("first").drop("first"), F.concat_ws("\x00", blank("source"), F.lower(blank("title")), day), order)
    return left.withColumn("duplicate", F.when(~F.col("first"), "title")).drop("first").unionByName(by_url.where("NOT first").drop("first").withColumn("duplicate", F.lit("url")))


def evaluate(items: DataFrame, policy: Policy, today: Column, lookback: int = 120) -> DataFrame:
    """``items`` with final category, ``base_score``, ``reasons`` to reject (sorted) and ``flags``. One projection, no shuffle."""
    title = T.normalize(F.col("title"))
    df = items.withColumns({"_title": title, "_low_title": F.lower(title)}).withColumn("_text", F.lower(F.concat_ws(" ", "_title", T.strip_html(F.col("description")))))
    df = once(df)
    core = [k for k in C.UFO_KEYWORDS if k not in C.AMBIGUOUS_KEYWORDS]
    lists = {"core": core, "amb": C.AMBIGUOUS_KEYWORDS, "crisis": C.CRISIS_KEYWORDS, "hard": C.CRISIS_HARD_KEYWORDS, "act": C.OFFICIAL_ACTIONS, "pol": C.POLITICAL_KEYWORDS}
    others = [C.NATIONAL_KEYWORDS, C.STRONG_KEYWORDS, C.GOVERNANCE_KEYWORDS, C.GOVERNANCE_HARD_KEYWORDS, C.ALIEN_ANCHORS, C.IMMIGRATION_CONTEXT, ["alien", "aliens"]]
    df = once(df.withColumn("_found", T.found_keywords(F.col("_text"), [k for words in [*lists.values(), *others] for k in words])))
    found, low = F.col("_found"), F.col("_low_title")
    df = df.withColumns({f"_{c}": T.hits_of(found, words) for c, words in lists.items()} | {"_migrants": T.immigration_context(found, T.any_of), "official": T.is_official(F.col("source")), "aggregator": T.is_aggregator(F.col("source"))})
    df = df.withColumn("_core", T.without_migrants(F.col("_core"), F.col("_migrants")))
    n = {c: F.size(f"_{c}") for c in ("core", "amb", "crisis", "hard", "act", "pol")}
    df = df.withColumn("_signal", F.when(n["core"] > 0, n["core"] + n["amb"]).otherwise(0)).withColumn("_strength", n["crisis"] + n["hard"] + n["act"])
    df = once(df)
    sig, strength = F.col("_signal"), F.col("_strength")
    df = df.withColumn("category", F.when(sig > strength, "ufo").when(strength > sig, "crisis").otherwise(F.col("category")))
    df = once(df)
    url, length = F.coalesce("url", F.lit("")), F.length("_title")
    known = F.coalesce("date_parsed_ok", F.lit(False))
    late, early = F.col("date") > F.date_add(today, 1), F.col("date") < F.date_sub(today, lookback)
    crisis, ufo = F.col("category") == "crisis", F.col("category") == "ufo"
    score = (
        F.when(F.col("weight") >= 3, 40).when(F.col("weight") == 2, 30).otherwise(15)
        + F.when(F.col("source_type") == "rss", 15).when(F.col("source_type") == "reddit", 4).otherwise(0)
        - F.when(F.col("aggregator"), 12).otherwise(0)
        + F.when(url.startswith("https://"), 5).when(url.startswith("http://"), -4).otherwise(-8)
        + F.when(F.coalesce("domain", F.lit("")) != "", 3).otherwise(-6)
        + F.when(length.between(25, 180), 6).otherwise(-6)
        - F.when(T.spammy(F.col("_title")), 10).otherwise(0)
        + F.when(known, 8).otherwise(-12)
        + F.when(F.col("published_at").isNotNull(), F.when(F.col("official"), 6).otherwise(2)).when(F.col("official"), -5).otherwise(0)
        + F.when(F.col("date").isNotNull() & ~late & ~early, 6).otherwise(0)
        + F.least(sig + n["crisis"], F.lit(8))
        + F.least(n["act"], F.lit(4))
        + F.when(crisis, F.least(n["pol"], F.lit(4))).otherwise(0)
    )
    hit = lambda on, words: T.any_keyword(on, words)
    title_signal = hit(low, C.CRISIS_KEYWORDS) | hit(low, C.CRISIS_HARD_KEYWORDS) | hit(low, C.OFFICIAL_ACTIONS)
    outside = ~F.col("official")
    rules = {
        "empty_title": F.col("_title") == "",
        "no_relevance_keywords": (sig == 0) & (strength == 0),
        "opinion_or_commentary": F.lit(policy.opinion) & (T.contains_any(low, C.OPINION_HINTS) | F.col("_title").contains(" | ")),
        "roundup_or_mixed_headline": F.lit(policy.roundup) & T.contains_any(low, C.ROUNDUP_HINTS),
        "date_parse_failed": ~known,
        "invalid_date": F.col("date").isNull(),
        "future_dated_item": late,
        "stale_item_outside_lookback": early,
        "crisis_without_political_context": crisis & (n["pol"] == 0),
        "crisis_without_national_context": F.lit(policy.crisis_national_context) & crisis & ~T.any_of(found, C.NATIONAL_KEYWORDS),
        "crisis_without_hard_signal": F.lit(policy.crisis_hard_signal) & crisis & (n["hard"] == 0) & (n["act"] == 0),
        "crisis_title_without_national_actor": F.lit(policy.crisis_title_actor) & crisis & ~hit(low, C.TITLE_NATIONAL_KEYWORDS),
        "crisis_signal_only_in_description": crisis & ~title_signal,
        "crisis_hard_signal_only_in_description": F.lit(policy.crisis_title_hard_signal) & crisis & ~hit(low, C.CRISIS_HARD_KEYWORDS) & ~hit(low, C.OFFICIAL_ACTIONS),
        "ufo_signal_only_in_description": F.lit(policy.ufo_title_signal) & ufo & ~hit(low, C.STRONG_KEYWORDS),
        "ufo_without_strong_signal": F.lit(policy.ufo_strong_signal) & ufo & outside & ~T.any_of(found, C.STRONG_KEYWORDS),
        "ufo_without_government_context": F.lit(policy.ufo_government_context) & ufo & outside & ~T.any_of(found, C.GOVERNANCE_KEYWORDS),
        "ufo_without_hard_government_context": F.lit(policy.ufo_government_context) & ufo & outside & ~T.any_of(found, C.GOVERNANCE_HARD_KEYWORDS),
    }
    reasons = F.array_sort(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()])))
    flags = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in {"alien_term_immigration_context": F.col("_migrants"), "community_source": F.col("source_type") == "reddit", "aggregator_source": F.col("aggregator"), "spammy_title_pattern": T.spammy(F.col("_title")), "official_missing_published_at": F.col("official") & F.col("published_at").isNull()}.items()]))
    out = df.withColumns({"base_score": F.greatest(F.lit(0), score), "reasons": reasons, "flags": flags})
    return once(out.select(*items.columns, "official", "aggregator", "base_score", "reasons", "flags", F.col("_signal").alias("ufo_relevance"), F.size("_crisis").alias("crisis_relevance")))


def corroborate(items: DataFrame) -> DataFrame:
    """Adds fingerprint, the distinct sources and trusted sources that carry the claim, and ``final_score``.

    Sources are counted by aggregation and joined back by claim: a claim that a third of all items make is combined in the map tasks.
    """
    df = once(items.withColumns({"fingerprint": T.claim_fingerprint(F.col("category"), F.col("title")), "trusted": ~T.is_aggregator(F.col("source")) & (F.col("source_type") == "rss") & (F.col("weight") >= 2)}))
    per_source = df.groupBy("category", "fingerprint", "source").agg(F.max("trusted").alias("t"))
    n = per_source.groupBy("category", "fingerprint").agg(F.count("*").alias("corroboration"), F.count_if("t").alias("trusted_corroboration"))
    t, s = F.col("trusted_corroboration"), F.col("corroboration")
    bonus = F.when(t >= 3, 22).when(t == 2, 13).when(t == 1, 5).otherwise(0) + F.when(s >= 5, 5).when(s >= 3, 2).otherwise(0)
    return df.join(n, ["category", "fingerprint"]).withColumn("final_score", F.least(F.lit(100), F.col("base_score") + bonus))


def policy_filter(items: DataFrame, policy: Policy) -> DataFrame:
    """``items`` with ``policy_reasons``; those without any are accepted."""
    t = F.col("trusted_corroboration")
    strict = F.lit(policy.source_rules)
    rules = {
        "score_below_threshold": F.col("final_score") < policy.min_score,
        "low_weight_uncorroborated": strict & (F.col("weight") == 1) & (t < 2),
        "community_uncorroborated": strict & (F.col("source_type") == "reddit") & (t < 2),
        "aggregator_uncorroborated": strict & T.is_aggregator(F.col("source")) & (t < 2),
        "medium_weight_uncorroborated": strict & (F.col("weight") == 2) & (t == 0) & (F.col("final_score") < 78),
    }
    return items.withColumn("policy_reasons", F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()])))


def at_least(items: DataFrame, label: str) -> DataFrame:
    rank = F.coalesce(*[F.when(T.confidence(F.col("final_score")) == k, F.lit(v)) for k, v in C.RANKS.items()])
    return items.where(rank >= C.RANKS.get(label.upper(), 2))


def reason_counts(rejected: DataFrame, most: int = 10) -> DataFrame:
    """The most frequent reasons, by count and name."""
    return rejected.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "reason").limit(most)


def source_coverage(items: DataFrame, today: Column, fresh: int = 3, lookback: int = 120) -> DataFrame:
    """Per source: items, span, how many are fresh, stale and official."""
    return items.groupBy("source").agg(F.count("*").alias("n"), F.min("date").alias("first"), F.max("date").alias("last"), (F.datediff(F.max("date"), F.min("date")) + 1).cast("long").alias("span_days"), F.count_if(F.datediff(today, "date") <= fresh).alias("fresh"), F.count_if(F.col("date") < F.date_sub(today, lookback)).alias("stale"))


def source_health(status: DataFrame) -> DataFrame:
    """Per category: sources, how many answered, trusted ones, errors by class. ``status (source, category, weight, status, error)``."""
    ok = F.col("status") != "failed"
    trusted = (F.col("weight") >= 2) & ~T.is_aggregator(F.col("source"))
    kind = T.error_class(F.col("error"))
    return status.groupBy("category").agg(F.count("*").alias("sources"), F.count_if(ok).alias("available"), F.round(F.avg(ok.cast("double")), 6).alias("availability"), F.count_if(ok & trusted).alias("trusted_available"), F.count_if(kind == "timeout").alias("timeouts"), F.count_if(kind.startswith("http_")).alias("http_errors"))


def snapshot(items: DataFrame, day: Column, keys: list[str] | None = None) -> DataFrame:
    """A panel row: only items of the day count, the ``window_`` counts take all."""
    on = F.col("date") == day
    c = lambda cat: F.col("category") == cat
    low = F.lower(F.coalesce("title", F.lit("")))
    aggs = {"ufo_count": on & c("ufo"), "crisis_count": on & c("crisis"), "window_ufo_count": c("ufo"), "window_crisis_count": c("crisis")} | {f"control_{t}": on & T.contains_any(low, w) for t, w in C.CONTROL_TOPICS.items()}
    out = items.groupBy(*(keys or [])).agg(*[F.count_if(v).alias(k) for k, v in aggs.items()], F.round(F.coalesce(F.avg(F.when(on & c("ufo"), F.col("base_score"))), F.lit(0.0)), 3).alias("ufo_score_mean"))
    total = sum((F.col(f"control_{t}") for t in C.CONTROL_TOPICS), F.lit(0))
    return out.withColumn("control_total", total).withColumn("control_density", F.round(F.col("control_total") / F.greatest(F.lit(1), F.col("ufo_count") + F.col("crisis_count")), 6))


def topic_days(items: DataFrame, topics: dict[str, list[str]]) -> DataFrame:
    """``d, topic, n``: an item counts for every topic that it mentions."""
    text = F.lower(F.concat_ws(" ", "title", "description"))
    found = F.array_compact(F.array(*[F.when(T.any_keyword(text, w), F.lit(t)) for t, w in topics.items()]))
    return items.select(F.col("date").alias("d"), F.explode(found).alias("topic")).groupBy("d", "topic").agg(F.count("*").alias("n"))
