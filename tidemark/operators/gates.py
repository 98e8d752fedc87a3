"""Gates, verdicts, levels, and the replay of failed ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .catalogs import in_region


def gate_array(gates: dict[str, Column]) -> Column:
    return F.array(*[F.struct(F.lit(k).alias("name"), F.coalesce(c, F.lit(False)).alias("passed")) for k, c in gates.items()])


def all_passed(gates: str = "gates") -> Column:
    return F.forall(gates, lambda g: g["passed"])


def gate(gates: str, prefix: str) -> Column:
    """The first gate whose name begins so; false without one."""
    return F.coalesce(F.try_element_at(F.filter(gates, lambda g: g["name"].startswith(prefix)), F.lit(1))["passed"], F.lit(False))


#: How near same-day correlation may come to the best lead, the least of catalog dates, and placebo limits.
TIE, CATALOG_LEAST, PLACEBO_EFFECT, PLACEBO_P = 0.08, 5, 0.05, 0.1
APPROVAL_WINDOWS = (3, 7, 10)


def panel_state(metrics: DataFrame, windows: tuple[int, ...] = APPROVAL_WINDOWS) -> DataFrame:
    """One row of what :func:`approval` and :func:`verdict` ask of ``metrics (w, adj, raw, reverse, control, placebo, p_adj, p_placebo)`` in the short windows."""
    on = metrics.where(F.col("w").isin(*windows))
    known = F.col("p_placebo").isNotNull()
    stands = (F.coalesce("p_adj", F.lit(1.0)) < 0.05) & (F.col("adj") > 0)
    above = (F.col("raw") > F.col("reverse")) & (F.abs("control") < F.greatest(F.lit(1e-9), F.abs("raw")))
    return on.agg(
        F.count_if(stands & (F.col("raw") > 0)).alias("significant_windows"),
        F.count_if(stands & above).alias("standing_windows"),
        F.count_if((F.col("reverse") > F.col("raw")) & (F.col("reverse") > 0)).alias("reverse_violations"),
        F.count_if(known).alias("placebo_estimated"),
        F.count_if(known & (F.col("placebo") > PLACEBO_EFFECT) & (F.col("p_placebo") < PLACEBO_P)).alias("placebo_violations"),
        F.count_if(known & (F.col("raw") > 0) & (F.col("placebo") >= F.col("raw"))).alias("placebo_dominant"),
    )


def _placebo_ok() -> Column:
    return (F.col("placebo_estimated") > 0) & (F.col("placebo_violations") == 0) & (F.col("placebo_dominant") == 0)


def _same_day_dominates() -> Column:
    return F.col("corr0") >= F.col("best_positive_corr") - TIE


def sufficient(min_days: int = 180, min_shocks: int = 12, min_ratio: float = 0.8) -> Column:
    """Enough observed days, shocks (of a catalog fewer) and coverage."""
    least = F.when(F.col("catalog"), CATALOG_LEAST).otherwise(min_shocks)
    return (F.col("observed_days") >= min_days) & (F.col("shock_days") >= least) & (F.col("observed_ratio") >= min_ratio)


def approval(state: DataFrame, min_days: int = 180, min_shocks: int = 12, min_ratio: float = 0.8) -> DataFrame:
    """Eight gates, status and level, from the columns of :func:`panel_state` and ``observed_days, shock_days, observed_ratio, catalog, best_positive_lag, best_positive_corr, corr0``."""
    least = F.when(F.col("catalog"), CATALOG_LEAST).otherwise(min_shocks)
    gates = {
        "panel_sufficient": sufficient(min_days, min_shocks, min_ratio),
        f"observed_days>={min_days}": F.col("observed_days") >= min_days,
        "shock_days": F.col("shock_days") >= least,
        f"observed_ratio>={min_ratio:.2f}": F.col("observed_ratio") >= min_ratio,
        "significant_windows>=2": F.col("significant_windows") >= 2,
        "lead_lag_positive": F.col("best_positive_lag").between(1, 30) & (F.col("best_positive_corr") >= 0.1) & ~_same_day_dominates(),
        "reverse_not_dominant": F.col("reverse_violations") <= 1,
        "placebo_not_dominant": _placebo_ok(),
    }
    df = state.withColumn("gates", gate_array(gates))
    return df.withColumns({"status": F.when(all_passed(), "APPROVED").otherwise("REJECTED"), "level": F.when(all_passed(), "CAUSAL_SIGNAL").when(~F.forall(F.slice("gates", 1, 4), lambda g: g["passed"]), "INSUFFICIENT_EVIDENCE").otherwise("WEAK_SIGNAL")})


def verdict(state: DataFrame) -> DataFrame:
    """``state`` with ``verdict``: how far the windows, the lead and the placebo carry."""
    lead = F.col("best_positive_lag").between(1, 30) & (F.col("best_positive_corr") > 0.1) & ~_same_day_dominates()
    two = F.col("standing_windows") >= 2
    out = F.when(~sufficient(), "temporal_correlation_only").when(two & lead & _placebo_ok(), "causal_signal").when(two & lead, "windows_but_placebo_fails").when(two, "windows_without_clear_lead").when(F.col("standing_windows") >= 1, "weak_signal").otherwise("correlation_or_weak")
    return state.withColumn("verdict", out)


def mechanism(events: DataFrame, history: DataFrame, pairs: DataFrame, min_events: int = 3, min_share: float = 0.3, min_lead: int = 1) -> DataFrame:
    """One row: who takes part in and leads events, with its gates.

    ``events (primary_source, sources, lag_days)``, ``history (total, official)`` and ``pairs`` as summed up by
    :func:`pair_summary`. Lead events are those of lags where any is known, else of strict pairs, else of official primary sources that media follow.
    """
    primary = T.names_official(F.col("primary_source"))
    listed = F.array_distinct(F.array_compact(F.concat(F.array("primary_source"), F.coalesce("sources", F.array().cast("array<string>")))))
    official, other = F.exists(listed, T.names_official), F.exists(listed, lambda s: ~T.names_official(s))
    lag = F.col("lag_days")
    e = events.agg(F.count("*").alias("events"), F.count_if(official).alias("official_involved"), F.count_if(primary).alias("official_primary"), F.count_if(primary & other).alias("official_primary_followed"), F.count_if(~primary & official).alias("media_primary_official_second"), F.count(lag).alias("lags_known"), F.count_if(lag >= 0).alias("lag_leads"), F.round(F.avg(lag), 6).alias("lag_mean"), F.round(F.percentile(lag, 0.5), 6).alias("lag_q50"))
    df = e.join(F.broadcast(history.toDF("history_events", "history_official"))).join(F.broadcast(pairs))  # a row each
    total = F.col("events") + F.col("history_events")
    pair_lead = F.when(F.col("strict_positive") > 0, F.col("strict_positive")).otherwise(F.col("strict_nonnegative"))
    df = df.withColumns({"effective_events": total, "effective_share": F.round(F.when(total > 0, (F.col("official_involved") + F.col("history_official")) / total).otherwise(0.0), 6), "lead_events": F.when(F.col("lags_known") > 0, F.col("lag_leads")).when(pair_lead > 0, pair_lead).otherwise(F.col("official_primary_followed")), "lead_basis": F.when(F.col("lags_known") > 0, "lag").when(pair_lead > 0, "pair_strict_lag").otherwise("source_order")})
    return df.withColumn("passed", (F.col("effective_events") >= min_events) & (F.col("effective_share") >= min_share) & (F.col("lead_events") >= min_lead))


def historical_mechanism(cases: DataFrame) -> DataFrame:
    """One row of ``cases (region, government_action, gap_days)`` in the USA: how many hold an official action, how many follow the crisis, and both."""
    usa = cases.where(in_region(F.col("region")))
    act, after = F.coalesce("government_action", F.lit(False)), F.coalesce(F.col("gap_days") >= 0, F.lit(False))
    share = lambda c: F.round(F.coalesce(F.avg(c.cast("double")), F.lit(0.0)), 6)
    return usa.agg(F.count("*").alias("events"), F.count_if(act).alias("government_action"), share(act).alias("government_action_share"), F.count_if(after).alias("positive_gap"), share(after).alias("positive_gap_share"), F.count_if(act & after).alias("both"))


def pair_summary(pairs: DataFrame) -> DataFrame:
    """One row of ``pairs (m_ord, o_ord, lag_days, tier, m_published_at, m_publisher)``: pairs by tier, lags of strict ones, official items that strict pairs follow."""
    tier = lambda t: F.col("tier") == t
    strict = tier("strict")
    return pairs.agg(F.count("*").alias("pairs"), F.count_if(strict).alias("strict"), F.count_if(tier("proxy_strict")).alias("proxy_strict"), F.count_if(tier("balanced")).alias("balanced"), F.count_if(strict & (F.col("lag_days") >= 0)).alias("strict_nonnegative"), F.count_if(strict & (F.col("lag_days") > 0)).alias("strict_positive"), F.count_if(tier("proxy_strict") & (F.col("lag_days") > 0)).alias("proxy_positive"), F.count_if(strict & F.col("m_published_at").isNotNull()).alias("strict_timed"), F.count_if(F.coalesce("m_publisher", F.lit("")) != "").alias("with_publisher"), F.count_distinct(F.when(strict, F.col("o_ord"))).alias("followed_officials"))


#: Profiles by name: how far below the asked events and share they go and at least, and which evidence of a lead they take.
PROFILES = {"strict_primary": (0, 0, 0.0, 0.0, 1), "balanced_proxy": (2, 4, 0.10, 0.20, 2), "exploratory_proxy": (4, 3, 0.20, 0.10, 3)}


def sensitivity(metrics: DataFrame, min_events: int = 3, min_share: float = 0.3, min_lead: int = 1) -> DataFrame:
    """The profiles' thresholds relative to the asked ones, their lead events and results, and what they say of the strict one.

    ``metrics`` has ``effective_events, effective_share, lead_events, proxy_positive, official_primary_followed`` as from :func:`mechanism`.
    """
    rows = [(name, max(least_n, min_events - n) if n else min_events, round(max(least_s, round(min_share - s, 2)), 2) if n else min_share, modes) for name, (n, least_n, s, least_s, modes) in PROFILES.items()]
    profiles = F.explode(F.array(*[F.struct(F.lit(n).alias("profile"), F.lit(e).alias("least_events"), F.lit(s).alias("least_share"), F.lit(m).alias("_modes")) for n, e, s, m in rows]))
    lead = F.greatest("lead_events", F.when(F.col("_modes") >= 2, F.col("proxy_positive")).otherwise(0), F.when(F.col("_modes") >= 3, F.col("official_primary_followed")).otherwise(0))
    df = metrics.select("*", profiles.alias("x")).select(*metrics.columns, "x.*").withColumn("profile_leads", lead)
    df = df.withColumn("profile_passed", (F.col("effective_events") >= F.col("least_events")) & (F.col("effective_share") >= F.col("least_share")) & (F.col("profile_leads") >= min_lead)).drop("_modes")
    other = [c for c in metrics.columns]
    each = df.groupBy(*other).agg(F.bool_or(F.when(F.col("profile") == "strict_primary", F.col("profile_passed"))).alias("_s"), F.bool_or(F.when(F.col("profile") != "strict_primary", F.col("profile_passed"))).alias("_r"), F.collect_list(F.struct("profile", "least_events", "least_share", "profile_leads", "profile_passed")).alias("_p"))  # three profiles
    return each.select(*other, F.when(F.col("_s"), "not_over_strict").when(F.col("_r"), "conservative_but_not_excessive").otherwise("evidence_limited").alias("judgement"), F.inline("_p"))


def inference(temporal: Column, core: Column, falsification: Column, mechanism_passed: Column) -> Column:
    """The level of evidence: association in time, then identification, then a mechanism, each only on top of the one before."""
    return F.when(~temporal, "NO_TEMPORAL_SIGNAL").when(~(core & falsification), "TEMPORAL_ASSOCIATION_ONLY").when(~mechanism_passed, "CAUSAL_SIGNAL_WITHOUT_STRATEGIC_MECHANISM").otherwise("STRATEGIC_COMMUNICATION_INDICATION")


def reproducibility(runs: DataFrame, now: DataFrame) -> DataFrame:
    """Whether ``now (signature, at)`` repeats a run of an earlier day, or one of the same day that had passed. ``runs (signature, at, passed)``."""
    old = runs.select("signature", F.col("at").alias("was"), "passed")
    j = now.join(old, "signature", "left")
    earlier, same = F.to_date("was") < F.to_date("at"), (F.to_date("was") == F.to_date("at")) & (F.col("was") < F.col("at")) & F.col("passed")
    return j.groupBy("signature", "at").agg(F.count_if(earlier).alias("earlier_runs"), F.count_if(same).alias("same_day_passed")).withColumn("reproduced", (F.col("earlier_runs") > 0) | (F.col("same_day_passed") > 0))


KEYS = ["query", "start", "end", "policy"]


def replay_filter(jobs: DataFrame, history: DataFrame, now: Column, cooldown_hours: float = 6.0) -> DataFrame:
    """``jobs`` with ``skip``: why a failed range isn't tried again, by the latest run of it; null if it is."""
    whole = history.where(" AND ".join(f"coalesce(cast({k} AS string), '') <> ''" for k in KEYS))
    last = whole.groupBy(*KEYS).agg(F.max_by(F.struct("status", "at"), F.struct("at", -F.col("ord"))).alias("h")).select(*KEYS, "h.*")
    hours = (F.unix_timestamp(now) - F.unix_timestamp("at")) / 3600
    skip = F.when(F.col("status") == "full_success", "already_full_success").when(F.col("status").isin("failed", "partial_success") & (hours < cooldown_hours), "cooldown_active")
    return jobs.join(last, KEYS, "left").withColumn("skip", skip).drop("status", "at")


def job_status(exit_code: Column, failed: Column, written: Column) -> Column:
    return F.when(exit_code != 0, "failed").when(failed == 0, "full_success").when(written > 0, "partial_success").otherwise("failed")


def slice_ranges(ranges: DataFrame, days: int) -> DataFrame:
    """``start, end`` cut into slices of ``days`` days, the last one shorter; whole for 0 or less."""
    if days <= 0:
        return ranges.withColumn("part", F.lit(0))
    cut = F.posexplode(F.sequence("start", "end", F.expr(f"interval {days} day")))
    rest = [c for c in ranges.columns if c not in ("start", "end")]
    return ranges.where(F.col("start") <= F.col("end")).select(*rest, "end", cut.alias("part", "s")).select(*rest, F.col("s").alias("start"), F.least("end", F.date_add("s", days - 1)).alias("end"), "part")


def split_range(start: Column, end: Column) -> Column:
    """The two halves of a range, the first the shorter; the range itself if it is one day."""
    n = F.datediff(end, start) + 1
    mid = F.date_add(start, (F.floor(n / 2) - 1).cast("int"))
    one = lambda a, b: F.struct(a.alias("start"), b.alias("end"))
    return F.when(n <= 1, F.array(one(start, end))).otherwise(F.array(one(start, mid), one(F.date_add(mid, 1), end)))


def failed_days(ranges: DataFrame, lower: Column, upper: Column) -> DataFrame:
    """The days of failed ranges, clipped."""
    a, b = F.greatest("start", lower), F.least("end", upper)
    return ranges.withColumns({"_a": a, "_b": b}).where("_a <= _b").select(F.explode(F.sequence("_a", "_b")).alias("d")).distinct()


def collect_jobs(failed: DataFrame, days: int = 0, order: str = "shortest", most: int | None = None) -> DataFrame:
    """Failed ranges of runs as jobs: sliced, each range once (its first), in order of length."""
    cut = slice_ranges(failed, days)
    jobs = cut.groupBy("query", "start", "end").agg(F.min_by(F.struct("run_id", "ord"), F.struct("ord", "part")).alias("x")).select("query", "start", "end", "x.*").withColumn("days", F.datediff("end", "start") + 1)
    by = {"shortest": [F.col("days")], "longest": [F.col("days").desc()], "none": []}[order]
    jobs = jobs.orderBy(*by, "ord", "query", "start")
    return jobs.limit(most) if most else jobs
