"""The review: what panel, sources, models and mechanism amount to, one row for each state of them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import gates as G


@dataclass(frozen=True)
class ReviewRules:
    """What sources and panel need; failed sources are counted against a share of all, one at least."""

    policy: str = "strict-balanced"
    min_availability: float = 0.9
    max_failed_percent: int = 10
    min_observed_ratio: float = 0.85
    max_missing_streak: int = 30


#: Verdicts that speak of a correlation or a signal.
SPEAKING = ("temporal_correlation_only", "causal_signal", "windows_without_clear_lead", "weak_signal", "correlation_or_weak")
#: What to do next, by level of evidence.
NEXT_ACTIONS = {
    "NO_TEMPORAL_SIGNAL": ["check keywords and event definitions", "widen the history and complete the sources", "no causal reading before a stable correlation"],
    "TEMPORAL_ASSOCIATION_ONLY": ["complete panel and shock days, then the causal gates", "run all models with placebo and reverse tests", "no talk of intent before the causal gates"],
    "CAUSAL_SIGNAL_WITHOUT_STRATEGIC_MECHANISM": ["add shares and lags of official sources", "tell official releases from media amplification, event by event", "causal effect only, no strategy"],
    "STRATEGIC_COMMUNICATION_INDICATION": ["repeat on other days and in other periods", "add documents and hearings", "an indication of strategy is no proof of motive"],
}


def lock_reason() -> Column:
    """Why a catalog fails its lock, from ``shock_source, shock_key, has_catalog, has_lock, catalog_signature, lock_signature, catalog_keys``; not_required unless shocks come from the catalog."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    match = ~blank("catalog_signature") & ~blank("lock_signature") & (F.col("catalog_signature") == F.col("lock_signature"))
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    key = blank("shock_key") | F.coalesce(F.array_contains("catalog_keys", F.col("shock_key")), F.lit(False))
    needed = F.coalesce(F.col("shock_source") == "catalog", F.lit(False))
    return F.when(~needed, "not_required").when(no("has_catalog"), "catalog_missing_or_invalid").when(no("has_lock"), "lock_missing_or_invalid").when(~match, "catalog_lock_signature_mismatch").when(~key, "panel_shock_key_missing_in_catalog").otherwise("ok")


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def level(core: Column, falsification: Column, reproducible: Column, external: Column, temporal: Column) -> Column:
    """L4 to L0: all gates and a replication elsewhere, all gates, the core ones, a signal in time, nothing."""
    whole = core & falsification & reproducible
    return F.when(whole & external, "L4").when(whole, "L3").when(core, "L2").when(temporal, "L1").otherwise("L0")


def assemble(state: DataFrame, rules: ReviewRules = ReviewRules()) -> DataFrame:
    """``state`` with the review's gates, ``inference``, ``next_actions`` and ``signature``.

    ``state`` has ``approval_status, approval_level, approval_gates, verdict, scraped_policy, causal_policy,
    progress_policy, availability, failed_sources, total_sources, observed_days, shock_days, observed_ratio,
    max_missing_streak``, the lock's columns, ``dual_status, dual_gates, did_status, did_passed, did_controls,
    event_status, event_passed, synth_status, synth_passed, ml_status, ml_passed, ml_ready, n_ufo, n_crisis,
    mechanism_passed``. What is missing is not passed; a state without any policy is inconsistent.
    """
    gate = lambda p: G.gate("approval_gates", p)
    allowed = F.when(F.col("total_sources") > 0, F.greatest(F.lit(1), F.floor(F.col("total_sources") * rules.max_failed_percent / 100))).otherwise(0)
    policies = F.filter(F.array("scraped_policy", "causal_policy", "progress_policy"), lambda p: F.coalesce(p, F.lit("")) != "")
    df = state.withColumns({
        "approval_gate_passed": _true(F.col("approval_status") == "APPROVED"),
        "sample_gates_passed": gate("observed_days>=") & gate("shock_days") & gate("observed_ratio>="),
        "directional_gates_passed": gate("significant_windows>=2") & gate("lead_lag_positive") & gate("reverse_not_dominant"),
        "continuity_gate_passed": _true((F.col("observed_ratio") >= rules.min_observed_ratio) & (F.col("max_missing_streak") <= rules.max_missing_streak)),
        "lock_reason": lock_reason(),
        "source_gate_passed": _true((F.col("availability") >= rules.min_availability) & (F.col("failed_sources") <= allowed)),
        "dual_stable_passed": _true((F.col("dual_status") == "stable") & (F.size("dual_gates") > 0) & F.forall("dual_gates", lambda g: _true(g["passed"]))),
        "policy_consistency_passed": (F.size(policies) > 0) & F.forall(policies, lambda p: p == rules.policy),
        "has_temporal_signal": _true(((F.col("observed_days") > 0) & (F.col("shock_days") > 0)) | ((F.col("n_ufo") > 0) & (F.col("n_crisis") > 0))),
        "verdict_speaks": _true(F.col("verdict").isin(*SPEAKING)),
        "models_estimated": _true((F.col("did_status") == "ok") & (F.col("event_status") == "ok") & (F.col("synth_status") == "ok")),
    })
    df = df.withColumn("lock_passed", F.col("lock_reason").isin("ok", "not_required"))
    core = [f"{c}_passed" for c in ("approval_gate", "sample_gates", "directional_gates", "continuity_gate", "lock", "source_gate", "dual_stable", "policy_consistency")]
    all_of = lambda cols: F.forall(F.array(*cols), lambda x: x)
    falsified = F.col("models_estimated") & _true(F.col("did_passed")) & _true(F.col("event_passed")) & _true(F.col("synth_passed")) & _true(F.col("did_controls"))
    consistent = ~_true(F.col("ml_status") == "ok") | _true(F.col("ml_passed")) | ~F.coalesce(F.col("ml_ready"), F.lit(True))  # an extra check, and none where the model can't run
    df = df.withColumns({"core_passed": all_of(core), "falsification_passed": falsified & consistent, "temporal": F.col("has_temporal_signal") | F.col("verdict_speaks")})
    df = df.withColumn("inference", G.inference(F.col("temporal"), F.col("core_passed"), F.col("falsification_passed"), _true(F.col("mechanism_passed"))))
    actions = F.lit(None).cast("array<string>")
    for name, steps in NEXT_ACTIONS.items():
        actions = F.when(F.col("inference") == name, F.array(*map(F.lit, steps))).otherwise(actions)
    signed = ["approval_status", "approval_level", "core_passed", "falsification_passed", "lock_passed", "policy_consistency_passed", "did_passed", "event_passed", "synth_passed", "ml_passed", "observed_days", "shock_days", "dual_status", "inference"]
    return df.withColumns({"next_actions": actions, "signature": F.sha2(F.to_json(F.struct(*signed), {"ignoreNullFields": "false"}), 256)})


def review(state: DataFrame, history: DataFrame, rules: ReviewRules = ReviewRules(), external: Column | None = None) -> DataFrame:
    """:func:`assemble` with ``reproduced`` (an earlier day's run of ``history (signature, at, passed)`` has this signature, or one of this day that was reproduced), ``matched_runs`` and ``level``. ``state`` has ``generated_at``, too."""
    df = assemble(state, rules)
    now = df.select("signature", F.col("generated_at").alias("at")).distinct()
    mine = history.join(now.select("signature", "at").withColumnRenamed("at", "_now"), "signature").groupBy("signature", "_now")
    same = F.to_date("at") == F.to_date("_now")
    seen = mine.agg(F.count("*").alias("matched_runs"), F.bool_or(F.to_date("at") < F.to_date("_now")).alias("cross_day_repeat"), F.bool_or(same).alias("same_day_repeat"), F.bool_or(same & _true(F.col("passed"))).alias("_same_passed"))
    df = df.join(seen.withColumnRenamed("_now", "generated_at"), ["signature", "generated_at"], "left")
    df = df.withColumns({"matched_runs": F.coalesce("matched_runs", F.lit(0)), "cross_day_repeat": _true(F.col("cross_day_repeat")), "same_day_repeat": _true(F.col("same_day_repeat"))})
    df = df.withColumn("reproduced", F.col("cross_day_repeat") | _true(F.col("_same_passed"))).drop("_same_passed")
    return df.withColumn("level", level(F.col("core_passed"), F.col("falsification_passed"), F.col("reproduced"), F.lit(False) if external is None else _true(external), F.col("temporal")))
