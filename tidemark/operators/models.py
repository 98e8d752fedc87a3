"""Model runs over a daily panel: tests of effects against drawn days, and the gates that decide on them.

Each run reads series of one row a day and returns one small record. What reaches the driver are counts, means and
shares; the draws are made and averaged in the tasks.
"""

from __future__ import annotations

import random
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import shared_table
from . import draws as D
from . import estimators as E
from . import forests as FT
from . import permute as T
from . import windows as WN

#: Thresholds of the gates.
MIN_EFFECT, BUFFER, EVENT_BUFFER = 0.05, 7, 14
PRETREND_RATIO, PRETREND_FLOOR, LEAST_DRAWS = 0.6, 2.0, 200
#: The least observed days and shocks of a model, and the least shocks where a catalog names them.
DID_DAYS, DID_SHOCKS, EVENT_DAYS, EVENT_SHOCKS, SYNTH_SHOCKS, CATALOG_SHOCKS = 60, 8, 90, 10, 8, 5
MIN_PRE_DAYS, MIN_POST_DAYS, MIN_PRE_GAPS, MIN_POST_GAPS, NEAR_ZERO = 30, 8, 20, 6, 0.05


def _round(x: float | None) -> float | None:
    return None if x is None else round(x, 6)


def below(p: float | None, limit: float) -> bool:
    """Missing values are below nothing."""
    return p is not None and p < limit


def window_test(effects: DataFrame, shocks: DataFrame, n_shocks: int, pool: DataFrame, draws: int, seed: int) -> dict:
    """``status, att, p, draws, n`` of ``effects (d, e)``: the mean effect of the shocks against as many drawn days of the pool.

    Pending under three shocks with an effect, or under half of them, and where the pool has fewer days than that.
    """
    known = effects.where(F.col("e").isNotNull())
    r = known.join(shocks.select("d"), "d", "left_semi").agg(F.count("*").alias("n"), F.avg("e").alias("m")).first()
    if r["n"] < max(3, n_shocks // 2):
        return {"status": "few_observations", "att": None, "p": None, "draws": 0, "n": r["n"]}
    null = T.null_table(known, ["e"], pool, r["n"], draws, seed)
    got = T.p_of(null, {"e": r["m"]}).first()
    return {"status": "ok" if got["draws"] else "small_pool", "att": _round(r["m"]), "p": _round(got["p"]) if got["draws"] else None, "draws": got["draws"], "n": r["n"]}


def violation(real: dict, placebo: dict, least: float = MIN_EFFECT) -> tuple[bool, bool]:
    """Whether a placebo treatment has an effect of its own (positive, over ``least``, at p < 0.1), and whether it reaches the real one."""
    if placebo["status"] != "ok":
        return False, False
    att = placebo["att"] or 0.0
    reaches = real["status"] == "ok" and (real["att"] or 0.0) > 0 and att >= (real["att"] or 0.0)
    return att > least and below(placebo["p"], 0.1), reaches


def placebo_days(pool: DataFrame, n: int, seed: int) -> DataFrame:
    """``n`` days of the pool by one draw of the recorded generator; all of it where it has no more."""
    days = [r["d"] for r in pool.select("d").distinct().orderBy("d").collect()]  # a row a day
    drawn = days if len(days) <= n else random.Random(seed).sample(days, n)
    return pool.sparkSession.createDataFrame([(d,) for d in sorted(drawn)], "d date")


def too_few(days: int, shocks: int, min_days: int, min_shocks: int, catalog: bool) -> str | None:
    """Why a model stays pending; shocks of a catalog need to be CATALOG_SHOCKS only."""
    return "few_days" if days < min_days else "few_shocks" if shocks < (CATALOG_SHOCKS if catalog else min_shocks) else None


def did(panel: DataFrame, topics: DataFrame, shocks: DataFrame, draws: int, seed: int, windows: Sequence[int] = (7, 14, 30), catalog: bool = False, min_days: int = DID_DAYS, min_shocks: int = DID_SHOCKS) -> dict:
    """Mean differences around all shocks by window, the same around as many placebo days, and of ``topics (d, topic, n)`` as negative controls at 7 days.

    Passes with a significant positive window, at least one negative control estimated and none with an effect, and no
    placebo window with an effect or as large as the real one. Pending, with nothing estimated, under ``min_days`` observed days or ``min_shocks`` shocks.
    """
    n_days, n_shocks = panel.count(), shocks.count()
    why = too_few(n_days, n_shocks, min_days, min_shocks, catalog)
    if why:
        empty = {"shocks_used": 0, "placebo_days": 0, "significant": 0, "placebo_estimated": 0, "placebo_violations": 0, "placebo_dominant": 0, "controls_estimated": 0, "control_violations": 0, "control_borderline": 0}
        return {"status": why} | empty | {f"{k}{w}": None for w in windows for k in ("att", "p", "placebo_att", "placebo_p")} | {"placebo_passed": False, "passed": False}
    pool = T.placebo_pool(panel, shocks, BUFFER)
    fake = placebo_days(pool, n_shocks, seed + 9973 + n_days)
    n_fake = fake.count()
    wide = WN.mean_effects(panel, "outcome", windows, panel)
    out: dict = {"status": "ok", "shocks_used": n_shocks, "placebo_days": n_fake, "significant": 0, "placebo_estimated": 0, "placebo_violations": 0, "placebo_dominant": 0, "controls_estimated": 0, "control_violations": 0, "control_borderline": 0}
    for w in windows:
        eff = wide.select("d", F.col(f"e{w}").alias("e"))
        real, placebo = window_test(eff, shocks, n_shocks, pool, draws, seed + w), window_test(eff, fake, n_fake, pool, draws, seed + w)
        out |= {f"att{w}": real["att"], f"p{w}": real["p"], f"placebo_att{w}": placebo["att"], f"placebo_p{w}": placebo["p"]}
        has, reaches = violation(real, placebo)
        out["placebo_estimated"] += placebo["status"] == "ok"
        out["placebo_violations"] += has
        out["placebo_dominant"] += reaches
        out["significant"] += real["status"] == "ok" and real["att"] > 0 and below(real["p"], 0.05)
    for r in topics.select("topic").distinct().orderBy("topic").collect():  # the topics of a lexicon
        one = topics.where(F.col("topic") == r["topic"]).select("d", F.col("n").alias("v"))
        got = window_test(WN.mean_effects(one, "v", (7,), one).select("d", F.col("e7").alias("e")), shocks, n_shocks, pool, draws, seed + 7)
        out["controls_estimated"] += got["status"] == "ok"
        if got["status"] == "ok" and got["att"] > 0 and below(got["p"], 0.1):
            out["control_violations" if got["att"] > MIN_EFFECT else "control_borderline"] += 1
    placebo_ok = out["placebo_estimated"] > 0 and not out["placebo_violations"] and not out["placebo_dominant"]
    return out | {"placebo_passed": placebo_ok, "passed": out["significant"] >= 1 and out["controls_estimated"] > 0 and not out["control_violations"] and placebo_ok}


def event_study(panel: DataFrame, shocks: DataFrame, draws: int, seed: int, catalog: bool = False, min_days: int = EVENT_DAYS, min_shocks: int = EVENT_SHOCKS) -> dict:
    """The dynamic effect's peak over all shocks against drawn days, and its trend before them. Undecided under LEAST_DRAWS draws; pending, with nothing estimated, under ``min_days`` observed days or ``min_shocks`` shocks."""
    n = shocks.count()
    why = too_few(panel.count(), n, min_days, min_shocks, catalog)
    if why:
        return {"shocks_used": 0, "pretrend": None, "peak": None, "p": None, "draws": 0, "status": why, "pretrend_ok": False, "peak_positive": False, "p_significant": False, "passed": False}
    diffs = WN.event_diffs(panel, "outcome", panel)
    curve = diffs.join(shocks, "d", "left_semi").groupBy("k").agg(F.round(F.avg("diff"), 6).alias("m"))
    c = curve.agg(F.avg(F.when(F.col("k") < 0, F.abs("m"))).alias("pre"), F.max(F.when(F.col("k") > 0, F.col("m"))).alias("peak")).first()
    null = T.null_table(WN.wide_diffs(diffs), [str(k) for k in range(1, 15)], T.placebo_pool(panel, shocks, EVENT_BUFFER), n, draws, seed, peak=6)
    peak = c["peak"] if c["peak"] is not None else 0.0
    got = T.p_of(null, {"peak": peak}).first()
    p, drawn = (got["p"], got["draws"]) if got["draws"] else (1.0, 0)
    limit = max(PRETREND_FLOOR, PRETREND_RATIO * abs(c["peak"])) if c["pre"] is not None and c["peak"] is not None and abs(c["peak"]) > 1e-9 else None
    decided = drawn >= LEAST_DRAWS
    flat, positive, significant = decided and limit is not None and c["pre"] <= limit, decided and c["peak"] is not None and c["peak"] > 0, decided and p < 0.05
    return {"shocks_used": n, "pretrend": _round(c["pre"]), "peak": _round(c["peak"]), "p": _round(p), "draws": drawn, "status": "ok" if decided else "few_draws", "pretrend_ok": flat, "peak_positive": positive, "p_significant": significant, "passed": flat and positive and significant}


def synth_test(treated: DataFrame, donors: DataFrame, shocks: DataFrame, draws: int, seed: int, catalog: bool = False, min_shocks: int = SYNTH_SHOCKS) -> dict:
    """The synthetic gap after shocks less that before, against drawn pre days: shares at least, and at most, as large.

    Donors need an overlap of 15 pre days, or a quarter of them, and there must be three. Passes when positive and
    significant, or near zero without a significant negative effect.
    """
    phases = E.pre_post(treated, shocks.select("d"))
    n = {r["phase"]: r["count"] for r in phases.groupBy("phase").count().collect()}
    out = {"n_pre": n.get("pre", 0), "n_post": n.get("post", 0), "donors": 0, "att": None, "p": None, "p_negative": None, "draws": 0, "status": "few_days", "near_zero": False, "no_negative": False, "passed": False}
    if too_few(0, shocks.count(), 0, min_shocks, catalog):
        return out | {"status": "few_shocks"}
    if out["n_pre"] < MIN_PRE_DAYS or out["n_post"] < MIN_POST_DAYS:
        return out
    pre = phases.where("phase = 'pre'").select("d")
    fit = donors.join(pre, "d", "left_semi").groupBy("unit").agg(F.count("*").alias("c")).where(F.col("c") >= max(15, out["n_pre"] // 4)).select("unit")
    out["donors"] = fit.count()
    if out["donors"] < 3:
        return out | {"status": "few_donors"}
    donors = donors.join(F.broadcast(fit), "unit", "left_semi")  # a row per unit
    gap = E.synth_gap(treated, donors, E.synth_weights(treated, donors, phases.where("phase = 'pre'"))).join(phases, "d")
    g = gap.agg(F.count_if(F.col("phase") == "pre").alias("a"), F.count_if(F.col("phase") == "post").alias("b"), F.avg(F.when(F.col("phase") == "pre", F.col("gap"))).alias("x"), F.avg(F.when(F.col("phase") == "post", F.col("gap"))).alias("y")).first()
    if g["a"] < MIN_PRE_GAPS or g["b"] < MIN_POST_GAPS:
        return out | {"status": "few_gaps"}
    att = g["y"] - g["x"]
    before = gap.where("phase = 'pre'").select("d", (F.col("gap") - F.lit(g["x"])).alias("gap"))
    got = T.p_of(T.null_table(before, ["gap"], before, g["b"], draws, seed), {"gap": att}).first()
    if not got["draws"]:
        return out | {"status": "small_pool", "att": _round(att)}
    near, fine = abs(att) <= NEAR_ZERO, not (att < -NEAR_ZERO and got["p_negative"] < 0.05)
    return out | {"att": _round(att), "p": _round(got["p"]), "p_negative": _round(got["p_negative"]), "draws": got["draws"], "status": "ok", "near_zero": near, "no_negative": fine, "passed": att > 0 and got["p"] < 0.05 or near and fine and att >= -NEAR_ZERO}


def residual_test(fit: DataFrame, draws: int, seed: int) -> dict:
    """``ate, p, draws, null_low, null_high`` of ``fit (d, y, t, y_hat, t_hat)``: residual on residual against treatment residuals that the recorded generator shuffles, on both sides; the observed value counts as a draw."""
    rows = fit.select("d", (F.col("y") - F.col("y_hat")).alias("y"), (F.col("t") - F.col("t_hat")).alias("t")).orderBy("d").collect()  # a row a day
    y, t = (np.array([r[c] for r in rows], float) for c in ("y", "t"))
    den = float((t * t).sum())
    if den <= 1e-9:
        return {"ate": 0.0, "p": 1.0, "draws": 0, "null_low": None, "null_high": None}
    ate = float((t * y).sum()) / den
    null = D.over_draws(fit.sparkSession, seed, draws, D.shuffling(len(t)), lambda at: [float((t[at] * y).sum()) / den], "x double")
    r = null.agg(F.count("*").alias("n"), F.count_if(F.abs("x") >= abs(ate)).alias("k"), F.percentile("x", 0.025).alias("a"), F.percentile("x", 0.975).alias("b")).first()
    return {"ate": _round(ate), "p": _round((r["k"] + 1) / (r["n"] + 1)), "draws": r["n"], "null_low": _round(r["a"]), "null_high": _round(r["b"])}


def cate(fit: DataFrame, features: list[str], alpha: float = 2.0) -> DataFrame:
    """``fit`` with ``tau``: each day's effect by a ridge fit of the residuals' ratio, weighted by the squared treatment residual. Only the normal equations reach the driver."""
    tr = F.col("t") - F.col("t_hat")
    safe = F.when(F.abs(tr) >= 1e-3, tr).when(tr >= 0, 1e-3).otherwise(-1e-3)
    df = fit.withColumn("_target", (F.col("y") - F.col("y_hat")) / safe)
    beta = E.solve_ridge([(r["i"], r["j"], r["value"] or 0.0) for r in E.gram(df, features, "_target", F.greatest(F.lit(1e-6), tr * tr)).collect()], alpha)
    return df.withColumn("tau", sum((F.lit(b) * F.col(c) for b, c in zip(beta[1:], features)), F.lit(beta[0]))).drop("_target")


def causal_ml(data: DataFrame, features: list[str], draws: int, seed: int, folds: int = 5, forest: bool = False, trees: tuple[int, int] = (300, 500), catalog: bool = False, min_days: int = 120, min_shocks: int = 10, min_treated: int = 12, min_ratio: float = 0.002) -> dict:
    """Cross-fitted effects of ``data (d, fold, y, t, ...)``, their permutation test, the effects' spread and six gates, by ridge fits or by forests.

    ``status`` says why nothing was estimated: too few days, too few shocks (fewer will do from a catalog), treated days
    too sparse, or no variation of the treatment left. Passes when ATT and ATE are positive, the latter significantly,
    both models are more than stand-ins, and the effects' spread is known.
    """
    s = data.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("t").cast("long")), F.lit(0)).alias("k")).first()
    n, treated = s["n"], s["k"]
    support = treated >= min_treated and treated >= min_ratio * n
    gates = dict.fromkeys(("att_positive", "ate_positive", "ate_significant", "nuisance_model_ready", "cate_model_ready", "heterogeneity_estimated"), False)
    nothing = {"ate": None, "att": None, "p": None, "draws": 0, "null_low": None, "null_high": None, "tau_low": None, "tau_high": None, "tau_spread": None, "nuisance": "", "cate": ""}
    out = {"n": n, "treated": treated, "support_ok": support}
    why = "few_days" if n < min_days else "few_shocks" if treated < (CATALOG_SHOCKS if catalog else min_shocks) else "" if support else "treated_support_too_sparse"
    if why:
        return out | {"status": why} | nothing | gates | {"passed": False}
    if forest:
        fit, nuisance = FT.cross_fit_forest(data, features, folds, seed, trees[0])
    elif n < FT.LEAST_ROWS:
        fit, nuisance = FT.cross_fit_forest(data, features, folds, seed)  # means
    else:
        fit, nuisance = E.cross_fit(data, features, F.col("fold"), folds), "cross_fitted_ridge"
    fit = shared_table(fit, "causal-fit")
    test = residual_test(fit, draws, seed + 77)
    if not test["draws"]:
        return out | {"status": "blocked"} | nothing | {"nuisance": nuisance} | gates | {"passed": False}
    e = E.orthogonal_effects(fit).first()
    spread, cate_by = FT.forest_cate(fit, features, seed, trees[1]) if forest or n < FT.LEAST_ROWS else (cate(fit, features), "orthogonal_ridge_proxy")
    h = E.heterogeneity(spread).first() or {"low": None, "high": None, "spread": None}  # no row without days
    gates = {"att_positive": e["att"] > 0, "ate_positive": e["ate"] > 0, "ate_significant": below(test["p"], 0.05), "nuisance_model_ready": nuisance != "mean_fallback", "cate_model_ready": cate_by not in ("constant_cate_fallback", "no_data"), "heterogeneity_estimated": h["spread"] is not None}
    found = {"ate": _round(e["ate"]), "att": _round(e["att"]), "p": test["p"], "draws": test["draws"], "null_low": test["null_low"], "null_high": test["null_high"], "tau_low": h["low"], "tau_high": h["high"], "tau_spread": h["spread"], "nuisance": nuisance, "cate": cate_by}
    return out | {"status": "ok"} | found | gates | {"passed": all(gates.values())}


def record(spark, row: dict) -> DataFrame:  # noqa: ANN001
    """One row, typed by its values: whole numbers as long, shares and effects (or their lack) as double."""
    kind = lambda v: "boolean" if isinstance(v, bool) else "long" if isinstance(v, int) else "string" if isinstance(v, str) else "double"
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {kind(v)}" for k, v in row.items()))
