"""The review, kept versions, audits and country controls on small cases."""

import datetime

import pytest
from pyspark.sql import functions as F

from tidemark import config as C
from tidemark.operators import audit, country, gates, review
from tidemark.plans import audits
from tidemark.sources import versions

T0 = datetime.datetime(2024, 5, 1, 12)
GOOD = {
    "approval_status": "APPROVED", "approval_level": "CAUSAL_SIGNAL", "verdict": "causal_signal", "scraped_policy": "strict-balanced", "causal_policy": "strict-balanced", "progress_policy": None,
    "availability": 0.95, "failed_sources": 1, "total_sources": 12, "observed_days": 400, "shock_days": 20, "observed_ratio": 0.9, "max_missing_streak": 3,
    "shock_source": "catalog", "shock_key": "shock_dates", "has_catalog": True, "has_lock": True, "catalog_signature": "s", "lock_signature": "s", "dual_status": "stable",
    "did_status": "ok", "did_passed": True, "did_controls": True, "event_status": "ok", "event_passed": True, "synth_status": "ok", "synth_passed": True, "ml_status": "ok", "ml_passed": True, "ml_ready": True, "n_ufo": 3, "n_crisis": 4, "mechanism_passed": True,
}


def state(spark, failing=(), **other):
    kind = lambda v: "boolean" if isinstance(v, bool) else "long" if isinstance(v, int) else "double" if isinstance(v, float) else "string"
    row = GOOD | other
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {kind(GOOD[k])}" for k in row))
    g = gates.gate_array({n: F.lit(n not in failing) for n in audits.GATES})
    return df.withColumns({"approval_gates": g, "dual_gates": gates.gate_array({"a": F.lit(True)}), "catalog_keys": F.array(F.lit("shock_dates")), "generated_at": F.lit(T0)})


def runs(spark, *rows):
    return spark.createDataFrame(list(rows), "signature string, at timestamp, passed boolean")


def test_levels(spark):
    none = runs(spark)
    first = review.review(state(spark), none).first()
    assert (first.level, first.inference, first.reproduced) == ("L2", "STRATEGIC_COMMUNICATION_INDICATION", False) and len(first.next_actions) == 3
    day = datetime.timedelta(1)
    earlier = runs(spark, (first.signature, T0 - day, False), ("other", T0 - day, True))
    assert review.review(state(spark), earlier).first().level == "L3"
    assert review.review(state(spark), earlier, external=F.lit(True)).first().level == "L4"
    for passed, want in ((True, "L3"), (False, "L2")):
        r = review.review(state(spark), runs(spark, (first.signature, T0 - day / 24, passed))).first()
        assert (r.level, r.same_day_repeat, r.matched_runs) == (want, True, 1)
    assert review.review(state(spark, approval_status="REJECTED"), earlier).first().level == "L1"
    quiet = dict(approval_status="REJECTED", observed_days=0, n_ufo=0, verdict="windows_but_placebo_fails")
    r = review.review(state(spark, **quiet), none).first()
    assert (r.level, r.inference) == ("L0", "NO_TEMPORAL_SIGNAL")


@pytest.mark.parametrize(
    ("change", "gate"),
    [
        ({"approval_status": None}, "approval_gate_passed"), ({"failing": ("shock_days",)}, "sample_gates_passed"), ({"failing": ("lead_lag_positive",)}, "directional_gates_passed"),
        ({"observed_ratio": 0.84}, "continuity_gate_passed"), ({"max_missing_streak": 31}, "continuity_gate_passed"), ({"lock_signature": "t"}, "lock_passed"), ({"has_lock": None}, "lock_passed"), ({"shock_key": "odd"}, "lock_passed"),
        ({"availability": 0.89}, "source_gate_passed"), ({"failed_sources": 2}, "source_gate_passed"), ({"total_sources": 0}, "source_gate_passed"), ({"dual_status": "unstable"}, "dual_stable_passed"), ({"causal_policy": "strict"}, "policy_consistency_passed"),
    ],
)
def test_each_gate_holds_the_core(spark, change, gate):
    r = review.assemble(state(spark, **change)).first()
    assert not r[gate] and not r.core_passed and r.falsification_passed and r.inference == "TEMPORAL_ASSOCIATION_ONLY"


def test_falsification(spark):
    falsified = lambda **k: review.assemble(state(spark, **k)).first().falsification_passed
    assert falsified() and falsified(ml_passed=False, ml_ready=False) and falsified(ml_passed=False, ml_status="blocked") and falsified(shock_source="p90", has_catalog=False)
    assert not any(falsified(**{k: v}) for k, v in (("did_status", "few_days"), ("event_passed", False), ("synth_passed", None), ("did_controls", False), ("ml_passed", False)))
    a, b = (review.assemble(state(spark, **k)).first().signature for k in ({}, {"n_ufo": 9}))
    assert a == b != review.assemble(state(spark, shock_days=21)).first().signature
    assert review.assemble(state(spark, mechanism_passed=None)).first().inference == "CAUSAL_SIGNAL_WITHOUT_STRATEGIC_MECHANISM"


def test_versions(spark, tmp_path):
    path = str(tmp_path / "panel")
    assert versions.read_version(spark, path) is None
    row = lambda d, n: spark.createDataFrame([(d, "strict", n)], "date string, policy string, n int")
    for k, (d, n) in enumerate((("2024-01-01", 1), ("2024-01-02", 2), ("2024-01-01", 7))):
        assert versions.save_panel(spark, path, row(d, n), ["date", "policy"], T0 + datetime.timedelta(k)) == k
    now = versions.read_version(spark, path).collect()
    assert {(r.date, r.n) for r in now} == {("2024-01-01", 7), ("2024-01-02", 2)} and {r.updated_at for r in now} == {T0 + datetime.timedelta(2)}
    assert versions.read_version(spark, path, 0).count() == 1 and versions.read_version(spark, path, 9) is None
    assert sorted(p.name for p in (tmp_path / "panel").iterdir()) == ["v0", "v1", "v2"]


def test_a_save_that_comes_in_between_isn_t_lost(spark, tmp_path):
    path, calls = str(tmp_path / "t"), []

    def make(old):
        if not calls:  # another writer takes the number meanwhile
            calls.append(1)
            versions.commit(spark, path, lambda o: spark.range(1))
        return spark.range(10, 11) if old is None else old.union(spark.range(10, 11))

    assert versions.commit(spark, path, make) == 1
    assert sorted(r.id for r in versions.read_version(spark, path).collect()) == [0, 10]
    assert sorted(p.name for p in (tmp_path / "t").iterdir()) == ["v0", "v1"]


def test_history_and_lock(spark, tmp_path):
    path, lock = str(tmp_path / "h"), str(tmp_path / "lock")
    row = lambda at, s, level: spark.createDataFrame([(at, s, level)], "generated_at timestamp, signature string, level string")
    versions.append_history(spark, path, row(T0, "a", "L1"))
    versions.append_history(spark, path, row(T0, "a", "L2").union(row(T0, "b", "L1")))
    assert {(r.signature, r.level) for r in versions.read_version(spark, path).collect()} == {("a", "L1"), ("b", "L1")}
    assert versions.lock_signature(spark, lock) == ""
    with pytest.raises(versions.LockMismatch):
        versions.append_history(spark, path, row(T0, "c", "L1"), lock, "sig")
    versions.write_lock(spark, lock, "sig", "strict", "catalog", {"f": "1"}, {"gap": "30"}, T0)
    versions.append_history(spark, path, row(T0, "c", "L1"), lock, "sig")
    for other in ("sig2", ""):
        with pytest.raises(versions.LockMismatch):
            versions.enforce_lock(spark, lock, other)
    assert versions.read_version(spark, path).count() == 3 and versions.read_version(spark, lock).first().schema == "shock_catalog_lock_v1"


def test_audit_of_few_sources(spark):
    day = lambda k: datetime.date(2024, 1, k)
    status = spark.createDataFrame([("a", "x", "rss", 2, "ok", None, False, 1, None, None), ("b", "x", "rss", 2, "failed", "HTTP 403", True, 2, "", []), ("c", "y", "rss", None, "failed", "timed out", False, 3, None, ["u"]), ("d", "y", "json", 3, "failed", "timed out", False, 4, None, None)], "source string, category string, type string, weight int, status string, error string, used_fallback boolean, ord int, fallback_url string, fallback_urls array<string>")
    items = spark.createDataFrame([("a", day(3)), ("a", day(9)), ("b", None), ("z", day(1))], "source string, date date")
    w = audit.source_windows(status, items, F.lit(day(12)))
    assert {(r.source, r.span_days, r.has_recent_items) for r in w.collect()} == {("a", 7, True), ("b", 0, False), ("c", 0, False), ("d", 0, False)}
    assert audit.coverage(w).first()[:] == (4, 1, 1, "low") and audit.coverage(w.where("source = 'a'")).first()[3] == "high" and audit.coverage(w.limit(0)).first()[:] == (0, 0, 0, "low")
    runs_ = spark.createDataFrame([("a", T0, "failed"), ("b", T0, "ok"), ("b", T0 + datetime.timedelta(1), "failed"), ("b", T0 + datetime.timedelta(9), "ok")], "source string, at timestamp, status string")
    got = {r.source: (r.last_success, r.failures_since) for r in audit.with_last_success(w, runs_, F.lit(T0 + datetime.timedelta(2))).collect()}
    assert got == {"a": (None, 1), "b": (T0, 1), "c": (None, 0), "d": (None, 0)}
    h = audit.health(status).first()
    assert (h.total_active_sources, h.failed_sources, h.availability_rate, h.fallback_used_count) == (4, 3, 0.25, 1) and h.failed_error_types == {"http_403": 1, "timeout": 2}
    assert audit.health(status.limit(0)).first().availability_rate == 0.0
    sources = spark.createDataFrame([("s1", "x", 1, False, 1), ("s2", "x", 5, False, 2), ("s3", "x", 5, False, 3), ("s4", "x", 2, False, 4), ("s5", "y", 9, True, 5)], "name string, category string, weight int, active boolean, ord int")
    advice = audit.recommendations(status, sources).collect()
    assert [(r.place, r.category, r.issue, r.source, r.backups) for r in advice] == [(1, "x", "trusted_source_coverage_low", None, ["s2", "s3", "s4"]), (2, "y", "trusted_source_coverage_low", None, []), (3, "x", "missing_fallback_url", "b", [])]


def test_reasons_tie_by_first_seen(spark):
    rows = [(2, "z, y,"), (1, "b"), (3, " z ,b"), (4, None), (5, "a")]
    got = audit.reject_reasons(spark.createDataFrame(rows, "ord int, reason string"), 3).collect()
    assert [(r.reason, r.n, r.place) for r in got] == [("b", 2, 1), ("z", 2, 2), ("y", 1, 3)]


def test_country_controls(spark):
    item = lambda t, d, x="": f"<item><title>{t}</title><pubDate>{d}</pubDate><description>{x}</description></item>"
    feed = "<rss><channel>" + item("UFO hearing", "Fri, 02 Feb 2024 03:00:00 GMT", "x " * 400 + "indictment") + item("ufo", "2024-02-02") + item(" ", "2024-02-02") + item("odd", "soon") + item("Scandal", "Fri, 02 Feb 2024 23:00:00 -0500") + "</channel></rss>"
    p = spark.createDataFrame([("us", "s", feed), ("fr", "t", None)], "country string, source string, payload string")
    e = country.country_entries(p, "America/New_York")
    assert sorted((r.title, str(r.d)) for r in e.collect()) == [("Scandal", "2024-02-02"), ("UFO hearing", "2024-02-01"), ("ufo", "2024-02-02")]
    panel = spark.createDataFrame([(datetime.date(2024, 2, 1),), (datetime.date(2024, 2, 3),)], "date date")
    w = country.grid_window(panel, F.lit("2024-02-02").cast("date"))
    out = country.country_controls(e, p, w, C.COUNTRY_UFO, C.COUNTRY_POLICY, C.COUNTRY_CRISIS).collect()
    assert len(out) == 6 and {(str(r.d), r.country): (r.ufo_policy_news, r.crisis_index) for r in out if r.ufo_policy_news + r.crisis_index} == {("2024-02-01", "us"): (1, 1), ("2024-02-02", "us"): (0, 1)}
    today = F.lit("2024-02-02").cast("date")
    assert [str(x) for x in country.grid_window(panel, today, 5).first()] == ["2024-01-28", "2024-02-02", "lookback_days=5"]
    assert [str(x) for x in country.grid_window(panel.limit(0), today).first()] == ["2014-02-04", "2024-02-02", "fallback_lookback_days=3650"]
    s = lambda *x: spark.createDataFrame([("c", "s", v) for v in x], "country string, source string, status string")
    why = lambda df, fetched=True: country.country_status(df, fetched).first()[2:]
    assert why(s("ok", "failed")) == ("partial_failed", "updated_with_partial_failures_zero_filled_grid") and why(s("failed"))[1] == "all_country_sources_failed_zero_filled_grid"
    assert why(s("ok"))[1] == "updated_zero_filled_full_date_grid" and why(s("ok"), False)[1] == "offline_zero_filled_grid" and why(s().limit(0)) == ("blocked", "no_active_country_sources")
