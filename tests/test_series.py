"""Queries on daily series against plain versions over the whole tables."""

import datetime
import math
import random

from conftest import SF

from tidemark.operators import permute
from tidemark.plans import series
from tidemark.sources import views


def test_synth_uses_every_shock_day(spark):
    shocks = {r.d for r in series.shocks_of(spark, SF).collect()}
    assert len(shocks) > 20
    units = {}
    for r in views.country(spark, SF).collect():
        units.setdefault(r.unit, {})[r.d] = r.v
    treated = units.pop(0)
    post = {d for d in treated if any(d - datetime.timedelta(k) in shocks for k in range(1, 8))}
    pre = treated.keys() - post - shocks
    errors = {u: [(treated[d] - v[d]) ** 2 for d in pre if d in v] for u, v in units.items()}
    mse = {u: sum(e) / len(e) if e else 1e6 for u, e in errors.items()}
    total = sum(1 / (m + 1e-6) for m in mse.values())
    weight = {u: 1 / (m + 1e-6) / total for u, m in mse.items()}
    gap = {}
    for d, y in treated.items():
        on = [u for u, v in units.items() if d in v]
        if on:
            gap[d] = y - sum(weight[u] * units[u][d] for u in on) / sum(weight[u] for u in on)
    mean = lambda days: sum(gap[d] for d in days if d in gap) / sum(d in gap for d in days)
    near = lambda a, b: math.isclose(a, b, abs_tol=2e-6)
    got = series.synth_weights(spark, SF).collect()
    assert {r.unit for r in got} == units.keys() and all(near(r.mse, mse[r.unit]) and near(r.weight, weight[r.unit]) for r in got)
    got = {r.d: r.gap for r in series.synth_gap(spark, SF).collect()}
    assert got.keys() == gap.keys() and all(near(got[d], gap[d]) for d in gap)
    r = series.synth_att(spark, SF).first()
    assert (r.n_pre, r.n_post) == (sum(d in gap for d in pre), sum(d in gap for d in post))
    assert near(r.gap_pre, mean(pre)) and near(r.gap_post, mean(post)) and near(r.att, mean(post) - mean(pre))


def drawn(pool, m, draws, seed):
    rng = random.Random(seed)
    return [rng.sample(sorted(pool), m) for _ in range(draws)] if 0 < m <= len(pool) else []


def test_window_permutation_has_every_window_and_draw(spark, monkeypatch):
    assert series.PERMUTATIONS == 20_000
    monkeypatch.setattr(series, "PERMUTATIONS", 60)
    shocks = {r.d for r in series.shocks_of(spark, SF).collect()}
    adj = {r.d: r.adj for r in views.dense(spark, SF).collect()}
    got = {r.w: r for r in series.window_effect_permutation(spark, SF).collect()}
    assert sorted(got) == [3, 7, 10, 14, 30]
    draws = drawn(adj, len(shocks), 60, series.SEED)
    for w, r in got.items():
        at = {d: sum(adj.get(d + datetime.timedelta(k), 0) - adj.get(d - datetime.timedelta(k), 0) for k in range(1, w + 1)) for d in adj}
        mean = lambda days: sum(at[d] for d in days) / len(days)  # noqa: B023, E731
        assert math.isclose(r.effect, mean(shocks), abs_tol=2e-6) and r.draws == 60
        assert math.isclose(r.p, sum(round(mean(x), 9) >= round(mean(shocks), 9) for x in draws) / 60)


def test_did_placebo_has_every_window(spark, monkeypatch):
    assert series.PLACEBOS == 2_000
    monkeypatch.setattr(series, "PLACEBOS", 60)
    shocks = {r.d for r in series.shocks_of(spark, SF).collect()}
    y = {r.d: r.outcome for r in views.panel(spark, SF).collect()}
    got = {r.w: r for r in series.did_placebo(spark, SF).collect()}
    assert sorted(got) == [7, 14, 30]
    for w, r in got.items():
        at = {}
        for d in y:
            a, b = ([y[x] for k in range(1, w + 1) if (x := d + datetime.timedelta(s * k)) in y] for s in (1, -1))
            if min(len(a), len(b)) >= max(3, w // 3):
                at[d] = sum(a) / len(a) - sum(b) / len(b)
        mean = lambda days: sum(at[d] for d in days) / len(days)  # noqa: B023, E731
        hit = [d for d in shocks if d in at]
        pool = [d for d in at if all(abs((d - s).days) > 7 for s in shocks)]
        enough = len(hit) >= max(3, len(shocks) // 2)
        null = [mean(x) for x in drawn(pool, len(hit), 60, series.SEED + w)] if enough else []
        assert r.draws == len(null)
        assert not enough and r.att is None or math.isclose(r.att, mean(hit), abs_tol=2e-6)
        assert not null and r.p is None or math.isclose(r.p, sum(round(x, 9) >= round(mean(hit), 9) for x in null) / 60)


def test_placebo_samples_are_as_many_as_the_shocks(spark, monkeypatch):
    asked = []
    plain = permute.null_table
    monkeypatch.setattr(permute, "null_table", lambda days, cols, pool, size, draws, seed, peak=None: (asked.append((size, draws)), plain(days, cols, pool, size, draws, seed, peak))[1])
    n = series.shocks_of(spark, SF).count()
    r = series.event_study_peak(spark, SF).first()
    assert asked == [(n, 2_000)] and r.draws in (0, 2_000) and (r.draws or r.p == 1)


def test_too_small_a_pool_gives_no_draws(spark):
    pool = spark.range(5).selectExpr("date_add(date'2024-01-01', cast(id AS int)) AS d", "2.0D AS x")
    assert permute.hash_draws(pool, 6, 3, 1).count() == 0 and permute.hash_draws(pool, 5, 3, 1).count() == 15
    assert permute.null_table(pool, ["x"], pool, 6, 3, 1).count() == 0
    assert [r.peak for r in permute.null_table(pool, ["x"], pool, 5, 3, 1, peak=6).collect()] == [2.0] * 3
