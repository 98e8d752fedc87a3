"""Readers, sinks and small functions on a handful of rows each."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from tidemark import config
from tidemark.functions import stats, text
from tidemark.operators import catalogs, gates, items, order, shocks
from tidemark.plans import catalog
from tidemark.sources import readers, sinks

D = datetime.date


def values(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def one(spark, column, **row):
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} string" for k in row)).select(column.alias("x")).first()["x"]


def test_json_sources(spark, tmp_path):
    put = lambda name, x: ((tmp_path / name).write_text(json.dumps(x)), str(tmp_path / name))[1]
    events = put("e.json", {"events": [{"date": "2024-1-5", "label": "a", "category": "Law", "priority_score": 3.0}, {"date": "bad", "label": "b"}, {"date": "2024-02-01", "label": "c"}]})
    assert values(readers.exogenous(spark, events), "d", "category", "score") == [(D(2024, 1, 5), "law", 3.0), (D(2024, 2, 1), "unspecified", 1000.0)]
    assert values(readers.exogenous(spark, events, ["law"]), "label") == [("a",)]
    pairs = put("p.json", {"correlations": [{"crisis": {"date": "2024-03-01"}}, {"crisis": {"date": "2024-03-01"}}, {"crisis": {"date": "x"}}, {}]})
    assert values(readers.curated_dates(spark, pairs), "d") == [(D(2024, 3, 1),)]
    assert readers.json_rows(spark, str(tmp_path / "none.json"), "events", "date string").count() == 0
    sources = put("s.json", [{"name": "a", "active": True}, {"name": "b", "active": False}, {"name": "c"}])
    assert values(readers.source_list(spark, sources), "name") == [("a",), ("c",)]


def test_catalog_dates_fall_back(spark):
    c = spark.createDataFrame([("shock_dates", "2024-01-01"), ("wide", "2024-01-09"), ("wide", "x")], "catalog_key string, d string")
    assert values(readers.catalog_dates(c, "wide"), "d") == [(D(2024, 1, 9),)]
    assert values(readers.catalog_dates(c, "other"), "d") == [(D(2024, 1, 1),)]


def test_shock_ladder_takes_a_catalog_of_five(spark):
    series = spark.range(60).selectExpr("date_add(date'2024-01-01', cast(id AS int)) AS d", "id AS crisis")
    catalog = lambda n: spark.range(n).selectExpr("date_add(date'2024-01-03', cast(id AS int)) AS d")
    assert {r.source for r in shocks.shock_ladder(series, catalog(5)).collect()} == {"catalog"}
    assert {r.source for r in shocks.shock_ladder(series, catalog(4)).collect()} == {"p90"}


def test_reddit_and_urls(spark):
    payload = json.dumps({"data": {"children": [{"data": {"title": " A  b ", "url": "https://www.x.org/1", "selftext": "t", "created_utc": 86400.0}}, {"data": {"title": " ", "url": "u"}}]}})
    assert values(readers.reddit_items(spark.createDataFrame([(payload,)], "payload string")), "title", "date", "domain") == [("A b", D(1970, 1, 2), "x.org")]
    row = spark.createDataFrame([("u", "f", ["g", "u", None], "p{page}", 2, 4)], "url string, fallback_url string, fallback_urls array<string>, paged_url_template string, paged_start int, paged_end int")
    assert row.select(readers.retry_urls()).first()[0] == ["u", "f", "g", "p2", "p3", "p4"]
    assert row.select(readers.page_urls(F.lit("none"), F.lit(1), F.lit(3))).first()[0] == []


@pytest.mark.parametrize(("raw", "want"), [("Wed, 02 Oct 2002 13:00:00 GMT", D(2002, 10, 2)), ("2002-10-02T23:30:00-05:00", D(2002, 10, 3)), ("2002-10-02 and more", D(2002, 10, 2)), ("soon", None)])
def test_feed_dates(spark, raw, want):
    assert one(spark, F.to_date(readers.feed_timestamp(F.col("t"))), t=raw) == want


@pytest.mark.parametrize(("error", "want"), [("", "none"), ("SSL: certificate verify failed", "ssl_tls"), ("timed out", "timeout"), ("HTTP 403", "http_403"), ("404 not found", "http_404"), ("429", "http_429"), ("http error 503", "http_5xx"), ("xml parse", "parse_error"), ("odd", "other")])
def test_error_classes(spark, error, want):
    assert one(spark, text.error_class(F.col("e")), e=error) == want


def test_text_without_markup(spark):
    assert one(spark, text.strip_html(F.col("t")), t="<p>a &amp; b</p><script>x</script> c &lt;d&gt;") == "a & b c <d>"
    assert one(spark, text.domain_of(F.col("t")), t="https://WWW.Example.com:8080/a?b") == "example.com"
    found = text.found_keywords(F.col("t"), ["ufo", "area 51", "non-human", "ab"])
    assert one(spark, text.hits_of(found, ["non-human", "ufo", "ab", "area 51"]), t="the ufo at area 515, abc non-humans") == ["non-human", "ufo", "area 51"]
    assert one(spark, text.any_of(text.found_keywords(F.col("t"), ["ab"]), ["ab"]), t="cab abs") is False


def test_policies_and_confidence(spark):
    assert [config.policy(n).name for n in (" Lenient ", None, "odd", "strict-balanced")] == ["lenient", "strict", "strict", "strict-balanced"]
    df = spark.createDataFrame([(59,), (60,), (80,)], "final_score int")
    assert [items.at_least(df, k).count() for k in ("low", "MEDIUM", "high", "odd")] == [3, 2, 1, 2]


def test_gates_and_jobs(spark):
    g = spark.range(1).select(gates.gate_array({"panel_days": F.lit(True), "panel_x": F.lit(False), "none": F.lit(None).cast("boolean")}).alias("gates"))
    assert g.select(gates.gate("gates", "panel"), gates.gate("gates", "panel_x"), gates.gate("gates", "odd"), gates.all_passed()).first()[:] == (True, False, False, False)
    rows = spark.createDataFrame([(1, 0, 5), (0, 0, 0), (0, 2, 1), (0, 2, 0)], "code int, failed int, written int")
    assert [r[0] for r in rows.select(gates.job_status(F.col("code"), F.col("failed"), F.col("written"))).collect()] == ["failed", "full_success", "partial_success", "failed"]
    wait = spark.createDataFrame([(1, False), (4, False), (1, True), (30, False)], "n int, limited boolean").select(stats.retry_seconds(F.col("n"), F.col("limited"), 30, 60))
    assert [r[0] for r in wait.collect()] == [1.2, 9.6, 30.0, 60.0]


def test_replay_picks(spark):
    runs = spark.createDataFrame([(1, "a", 2), (2, "b", 0), (3, "c", 1), (4, "d", None)], "ord int, run_id string, failed_chunks int")
    assert values(catalogs.runs_for_replay(runs, 5), "run_id") == [("a",), ("c",)] and values(catalogs.runs_for_replay(runs, 0), "run_id") == [("c",)]
    assert values(catalogs.runs_for_replay(runs, run_id="b"), "run_id") == [("b",)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    sinks.write_json(df, str(tmp_path / "j"))
    sinks.write_csv(df, str(tmp_path / "c"))
    assert values(spark.read.schema("k int, v string").json(str(tmp_path / "j")), "k", "v") == [(1, "a"), (2, None)]
    assert values(spark.read.schema("k int, v string").option("header", True).csv(str(tmp_path / "c")), "k", "v") == [(1, "a"), (2, None)]
    for _ in range(2):
        sinks.append(df, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 4
    assert values(sinks.append_new(df, df.union(spark.createDataFrame([(3, "c")], df.schema)), ["k"]), "k") == [(1,), (2,), (3,)]


def test_lists_of_arguments():
    assert config.gap_list("45, 60,,x,-3, 1.5,45", 30) == [30, 45, 60] and config.gap_list(None, 0) == [] and config.gap_list("7", -1) == [7]
    assert config.category_filter(" Law, war ,law,") == {"law", "war"} and config.category_filter("") == set()
    assert config.selected_queries(" a, b,a", ["a", "b", "c"]) == ["a", "b"]
    for raw in ("", " , ", "a,z"):
        with pytest.raises(ValueError):
            config.selected_queries(raw, ["a", "b"])


def test_official_names_with_and_without_aggregators(spark):
    df = spark.createDataFrame([("Pentagon Releases",), ("Google News NASA",), ("BBC",), (None,)], "s string")
    assert [tuple(r) for r in df.select(text.is_official(F.col("s")), text.names_official(F.col("s"))).collect()] == [(True, True), (False, True), (False, False), (False, False)]


def test_order_over_all_rows(spark):
    df = spark.range(5000).selectExpr("id", "hash(id) % 50 AS v").repartition(7)
    got = {r.id: r.place for r in order.ranked(df, [F.col("v").desc(), F.col("id")]).collect()}
    assert got == {r.id: k + 1 for k, r in enumerate(sorted(df.collect(), key=lambda r: (-r.v, r.id)))}
    assert order.ranked(df.limit(0), [F.col("id")]).count() == 0


def test_scraped_windows_against_recorded_draws(spark):
    import random

    rng = random.Random(5)
    rows = [(D(2024, 1, 1) + datetime.timedelta(k), int(rng.random() < 0.2), rng.randrange(4)) for k in range(200)]
    dense = spark.createDataFrame(rows, "d date, crisis long, outcome long")
    got = {r.w: r for r in catalog.scraped_test(dense, 80, 7).collect()}
    y, days = {r[0]: r[2] for r in rows}, [r[0] for r in rows]
    hit = [r[0] for r in rows if r[1]]
    gen = random.Random(7)
    draws = [gen.sample(days, len(hit)) for _ in range(80)]
    for w, r in got.items():
        at = {d: sum(y.get(d + datetime.timedelta(k), 0) - y.get(d - datetime.timedelta(k), 0) for k in range(1, w + 1)) for d in days}
        mean = lambda x: sum(at[d] for d in x) / len(x)  # noqa: B023, E731
        assert r.sufficient and abs(r.effect - mean(hit)) < 1e-9
        assert r.p == sum(round(mean(x), 9) >= round(mean(hit), 9) for x in draws) / 80
    assert not catalog.scraped_test(dense.where("d < '2024-02-01'"), 80, 7).first().sufficient
