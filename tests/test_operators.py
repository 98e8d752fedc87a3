import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark.config import STRICT_BALANCED
from tidemark.functions import stats
from tidemark.functions import text as T
from tidemark.functions.once import once
from tidemark.operators import items as I
from tidemark.operators import permute
from tidemark.sources import readers, sinks
from tidemark.streaming import daily

DAY = datetime.date(2024, 1, 1)


def days(spark, values):
    return spark.createDataFrame([(DAY + datetime.timedelta(k), v) for k, v in values.items()], "d date, v long")


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("HTTPS://WWW.Example.com/a/?utm_source=x&b=1#top", "https://example.com/a?b=1"),
        ("https://example.com", "https://example.com/"),
        ("not a url", "not a url"),
        (None, ""),
    ],
)
def test_canonical_url(spark, url, want):
    assert one(spark, T.canonical_url(F.col("u").cast("string")), u=url) == want


@pytest.mark.parametrize(("url", "want"), [("/x/2024/2/29/y", "2024-02-29"), ("/x/2023/2/29/y", None), ("/2024-05-06-title", "2024-05-06"), ("https://a.b/?date=2020-1-2", "2020-01-02"), ("/none", None)])
def test_date_from_url(spark, url, want):
    got = one(spark, T.date_from_url(F.col("u")), u=url)
    assert (str(got) if got else None) == want


def test_keywords_match_whole_words(spark):
    hit = lambda text, k: one(spark, T.has_keyword(F.col("t"), k), t=text)
    assert hit("an uap report", "uap") and not hit("uaps", "uap") and hit("the ufo files leak", "ufo files")


def test_once_keeps_rows_and_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, "a"), (2, "a")], "a long, b string")
    assert sorted(once(df).collect(), key=str) == sorted(df.collect(), key=str)


def test_percentiles_and_thresholds(spark):
    df = days(spark, {0: 0, 1: 1, 2: 2, 3: 10})
    r = df.agg(stats.percentile(F.col("v"), 0.5).alias("p"), stats.shock_threshold(F.col("v"), 0.5).alias("t")).first()
    assert (r.p, r.t) == (1.5, 2.0)
    assert df.limit(0).agg(stats.percentile(F.col("v"), 0.5).alias("p"), stats.shock_threshold(F.col("v")).alias("t")).first()[:] == (0.0, 2.0)


def test_binomial_tail():
    assert stats.binomial_right_tail(10, 10, 0.5) == 0.0009765625
    assert stats.binomial_right_tail(0, 0, 0.5) == 1.0


def test_exact_draws_are_those_of_the_generator(spark):
    rng = random.Random(11)
    want = [(k, p) for k in range(3) for p in rng.sample(range(20), 4)]
    assert [tuple(r) for r in permute.exact_draws(spark, 20, 4, 3, 11).collect()] == want


def test_hash_draws_have_no_repeats(spark):
    rows = permute.hash_draws(days(spark, dict.fromkeys(range(30), 1)), 7, 5, 3).groupBy("draw").agg(F.count("*").alias("n"), F.count_distinct("d").alias("u")).collect()
    assert [(r.n, r.u) for r in rows] == [(7, 7)] * 5


def test_placebo_pool(spark):
    pool = permute.placebo_pool(days(spark, dict.fromkeys(range(20), 1)), days(spark, {10: 1}), 3)
    assert {(r.d - DAY).days for r in pool.collect()} == {*range(7), *range(14, 20)}


def test_dedupe_order(spark):
    rows = [(0, "s", "u1", "Title", DAY), (1, "s", "u1", "Other", DAY), (2, "s", "u2", "title", DAY), (3, "t", "u1", "Title", DAY), (4, "s", "", "Alone", None)]
    got = I.dedupe(spark.createDataFrame(rows, "ord long, source string, url string, title string, date date"))
    assert {r.ord: r.duplicate for r in got.collect()} == {0: None, 1: "url", 2: "title", 3: None, 4: None}


def test_evaluate_of_nothing(spark):
    df = spark.createDataFrame([], "ord long, source string, source_type string, category string, weight int, title string, description string, date date, date_parsed_ok boolean, published_at timestamp, url string, domain string")
    assert I.evaluate(df, STRICT_BALANCED, F.lit("2024-04-15").cast("date")).count() == 0


def test_upsert_and_append(spark):
    old, new = days(spark, {0: 1, 1: 2}), days(spark, {1: 5, 2: 6})
    value = lambda df: {(r.d - DAY).days: r.v for r in df.collect()}
    assert value(sinks.upsert(old, new, ["d"])) == {0: 1, 1: 5, 2: 6}
    assert value(sinks.append_new(old, new, ["d"])) == {0: 1, 1: 2, 2: 6}


def test_json_and_csv_sources(spark, tmp_path):
    (tmp_path / "pairs.json").write_text(json.dumps({"correlations": [{"crisis": {"date": "2024-1-5"}}, {"crisis": {"date": "bad"}}]}))
    assert [str(r.d) for r in readers.curated_dates(spark, str(tmp_path / "pairs.json")).collect()] == ["2024-01-05"]
    (tmp_path / "t.csv").write_text("date,topic,count\n2024-01-01,a,3\n2024-01-01,a,4\nbad,a,1\n2024-01-02,b,x\n2024-01-03,b,\n")
    assert {(str(r.d), r.topic, r["count"]) for r in readers.counts_csv(spark, str(tmp_path / "t.csv"), "topic").collect()} == {("2024-01-01", "a", 4.0), ("2024-01-03", "b", 0.0)}
    assert readers.json_rows(spark, str(tmp_path / "none.json"), "events", "date string").count() == 0


def test_timeline_payloads(spark):
    body = json.dumps({"timeline": [{"data": [{"date": "20240102T000000Z", "value": 3.7}, {"date": "20240103T000000Z", "norm": 2}, {"date": "bad", "value": 1}]}]})
    got = readers.timeline_counts(spark.createDataFrame([("q", body)], "query string, payload string")).collect()
    assert {(r.query, str(r.d), r.n) for r in got} == {("q", "2024-01-02", 3), ("q", "2024-01-03", 2)}


def test_daily_stream(spark, tmp_path):
    rows = [(1, "2024-01-01 01:00:00", "error"), (1, "2024-01-01 01:00:00", "error"), (2, "2024-01-01 05:00:00", "purchase"), (3, "2024-01-02 05:00:00", "view")]
    df = spark.createDataFrame(rows, "event_id long, ts string, event_type string").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = daily.upsert_stream(daily.daily_stream(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert q.awaitTermination(120)
    want = {("2024-01-01", 1, 1, 0), ("2024-01-02", 0, 0, 1)}
    counts = lambda: {(str(r.d), r.crisis, r.outcome, r.control) for r in daily.read_days(spark, str(tmp_path / "out")).collect()}
    assert counts() == want
    # a second run of the stream rewrites its own months only, and the first run's rows of other days stay
    more = spark.createDataFrame([(4, "2024-02-03 01:00:00", "error"), (5, "2024-01-02 09:00:00", "purchase")], "event_id long, ts string, event_type string").withColumn("ts", F.to_timestamp("ts"))
    more.write.mode("append").parquet(str(tmp_path / "in"))
    assert daily.upsert_stream(daily.daily_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert counts() == {("2024-01-01", 1, 1, 0), ("2024-01-02", 0, 1, 1), ("2024-02-03", 1, 0, 0)}


def test_upsert_of_days_touches_their_months_only(spark, tmp_path):
    path = str(tmp_path / "panel")
    row = lambda d, n: spark.createDataFrame([(datetime.date.fromisoformat(d), n)], "d date, n long")
    for d, n in (("2024-01-01", 1), ("2024-01-20", 2), ("2024-03-01", 3)):
        daily.upsert_days(row(d, n), path)
    january = lambda: sorted(p.name for p in (tmp_path / "panel" / "month=2024-01-01").iterdir())
    before = january()
    daily.upsert_days(row("2024-03-01", 9), path)
    daily.upsert_days(row("2024-03-01", 9).limit(0), path)
    assert january() == before and not [p for p in tmp_path.iterdir() if "-new-" in p.name]
    daily.upsert_days(row("2024-01-20", 5), path)
    daily.upsert_days(row("2024-01-20", 5), path)
    assert {(str(r.d), r.n) for r in daily.read_days(spark, path).collect()} == {("2024-01-01", 1), ("2024-01-20", 5), ("2024-03-01", 9)}
