"""Queries on records against plain versions over the whole tables."""

import collections
import datetime

from conftest import SF
from pyspark.sql import functions as F

from tidemark import config as C
from tidemark.functions import text as T
from tidemark.plans import catalog, records, review
from tidemark.sources import views


def test_temporal_pairs_within_60_days_either_way(spark, monkeypatch):
    rows = views.table(spark, SF, "events").select("event_id", "ts", "event_type").collect()
    shift = lambda i: datetime.timedelta(i % 5 * 30)
    rows = [(r.event_id, r.ts + shift(r.event_id), r.event_type) for r in rows]
    moved = spark.createDataFrame(rows, "event_id long, ts timestamp, event_type string")
    monkeypatch.setattr(records.V, "table", lambda *a: moved)
    want = collections.defaultdict(lambda: [0, 0])
    for i, a, t in rows:
        for j, b, s in rows:
            gap = (b.date() - a.date()).days
            if t == "error" and s == "purchase" and abs(gap) <= 60:
                w = want[a.date(), gap]
                w[0] += 1
                w[1] += i % 97 * (j % 89)
    got = {(r.cd, r.gap): [r.n, r.checksum] for r in records.temporal_pairs(spark, SF).collect()}
    assert got == want and {g for _, g in got} >= {-60, 60}


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_items_are_scored_once(spark):
    """What draws, effects and sums read again is a table, not the texts' scoring."""
    assert "text#" not in plan_of(catalog.news_days(spark, SF))
    got = records.corroborated(spark, SF)
    assert "text#" not in plan_of(got) and "description" not in got.columns and "description" in records.corroborated(spark, SF, texts=True).columns


def test_keywords_are_looked_for_in_one_pass(spark):
    for name in ("keyword_hits", "tags_and_signatures"):
        plan = plan_of(records.QUERIES[name](spark, SF))
        assert "RLIKE(_text" not in plan and "RLIKE(txt" not in plan and plan.count("lower(concat_ws( ") == 1


def test_white_space_runs_become_one_space(spark):
    texts = ["a\u00a0b", "a \u2003\u00a0 b", "\u0085a", "a b", " a  b ", "a\t b", "a \n\n b", "a b", "a   b ", "\r\n", "", None, "a\x0b\x0c b  \tc"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    plain = F.trim(F.regexp_replace(F.coalesce("t", F.lit("")), r"(?U)\s+", " "))
    assert rows.where(T.normalize(F.col("t")) != plain).count() == 0


def test_signatures_equal_searches_keyword_by_keyword(spark):
    words = [*T.TAG_KEYWORDS, *T.CRISIS_SIGNS]
    texts = [f"{a} x{b} {c}y, {a}" for a, b, c in zip(words, words[7:] + words[:7], words[19:] + words[:19])]
    df = spark.createDataFrame([(t,) for t in [*texts, ""]], "t string").withColumn("f", T.found_keywords(F.col("t"), words))
    for pick in (C.ACTOR_KEYWORDS, C.CRISIS_TOPICS, C.OFFICIAL_ACTIONS + C.CRISIS_HARD_KEYWORDS):
        assert df.where(T.first_anchor(F.col("t"), pick) != T.first_found(F.col("f"), pick)).count() == 0
        assert df.where(T.longest_anchor(F.col("t"), pick) != T.longest_anchor(F.col("f"), pick, T.first_found)).count() == 0


def test_panels_are_tables(spark):
    for df in (views.panel(spark, SF), views.topics(spark, SF), views.country(spark, SF)):
        assert "o_orderdate" not in plan_of(df)


def test_mechanism_scores_items_once(spark, monkeypatch):
    runs = []
    plain = records.I.evaluate
    monkeypatch.setattr(records.I, "evaluate", lambda *a: runs.append(1) or plain(*a))
    got = review.mechanism_of(spark, SF)
    assert len(runs) == 1 and "text#" not in plan_of(got)
