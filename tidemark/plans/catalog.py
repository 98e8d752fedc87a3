"""Queries on catalogs, replays, sources and scraped news, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import SEED, WINDOWS
from ..operators import catalogs as K
from ..operators import order as O
from ..operators import panel as P
from ..operators import permute as T
from ..operators import windows as WN
from ..sources import readers as R
from ..sources import views as V
from ..sources.shared import shared_table
from . import records
from .records import CORR_SQL
from .series import RANGES_SQL, _ranges

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
PERMUTATIONS = 20_000


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


SIGN_SQL = """e AS (SELECT DISTINCT o_custkey AS name, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders), s AS (SELECT name, CAST(count(*) AS INT) AS n_dates, sha256('{"dates":[' || string_agg('"' || d || '"', ',' ORDER BY d) || '],"name":"' || name || '"}') AS signature FROM e GROUP BY name)"""


def signed(spark: SparkSession, sf: str) -> DataFrame:
    return K.signatures(V.table(spark, sf, "orders").select(F.col("o_custkey").alias("name"), F.col("o_orderdate").alias("d")))


@query(f"WITH {SIGN_SQL} SELECT * FROM s")
def catalog_signatures(spark: SparkSession, sf: str) -> DataFrame:
    """A catalog of dates for each customer."""
    return signed(spark, sf)


@query(f"WITH {SIGN_SQL}, c AS (SELECT name, CASE WHEN name % 13 = 0 THEN '' ELSE signature END AS cs FROM s WHERE name % 11 <> 0), l AS (SELECT name, CASE WHEN name % 7 = 0 THEN NULL WHEN name % 5 = 0 THEN sha256('old') ELSE signature END AS ls FROM s WHERE name % 17 <> 0) SELECT coalesce(c.name, l.name) AS name, CASE WHEN c.name IS NULL THEN 'catalog_missing' WHEN l.name IS NULL THEN 'lock_missing' WHEN coalesce(cs, '') = '' THEN 'catalog_signature_missing' WHEN coalesce(ls, '') = '' THEN 'lock_signature_missing' WHEN cs <> ls THEN 'signature_mismatch' ELSE 'ok' END AS status FROM c FULL JOIN l ON c.name = l.name")
def catalog_lock(spark: SparkSession, sf: str) -> DataFrame:
    """Catalogs against locks of which some are missing, blank or old."""
    s, k = signed(spark, sf), F.col("name")
    catalog = s.where(k % 11 != 0).withColumn("signature", F.when(k % 13 == 0, "").otherwise(F.col("signature")))
    lock = s.where(k % 17 != 0).withColumn("signature", F.when(k % 7 == 0, F.lit(None)).when(k % 5 == 0, F.sha2(F.lit("old"), 256)).otherwise(F.col("signature")))
    return K.lock_status(catalog, lock)


@query("SELECT o_orderkey AS ord, CAST(o_orderkey AS VARCHAR) AS run_id FROM orders WHERE o_orderkey % 3 > 0 ORDER BY o_orderkey DESC LIMIT 25")
def replay_runs(spark: SparkSession, sf: str) -> DataFrame:
    runs = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("ord"), F.col("o_orderkey").cast("string").alias("run_id"), (F.col("o_orderkey") % 3).alias("failed_chunks"))
    return K.runs_for_replay(runs, 25).select("ord", "run_id")


TAG_SQL = f"{RANGES_SQL}, tg AS (SELECT q % 20 AS query, a, b, CASE q % 3 WHEN 0 THEN 'raw' WHEN 1 THEN 'volume' ELSE 'news' END AS source, q AS ord FROM rng), ds AS (SELECT query, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS d, source, ord FROM tg), dd AS (SELECT query, d, arg_max(source, ord) AS source FROM ds GROUP BY query, d)"


def tagged(spark: SparkSession, sf: str) -> DataFrame:
    q = F.col("query")
    return _ranges(spark, sf).select((q % 20).alias("query"), "start", "end", F.when(q % 3 == 0, "raw").when(q % 3 == 1, "volume").otherwise("news").alias("source"), q.alias("ord"))


@query(f"WITH {TAG_SQL} SELECT query, d, source FROM dd")
def day_sources(spark: SparkSession, sf: str) -> DataFrame:
    return K.day_sources(tagged(spark, sf))


@query(f"WITH {TAG_SQL} SELECT query, source, count(*) AS days FROM dd GROUP BY query, source")
def source_modes(spark: SparkSession, sf: str) -> DataFrame:
    return K.source_modes(K.day_sources(tagged(spark, sf)))


@query(f"WITH {RANGES_SQL} SELECT q AS query, strftime(a, '%Y%m%d') || '000000' AS first, strftime(b, '%Y%m%d') || '235959' AS last FROM rng")
def timeline_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return _ranges(spark, sf).select("query", K.timeline_bounds(F.col("start"), F.col("end")).alias("x")).select("query", "x.*")


@query(f"WITH {CORR_SQL} SELECT ord, category, row_number() OVER (PARTITION BY category, date ORDER BY final_score DESC, published_at IS NOT NULL DESC, weight DESC, ord) AS place FROM corr")
def news_order(spark: SparkSession, sf: str) -> DataFrame:
    """Places within each category's day: days follow one another, so no category is one task."""
    return records.corroborated(spark, sf).select("ord", "category", F.row_number().over(W.partitionBy("category", "date").orderBy(*K.news_order())).alias("place"))


@query(f"WITH {CORR_SQL} SELECT ord, category, row_number() OVER (PARTITION BY category ORDER BY coalesce(CAST(date AS VARCHAR), '') DESC, final_score DESC, published_at IS NOT NULL DESC, weight DESC, ord) AS place FROM corr")
def news_ranking(spark: SparkSession, sf: str) -> DataFrame:
    """Places within each category, over all days."""
    slim = shared_table(records.corroborated(spark, sf).select("ord", "category", "date", "final_score", "published_at", "weight"), "news")
    ufo, crisis = (O.ranked(slim.where(F.col("category") == c), K.news_order()) for c in ("ufo", "crisis"))
    return ufo.unionByName(crisis).select("ord", "category", "place")


def feeds(spark: SparkSession, sf: str) -> DataFrame:
    """A feed for each page, every third as Atom, with one entry without a title and two with dates."""
    i = F.col("page_id")
    n = i.cast("string")
    d = lambda k: F.lpad((1 + (i + k) % 28).cast("string"), 2, "0")
    rss = F.concat(F.lit("<rss><channel>"), *[x for k in (0, 3) for x in (F.lit("<item><title>"), n, F.lit(f" no {k}</title><link>http://a.b/x</link><pubDate>Wed, "), d(k), F.lit(" Oct 2002 13:00:00 GMT</pubDate></item>"))], F.lit("<item><title> </title></item></channel></rss>"))
    atom = F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom">'), *[x for k in (0, 3) for x in (F.lit("<entry><title>"), n, F.lit(f' no {k}</title><link href="http://a.b/x"/><updated>2002-10-'), d(k), F.lit("T13:00:00Z</updated></entry>"))], F.lit('<entry><title> </title><link href="http://a.b/y"/></entry></feed>'))
    return V.table(spark, sf, "pages").select("page_id", F.when(i % 3 == 0, atom).otherwise(rss).alias("payload"))


@query("SELECT page_id, page_id || ' no ' || k AS title, make_date(2002, 10, CAST(1 + (page_id + k) % 28 AS INT)) AS date, 'http://a.b/x' AS url FROM pages, (VALUES (0), (3)) AS v(k)")
def feed_forms(spark: SparkSession, sf: str) -> DataFrame:
    """RSS and Atom alike."""
    return R.feed_items(feeds(spark, sf)).select("page_id", "title", "date", "url")


@query("SELECT make_date(2002, 10, CAST(1 + (page_id + k) % 28 AS INT)) AS date, count(*) AS n FROM pages, (VALUES (0), (3)) AS v(k) WHERE 1 + (page_id + k) % 28 BETWEEN 5 AND 20 GROUP BY 1")
def news_day_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Entries a day, inside a range."""
    return R.feed_items(feeds(spark, sf)).where(F.col("date").between("2002-10-05", "2002-10-20")).groupBy("date").agg(F.count("*").alias("n"))


def news_days(spark: SparkSession, sf: str) -> DataFrame:
    """``d, crisis, outcome``: accepted news a day, every day from the first to the last. A table, as effects and draws read it again and again and items are scored for it."""
    n = records.corroborated(spark, sf).groupBy(F.col("date").alias("d")).agg(F.count_if(F.col("category") == "crisis").alias("crisis"), F.count_if(F.col("category") == "ufo").alias("outcome")).where("d IS NOT NULL")
    return P.densify(shared_table(n, "news-days"))


NEWS_SQL = f"""{CORR_SQL}, nd AS (SELECT date AS d, count(*) FILTER (category = 'crisis') AS crisis, count(*) FILTER (category = 'ufo') AS outcome FROM corr WHERE date IS NOT NULL GROUP BY 1), gd AS (SELECT CAST(unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS DATE) AS d FROM nd), dn AS (SELECT gd.d, coalesce(crisis, 0) AS crisis, coalesce(outcome, 0) AS outcome FROM gd LEFT JOIN nd ON nd.d = gd.d),
ne AS (SELECT d, crisis, outcome, {', '.join(f"coalesce(sum({v}) OVER (ORDER BY d ROWS BETWEEN 1 FOLLOWING AND {w} FOLLOWING), 0) - coalesce(sum({v}) OVER (ORDER BY d ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING), 0) AS {n}{w}" for n, v in (('f', 'outcome'), ('b', 'crisis')) for w in WINDOWS)} FROM dn)"""


def both_ways(dense: DataFrame) -> DataFrame:
    ahead = WN.window_effect(dense, dense.where("crisis > 0"), "outcome", WINDOWS).select("w", "effect")
    return ahead.join(WN.window_effect(dense, dense.where("outcome > 0"), "crisis", WINDOWS).select("w", F.col("effect").alias("reverse")), "w")


@query(f"WITH {NEWS_SQL} " + " UNION ALL ".join(f"SELECT {w} AS w, round(coalesce((SELECT avg(f{w}) FROM ne WHERE crisis > 0), 0), 6) AS effect, round(coalesce((SELECT avg(b{w}) FROM ne WHERE outcome > 0), 0), 6) AS reverse FROM (SELECT 1)" for w in WINDOWS))
def scraped_window_effects(spark: SparkSession, sf: str) -> DataFrame:
    return both_ways(news_days(spark, sf)).select("w", F.round("effect", 6).alias("effect"), F.round("reverse", 6).alias("reverse"))


def scraped_test(dense: DataFrame, draws: int, seed: int = SEED, lookback: int = 120) -> DataFrame:
    """``w, effect, reverse, p, sufficient``: effects of days with crises on the outcome, against drawn days; p is null for too few reports (10 and 30) or too short a span."""
    s = dense.agg(F.sum("crisis").alias("c"), F.sum("outcome").alias("o"), F.count("*").alias("n"), F.count_if(F.col("crisis") > 0).alias("days")).first()
    enough = (s["c"] or 0) >= 10 and (s["o"] or 0) >= 30 and s["n"] >= min(180, max(30, lookback))
    wide = WN.sum_effects(dense, "outcome", WINDOWS)
    out = both_ways(dense)
    seen = {f"e{r['w']}": r["effect"] for r in out.collect()}  # a row per window
    tested = T.p_of(T.null_table(wide, list(seen), dense, s["days"] if enough else 0, draws, seed), seen).select(F.substring("name", 2, 9).cast("int").alias("w"), F.when(F.lit(enough), F.coalesce("p", F.lit(1.0))).alias("p"))
    return out.join(F.broadcast(tested), "w").withColumn("sufficient", F.lit(enough))  # a row per window


@query()
def scraped_window_test(spark: SparkSession, sf: str) -> DataFrame:
    return scraped_test(news_days(spark, sf), PERMUTATIONS)
