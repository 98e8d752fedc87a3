"""Queries on scans of ranges and pages, with their SQL. The sources' answers come from the tables; what they refuse follows a rule."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import paged as PG
from ..sources import ranges as RG
from ..sources import views as V
from ..sources.views import PANEL_SQL

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


PLAN = RG.ScanPlan(fallback="news_rss", fallback_days=14, chunk_days=700, min_split_days=60, retries=1)
SERIES = ("crisis", "outcome")


def refusing_source(spark: SparkSession, sf: str) -> tuple[RG.Fetch, DataFrame]:
    """A source of the panel's daily counts, and the ranges to ask it for.

    The first mode refuses answers of over 40 mean days, the second ranges that begin on a day of the year that 5
    doesn't divide, the fallback those that end on one that 3 divides. Counts come by day: a row a day is shipped.
    """
    rows = V.panel(spark, sf).select("d", *SERIES).collect()  # a row a day
    counts = {q: {r["d"]: r[q] for r in rows} for q in SERIES}
    most = {q: 40 * (sum(c.values()) // max(1, len(c))) for q, c in counts.items()}

    def fetch(query: str, mode: str, start: date, end: date) -> dict[date, int]:
        got = {d: n for d, n in counts[query].items() if start <= d <= end and n > 0}
        day = lambda d: d.timetuple().tm_yday
        if mode == "timeline_volraw" and sum(got.values()) > most[query]:
            raise ValueError("too large")
        if mode == "timeline_vol" and day(start) % 5:
            raise RG.Limited("too many requests")
        if mode == "news_rss" and day(end) % 3 == 0:
            raise ValueError("no feed")
        return got

    lo, hi = (min(r["d"] for r in rows), max(r["d"] for r in rows)) if rows else (None, None)
    return fetch, spark.createDataFrame([(q, lo, hi) for q in SERIES if rows], "query string, start date, end date")


CUM_SQL = f"""{PANEL_SQL}, q AS ({' UNION ALL '.join(f"SELECT '{q}' AS query, d, {q} AS n FROM panel" for q in SERIES)}),
lim AS (SELECT query, 40 * (sum(n) // count(*)) AS most, min(d) AS lo, max(d) AS hi FROM q GROUP BY query),
g AS (SELECT query, CAST(unnest(generate_series(lo - 1, hi, INTERVAL 1 DAY)) AS DATE) AS d FROM lim),
cum AS (SELECT g.query, g.d, sum(coalesce(n, 0)) OVER (PARTITION BY g.query ORDER BY g.d) AS c FROM g LEFT JOIN q ON q.query = g.query AND q.d = g.d),
a AS (SELECT query, lo + CAST(700 * k AS INT) AS s, least(hi, lo + CAST(700 * k + 699 AS INT)) AS e FROM lim, range(0, 100) AS r(k) WHERE lo + CAST(700 * k AS INT) <= hi)"""


def _asked(frm: str) -> str:
    return f"""SELECT x.query, x.s, x.e, CASE WHEN ce.c - cs.c <= lim.most THEN 'timeline_volraw' WHEN dayofyear(x.s) % 5 = 0 THEN 'timeline_vol' WHEN x.e - x.s < 14 AND dayofyear(x.e) % 3 <> 0 THEN 'news_rss' END AS source FROM {frm} AS x JOIN lim ON lim.query = x.query JOIN cum ce ON ce.query = x.query AND ce.d = x.e JOIN cum cs ON cs.query = x.query AND cs.d = x.s - 1"""


SCAN_SQL = f"""{CUM_SQL},
r AS ({_asked('a')} UNION ALL {_asked("(SELECT query, CASE h WHEN 0 THEN s ELSE s + CAST((e - s + 1) // 2 AS INT) END AS s, CASE h WHEN 0 THEN s + CAST((e - s + 1) // 2 - 1 AS INT) ELSE e END AS e FROM r, (VALUES (0), (1)) AS v(h) WHERE source IS NULL AND e - s + 1 > 14)")}),
f AS (SELECT * FROM r WHERE source IS NOT NULL OR e - s + 1 <= 14)"""
SAID = "'timeline_volraw: attempt=1: too large | timeline_vol: attempt=1: too many requests' || CASE WHEN e - s < 14 THEN ' | news_rss: attempt=1: no feed' ELSE '' END"


@query(f"""WITH RECURSIVE {SCAN_SQL}
SELECT f.query, 'count' AS kind, q.d, CAST(NULL AS DATE) AS until, source, CAST(q.n AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS error FROM f JOIN q ON q.query = f.query AND q.d BETWEEN s AND e WHERE source IS NOT NULL AND n > 0
UNION ALL SELECT f.query, 'covered', g.d, NULL, source, NULL, NULL FROM f JOIN g ON g.query = f.query AND g.d BETWEEN s AND e WHERE source IS NOT NULL
UNION ALL SELECT query, 'failed', s, e, NULL, NULL, {SAID} FROM f WHERE source IS NULL""")
def range_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Both series' counts, the days that answers covered, and what was given up."""
    fetch, ranges = refusing_source(spark, sf)
    return RG.scan(spark, ranges, fetch, PLAN)


@query(f"WITH RECURSIVE {SCAN_SQL}, c AS (SELECT query, count(*) FILTER (source IS NULL) AS failed_ranges, CAST(coalesce(sum(e - s + 1) FILTER (source IS NULL), 0) AS BIGINT) AS failed_days, CAST(coalesce(sum(e - s + 1) FILTER (source IS NOT NULL), 0) AS BIGINT) AS covered_days FROM f GROUP BY query) SELECT *, CASE WHEN failed_ranges = 0 THEN 'full_success' WHEN covered_days > 0 THEN 'partial_success' ELSE 'failed' END AS status FROM c")
def range_scan_status(spark: SparkSession, sf: str) -> DataFrame:
    fetch, ranges = refusing_source(spark, sf)
    s = RG.scan(spark, ranges, fetch, PLAN)
    bad = F.col("kind") == "failed"
    return s.groupBy("query").agg(F.count_if(bad).alias("failed_ranges"), F.coalesce(F.sum(F.when(bad, F.datediff("until", "d") + 1)), F.lit(0)).alias("failed_days"), F.count_if(F.col("kind") == "covered").alias("covered_days"), RG.status_of(s).alias("status"))


#: Documents that make a source, and an answered page of it.
OF_SOURCE, OF_PAGE = 200, 10


def paged_tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Pages and entries of sources made from runs of documents: each comes back to its first URLs after a while; some entries have no URL, some pages fail."""
    i = F.col("doc_id")
    s, j = F.floor(i / OF_SOURCE), i % OF_SOURCE
    entries = V.table(spark, sf, "documents").select(
        s.alias("source"), F.floor(j / OF_PAGE).alias("page"), i.alias("ord"),
        F.when(i % 5 != 0, F.concat(F.lit("https://a.example.com/"), (j % (40 + 10 * (s % 7))).cast("string"))).alias("url"),
        F.concat(F.lit(" Title  No "), (j % 16).cast("string")).alias("title"), F.date_add(F.lit("2024-01-01").cast("date"), (i % 3).cast("int")).alias("date"),
    )
    failed = (F.col("page") * 3 + F.col("source")) % 11 == 5
    return entries.select("source", "page").distinct().withColumn("failed", failed), entries


PAGED_SQL = f"""en AS (SELECT doc_id // {OF_SOURCE} AS source, doc_id % {OF_SOURCE} // {OF_PAGE} AS page, doc_id AS ord, CASE WHEN doc_id % 5 <> 0 THEN 'https://a.example.com/' || ((doc_id % {OF_SOURCE}) % (40 + 10 * (doc_id // {OF_SOURCE} % 7))) END AS url, ' Title  No ' || (doc_id % {OF_SOURCE} % 16) AS title, DATE '2024-01-01' + CAST(doc_id % 3 AS INT) AS date FROM documents),
pg AS (SELECT DISTINCT source, page, (page * 3 + source) % 11 = 5 AS failed FROM en),
fi AS (SELECT source, coalesce(url, title || date) AS k, min((page, ord)) AS f FROM en SEMI JOIN (SELECT * FROM pg WHERE NOT failed) p USING (source, page) GROUP BY 1, 2),
nf AS (SELECT source, f[1] AS page, count(*) AS n FROM fi GROUP BY ALL),
nw AS (SELECT pg.source, pg.page, pg.failed, CASE WHEN NOT failed THEN coalesce(n, 0) END AS n_new FROM pg LEFT JOIN nf ON nf.source = pg.source AND nf.page = pg.page),
rn AS (SELECT source, page, sum(n_new) OVER w AS run, count(*) OVER w AS c FROM nw WHERE NOT failed WINDOW w AS (PARTITION BY source ORDER BY page ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)),
st AS (SELECT source, min(page) AS stop FROM rn WHERE run = 0 AND c = 2 GROUP BY source),
ps AS (SELECT nw.*, coalesce(nw.page <= stop, true) AS asked FROM nw LEFT JOIN st ON st.source = nw.source)"""


@query(f"WITH {PAGED_SQL} SELECT en.* FROM en JOIN fi ON fi.source = en.source AND fi.f = (en.page, en.ord) JOIN ps ON ps.source = en.source AND ps.page = en.page WHERE asked")
def paged_merge(spark: SparkSession, sf: str) -> DataFrame:
    return PG.merge_pages(*paged_tables(spark, sf))


@query(f"WITH {PAGED_SQL} SELECT source, CAST(coalesce(sum(n_new), 0) AS BIGINT) AS entries, count(*) AS pages_asked, max(page) FILTER (NOT failed) AS last_page, CASE WHEN coalesce(sum(n_new), 0) = 0 THEN 'paged_fetch_failed' END AS error FROM ps WHERE asked GROUP BY source")
def paged_sources(spark: SparkSession, sf: str) -> DataFrame:
    return PG.paged_result(PG.paged_status(*paged_tables(spark, sf)))
