"""The domain's tables on the driver's Parquet tables, in Spark and, for the checks, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.panel import adjusted, daily, densify
from .shared import shared_table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders_panel(orders: DataFrame) -> DataFrame:
    p = F.col("o_orderpriority")
    return daily(orders, F.col("o_orderdate"), crisis=p.isin("1-URGENT", "3-MEDIUM"), outcome=p.isin("2-HIGH", "4-NOT SPECIFIED"), control=p == "5-LOW")


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a day, as a table: the models read it dozens of times, and orders only once for it."""
    return shared_table(orders_panel(table(spark, sf_dir, "orders")), "panel")


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adjusted(densify(panel(spark, sf_dir)))


HEADLINES = [
    "Senate committee schedules UAP hearing with Pentagon officials",
    "White House orders agencies to declassify UFO files this year",
    "Navy pilots describe UFO encounter off the coast in testimony",
    "NASA report on unidentified anomalous phenomena released today",
    "Recovered materials and reverse engineering claims resurface",
    "Documentary about an alien movie tops the streaming charts",
    "AARO briefing to Congress covers unidentified aerial reports",
    "Illegal alien crossings at the border fall, homeland security says",
    "Grand jury indictment names former president aide in bribery case",
    "Supreme Court ruling blocked executive order on tariffs",
    "Opinion: the scandal in the White House will pass",
    "Special counsel subpoena reaches Congress over classified documents",
    "Mayor resigns; and corruption investigation widens, and more",
    "Federal charges filed as FBI closes money laundering investigation",
    "Weather: hurricane and flood warnings across the coast",
    "SHOCK!!! YOU WILL NOT BELIEVE",
]
SOURCES = ["White House Briefing", "Google News UFO", "Reuters Wire", "r/UFOs", "Pentagon Releases", "BBC News", "Local Blog"]


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """News items on ``documents``: headline, source, dates and URL by rule from doc_id, the text as description."""
    i = F.col("doc_id")
    pick = lambda values, k: F.element_at(F.array(*[F.lit(v) for v in values]), (k % len(values) + 1).cast("int"))
    day = F.date_add(F.lit("2024-01-01").cast("date"), (i % 120).cast("int"))
    df = table(spark, sf_dir, "documents").select(
        i.alias("ord"), pick(SOURCES, i).alias("source"), F.when(i % 7 == 3, "reddit").otherwise("rss").alias("source_type"),
        F.when((i * 5 + F.floor(i / 7)) % 16 < 8, "ufo").otherwise("crisis").alias("category"), (1 + i % 3).cast("int").alias("weight"),
        pick(HEADLINES, i * 5 + F.floor(i / 7)).alias("title"), F.col("text").alias("description"),
        F.when(i % 31 != 0, day).alias("date"), (i % 31 != 0).alias("date_parsed_ok"),
        F.when((i % 5 != 0) & (i % 31 != 0), F.timestamp_seconds(F.unix_date(day).cast("long") * 86400 + (i % 24) * 3600)).alias("published_at"),
        F.concat(F.when(i % 9 == 0, "http").otherwise("https"), F.lit("://site"), (i % 11).cast("string"), F.lit(".example.com/a/"), (i % 97).cast("string")).alias("url"),
        F.concat(F.lit("site"), (i % 11).cast("string"), F.lit(".example.com")).alias("domain"),
        F.when(i % 7 == 1, F.concat(F.lit("site"), (i % 13).cast("string"), F.lit(".example.com"))).alias("publisher"),
    )
    return df


def country(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``d, unit, v``: orders per day and region, as a table. The small dimensions are broadcast by Spark where their size allows."""
    o = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderdate").cast("date").alias("d"))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    return shared_table(o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("d", F.col("n_regionkey").alias("unit")).agg(F.count("*").alias("v")), "country")


def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderdate").cast("date").alias("d"))
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("topic"))
    return shared_table(o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("d", "topic").agg(F.count("*").alias("n")), "topics")


PANEL_SQL = """panel AS (SELECT CAST(o_orderdate AS DATE) AS d, count(*) FILTER (o_orderpriority IN ('1-URGENT', '3-MEDIUM')) AS crisis, count(*) FILTER (o_orderpriority IN ('2-HIGH', '4-NOT SPECIFIED')) AS outcome, count(*) FILTER (o_orderpriority = '5-LOW') AS control FROM orders GROUP BY 1)"""
DENSE_SQL = PANEL_SQL + """,
g AS (SELECT CAST(unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS DATE) AS d FROM panel),
dense AS (SELECT g.d, panel.d IS NOT NULL AS observed, coalesce(crisis, 0) AS crisis, coalesce(outcome, 0) AS outcome, coalesce(control, 0) AS control, coalesce(control, 0) / greatest(1, coalesce(crisis, 0) + coalesce(outcome, 0)) AS density, coalesce(outcome, 0) / (1 + coalesce(control, 0) / greatest(1, coalesce(crisis, 0) + coalesce(outcome, 0))) AS adj FROM g LEFT JOIN panel ON g.d = panel.d)"""
SHOCKS_SQL = """thr AS (SELECT greatest(2.0, coalesce(quantile_cont(CAST(crisis AS DOUBLE), 0.9) FILTER (crisis > 0), 2.0)) AS t90, greatest(2.0, coalesce(quantile_cont(CAST(crisis AS DOUBLE), 0.75) FILTER (crisis > 0), 2.0)) AS t75 FROM panel),
shocks AS (SELECT d, CASE WHEN (SELECT count(*) FROM panel, thr WHERE crisis >= t90) >= 5 THEN t90 ELSE t75 END AS threshold FROM panel, thr WHERE crisis >= CASE WHEN (SELECT count(*) FROM panel, thr WHERE crisis >= t90) >= 5 THEN t90 ELSE t75 END)"""


def _pick(values: list[str], k: str) -> str:
    return f"([{', '.join(repr(v) for v in values)}])[CAST({k} AS BIGINT) % {len(values)} + 1]"


ITEMS_SQL = f"""items AS (SELECT doc_id AS ord, {_pick(SOURCES, 'doc_id')} AS source, CASE WHEN doc_id % 7 = 3 THEN 'reddit' ELSE 'rss' END AS source_type,
  CASE WHEN (doc_id * 5 + doc_id // 7) % 16 < 8 THEN 'ufo' ELSE 'crisis' END AS category, CAST(1 + doc_id % 3 AS INT) AS weight, {_pick(HEADLINES, '(doc_id * 5 + doc_id // 7)')} AS title, text AS description,
  CASE WHEN doc_id % 31 <> 0 THEN DATE '2024-01-01' + CAST(doc_id % 120 AS INT) END AS date, doc_id % 31 <> 0 AS date_parsed_ok,
  CASE WHEN doc_id % 5 <> 0 AND doc_id % 31 <> 0 THEN CAST(DATE '2024-01-01' + CAST(doc_id % 120 AS INT) AS TIMESTAMP) + to_hours(CAST(doc_id % 24 AS INT)) END AS published_at,
  CASE WHEN doc_id % 9 = 0 THEN 'http' ELSE 'https' END || '://site' || (doc_id % 11) || '.example.com/a/' || (doc_id % 97) AS url, 'site' || (doc_id % 11) || '.example.com' AS domain,
  CASE WHEN doc_id % 7 = 1 THEN 'site' || (doc_id % 13) || '.example.com' END AS publisher FROM documents)"""
