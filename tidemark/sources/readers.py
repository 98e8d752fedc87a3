"""Scans: panels, catalogs, curated pairs, source lists, topic files and feed payloads. Schemas are declared, never inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stats import strict_date
from ..functions.text import date_from_url, domain_of, normalize, strip_html

PANEL = (
    "date string, policy string, date_scope string, updated_at string, ufo_count int, crisis_count int, rejected_count int, accepted_events int, "
    "window_ufo_count int, window_crisis_count int, window_rejected_count int, window_accepted_events int, raw_items int, ufo_score_mean double, "
    "crisis_score_mean double, control_scope string, control_economy int, control_security int, control_immigration int, control_total int, "
    "control_density_accepted double, control_total_rejected_audit int, data_source string"
)
SOURCES = "name string, url string, type string, category string, weight int, active boolean, note string, fallback_url string, fallback_urls array<string>, paged_url_template string, paged_start int, paged_end int"
PAIRS = "correlations array<struct<id: string, region: string, confidence: string, crisis: struct<date: string, title: string>, ufo_event: struct<date: string, government_action: boolean>, gap_days: int>>"


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def json_rows(spark: SparkSession, path: str, field: str, row: str) -> DataFrame:
    """The array ``field`` of JSON documents as rows, with their place as ``ord``; a missing file gives none."""
    schema = f"{field} array<struct<{_fields(row)}>>"
    docs = spark.read.schema(schema).option("multiLine", True).json(path) if exists(spark, path) else spark.createDataFrame([], schema)
    return docs.select(F.posexplode(field).alias("ord", "r")).select("ord", "r.*")


def _fields(ddl: str) -> str:
    out, depth = [], 0
    for part in ddl.split(","):
        if depth:
            out[-1] += "," + part
        else:
            name, _, kind = part.strip().partition(" ")
            out.append(f"{name}: {kind}")
        depth += part.count("<") - part.count(">")
    return ", ".join(out)


def run_day_rows(panel: DataFrame) -> DataFrame:
    """If any row is of the run-day scope, only such rows; else all. Decided before any other filter."""
    any_run_day = panel.agg(F.coalesce(F.max(F.col("date_scope") == "run_day_only"), F.lit(False)).alias("_any"))
    return panel.join(F.broadcast(any_run_day)).where(~F.col("_any") | F.coalesce(F.col("date_scope") == "run_day_only", F.lit(False))).drop("_any")  # one row


def last_per_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key, by aggregation: no sort of a key's rows."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


def panel_rows(panel: DataFrame, policy: str, order: str = "ord") -> DataFrame:
    rows = run_day_rows(panel).where((F.col("policy") == policy) & (F.coalesce(F.col("date").cast("string"), F.lit("")) != ""))
    return last_per_key(rows, ["date"], order)


def preferred_policy(panel: DataFrame, policy: str, order: str = "ord") -> DataFrame:
    """Rows of ``policy`` if there are any, else those of the policy with most rows, the first seen among equals."""
    n = panel.groupBy("policy").agg(F.count("*").alias("n"), F.min(order).alias("first"))
    best = n.orderBy((F.col("policy") == policy).desc(), F.col("n").desc(), "first").limit(1)
    return panel.join(F.broadcast(best.select("policy")), "policy", "left_semi")  # one row


def curated_dates(spark: SparkSession, path: str) -> DataFrame:
    docs = spark.read.schema(PAIRS).option("multiLine", True).json(path)
    return docs.select(F.explode("correlations").alias("c")).select(strict_date(F.col("c.crisis.date")).alias("d")).where("d IS NOT NULL").distinct()


def catalog_dates(catalog: DataFrame, key: str = "shock_dates") -> DataFrame:
    """Dates of ``catalog (catalog_key, d)`` under ``key``; under ``shock_dates`` if it has no such key."""
    has = catalog.agg(F.coalesce(F.max(F.col("catalog_key") == key), F.lit(False)).alias("_has"))
    wanted = F.when(F.col("_has"), F.lit(key)).otherwise("shock_dates")
    return catalog.join(F.broadcast(has)).where(F.col("catalog_key") == wanted).select(strict_date(F.col("d").cast("string")).alias("d")).where("d IS NOT NULL").distinct()  # one row


def exogenous(spark: SparkSession, path: str, categories: list[str] | None = None) -> DataFrame:
    rows = json_rows(spark, path, "events", "date string, label string, category string, source string, priority_score double")
    rows = rows.select(strict_date(F.col("date")).alias("d"), F.lower(F.coalesce(F.nullif("category", F.lit("")), F.lit("unspecified"))).alias("category"), "label", F.coalesce(F.nullif("priority_score", F.lit(0.0)), F.lit(1000.0)).alias("score")).where("d IS NOT NULL")
    return rows.where(F.col("category").isin(*categories)) if categories else rows


def counts_csv(spark: SparkSession, path: str, key: str, value: str = "count") -> DataFrame:
    """``date, key, value`` of a CSV of strings; rows that don't parse go, the last per date and key stays."""
    raw = spark.read.option("header", True).schema(f"date string, {key} string, {value} string").csv(path)
    rows = raw.select(strict_date(F.col("date")).alias("d"), F.col(key), F.coalesce(F.nullif(value, F.lit("")), F.lit("0")).try_cast("double").alias(value), F.monotonically_increasing_id().alias("ord"))
    return last_per_key(rows.where(F.col("d").isNotNull() & (F.coalesce(key, F.lit("")) != "") & F.col(value).isNotNull()), ["d", key], "ord").drop("ord")


def source_list(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(SOURCES).option("multiLine", True).json(path)
    return rows.where(F.coalesce("active", F.lit(True)))


def page_urls(template: Column, first: Column, last: Column, most: int = 120) -> Column:
    """URLs of a paged source; none without ``{page}``."""
    lo = F.greatest(F.coalesce(first, F.lit(1)), F.lit(1))
    hi = F.least(F.coalesce(last, lo), lo + most - 1)
    urls = F.transform(F.sequence(lo, F.greatest(lo, hi)), lambda i: F.replace(template, F.lit("{page}"), i.cast("string")))
    return F.when(template.contains("{page}") & (hi >= lo), urls).otherwise(F.array().cast("array<string>"))


def retry_urls(paged: bool = True) -> Column:
    """A source's URLs in order of trial: its own, its fallbacks, its pages."""
    parts = [F.array("url", "fallback_url"), F.coalesce("fallback_urls", F.array().cast("array<string>"))]
    if paged:
        parts.append(page_urls(F.coalesce("paged_url_template", F.lit("")), F.col("paged_start"), F.col("paged_end")))
    return F.array_distinct(F.filter(F.concat(*parts), lambda u: F.coalesce(F.trim(u), F.lit("")) != ""))


def feed_timestamp(text: Column) -> Column:
    """RFC-822 dates, ISO dates, or the first ten characters as a day."""
    t = F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), r"^[A-Za-z]{3,9},\s*", "")
    forms = ["dd MMM yyyy HH:mm:ss z", "dd MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss z", "d MMM yyyy HH:mm:ss Z", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd HH:mm:ss"]
    return F.coalesce(*[F.try_to_timestamp(t, F.lit(f)) for f in forms], F.try_to_timestamp(F.substring(t, 1, 10), F.lit("yyyy-MM-dd")))


FEED = "title string, link string, id string, pubDate string, published string, updated string, description string, summary string, content string, source string"


ATOM = "title string, link array<struct<_href: string, _rel: string>>, id string, published string, updated string, summary string, content string"


def feed_items(payloads: DataFrame, payload: str = "payload", most: int = 30, chars: int | None = 500) -> DataFrame:
    """Entries of RSS payloads, or else of Atom ones, one row each; other columns of ``payloads`` describe the source. Entries without a title go; descriptions are cut to ``chars``."""
    other = [c for c in payloads.columns if c != payload]
    parsed = F.from_xml(F.col(payload), f"channel struct<item: array<struct<{_fields(FEED)}>>>, item array<struct<{_fields(FEED)}>>, entry array<struct<{ATOM}>>")
    text = F.lit(None).cast("string")
    atom = F.transform("x.entry", lambda e: F.struct(e["title"].alias("title"), F.coalesce(F.try_element_at(F.filter(e["link"], lambda k: F.coalesce(k["_rel"], F.lit("alternate")) == "alternate"), F.lit(1))["_href"], F.try_element_at(e["link"], F.lit(1))["_href"]).alias("link"), e["id"].alias("id"), text.alias("pubDate"), e["published"].alias("published"), e["updated"].alias("updated"), text.alias("description"), e["summary"].alias("summary"), e["content"].alias("content"), text.alias("source")))
    rows = payloads.select(*other, parsed.alias("x")).select(*other, F.posexplode(F.slice(F.coalesce("x.channel.item", "x.item", atom), 1, most)).alias("ord", "e"))
    raw = F.coalesce("e.pubDate", "e.published", "e.updated")
    link = F.coalesce(F.nullif("e.link", F.lit("")), "e.id")
    ts = feed_timestamp(raw)
    body = strip_html(F.coalesce("e.description", "e.summary", "e.content"))
    return rows.select(*other, "ord", normalize(F.col("e.title")).alias("title"), F.coalesce(F.to_date(ts), date_from_url(link)).alias("date"), ts.alias("published_at"), raw.alias("raw_date"), (ts.isNotNull() | date_from_url(link).isNotNull()).alias("date_parsed_ok"), (ts.isNull() & date_from_url(link).isNotNull()).alias("date_inferred_from_url"), link.alias("url"), domain_of(link).alias("domain"), (body if chars is None else F.substring(body, 1, chars)).alias("description"), F.col("e.source").alias("publisher_name")).where("title <> ''")


def reddit_items(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    other = [c for c in payloads.columns if c != payload]
    parsed = F.from_json(payload, "data struct<children: array<struct<data: struct<title: string, permalink: string, url: string, selftext: string, created_utc: double>>>>")
    rows = payloads.select(*other, F.posexplode(parsed["data"]["children"]["data"]).alias("ord", "e"))
    ts = F.timestamp_seconds("e.created_utc")
    return rows.select(*other, "ord", normalize(F.col("e.title")).alias("title"), F.to_date(ts).alias("date"), ts.alias("published_at"), F.col("e.url").alias("url"), domain_of(F.col("e.url")).alias("domain"), F.substring(normalize(F.col("e.selftext")), 1, 500).alias("description")).where("title <> ''")


def timeline_counts(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Daily counts of timeline payloads: ``value``, else ``norm``, without fraction; 0 where neither parses."""
    other = [c for c in payloads.columns if c != payload]
    parsed = F.from_json(payload, "timeline array<struct<data: array<struct<date: string, value: string, norm: string>>>>")
    rows = payloads.select(*other, F.explode(parsed["timeline"][0]["data"]).alias("e"))
    return rows.select(*other, F.to_date(F.try_to_timestamp(F.substring("e.date", 1, 8), F.lit("yyyyMMdd"))).alias("d"), F.coalesce(F.coalesce("e.value", "e.norm").try_cast("double").cast("long"), F.lit(0)).alias("n")).where("d IS NOT NULL")
