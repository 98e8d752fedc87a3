"""Operator 3, WARC archives: written by Spark's text sink, read back by boundary-chain verification.

The reader cuts files at every occurrence of the record magic, in as many tasks as the files have splits. Each
occurrence is a candidate that names its successor's offset. A candidate whose successor is the next candidate merely
continues a run; the few others make a graph of runs, on which pointer jumping from the file start finds what is
reachable. Magic inside a payload is never reached and falls back to the record that holds it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import dropped, fresh_dir, table, written
from .components import salted_join

#: Fixed values of the format.
MAGIC = "WARC/1.0\r\n"
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID_FORM = "<urn:x-page:%s>"

MIN_REVISIT_BYTES = 1000
#: Rows in a file at most: compressed files aren't split, so this bounds what one reading task holds in order.
ROWS_PER_FILE = 50_000


def write_archive(pages: DataFrame, path: str, min_revisit_bytes: int = MIN_REVISIT_BYTES, date: str = "2024-01-01T00:00:00Z", compression: str = "gzip") -> None:
    """Writes a record per row of ``pages (page_id, url, html)`` under ``path``.

    Of rows with equal payloads of at least ``min_revisit_bytes`` bytes, those with the largest page_id are responses
    and the others revisit it. A null html is an empty payload, a null url leaves its header out, and a row without
    page_id is a response with a record id of its own. Repeated rows give repeated records; an empty table gives no
    records. Other columns are ignored.
    """
    body = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", F.regexp_replace("url", r"[\r\n]+", "").alias("url"), body.alias("html"), F.sha1(body.cast("binary")).alias("digest"), F.octet_length(body).alias("n"))
    targets = rows.where(F.col("n") >= min_revisit_bytes).groupBy("digest").agg(F.max("page_id").alias("target"), F.count("*").alias("copies")).where("copies > 1 AND target IS NOT NULL").drop("copies")
    rows = salted_join(rows, written(targets, "warc-targets"), ["digest"], "page_id", "left", merge=False)
    revisit = F.col("target").isNotNull() & (F.col("n") >= min_revisit_bytes) & F.coalesce(F.col("page_id") != F.col("target"), F.lit(False))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit(END))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    head = F.concat(
        F.lit(MAGIC + "WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.concat(F.lit("\r\nWARC-Record-ID: "), F.format_string(ID_FORM, F.coalesce(F.col("page_id").cast("string"), F.concat(F.lit("none:"), F.uuid())))),
        F.coalesce(F.concat(F.lit("\r\nWARC-Target-URI: "), F.col("url")), F.lit("")),
        F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(revisit, F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), F.format_string(ID_FORM, F.col("target").cast("string")))).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(END),
    )
    rows.select(F.concat(head, block).alias("value")).write.option("lineSep", END).option("compression", compression).option("maxRecordsPerFile", ROWS_PER_FILE).text(path)


def _field(head: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(head, rf"(?i)(?:^|\r\n){name}:[ \t]*([^\r\n]*)", 1), F.lit(""))


def _record(df: DataFrame) -> DataFrame:
    """Adds what a record's bytes say, taken as whole; ``value`` starts behind the magic."""
    df = df.withColumn("head", F.substring_index("value", END, 1))
    head_n, size = F.octet_length("head"), F.col("content_length")
    df = df.withColumns({"content_length": F.when(F.col("head") != F.col("value"), _field(F.col("head"), "Content-Length").try_cast("long")), "http": F.coalesce(_field(F.col("head"), "Content-Type").startswith("application/http"), F.lit(False))})
    inner = F.octet_length(F.substring_index("value", END, 2)) - head_n  # the HTTP head with its leading blank line
    skip = F.when(F.col("http") & (inner <= size), inner).otherwise(F.lit(0))
    payload = F.substring(F.col("value").cast("binary"), (head_n + 5 + skip).cast("int"), (size - skip).cast("int"))
    df = df.withColumn("payload", F.when(size.isNotNull(), payload))
    return df.withColumns({"claims": head_n + 2 * len(END) + size, "record_type": F.lower(_field(F.col("head"), "WARC-Type")), "record_id": _field(F.col("head"), "WARC-Record-ID"), "target_uri": _field(F.col("head"), "WARC-Target-URI"), "refers_to_id": _field(F.col("head"), "WARC-Refers-To"), "declared_digest": F.regexp_replace(_field(F.col("head"), "WARC-Payload-Digest"), "^sha1:", ""), "payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha1("payload")}).drop("head", "http")


FIELDS = ("record_type", "record_id", "target_uri", "refers_to_id", "declared_digest", "payload_bytes", "payload_digest")


def _candidates(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("lineSep", MAGIC).text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"), F.octet_length("value").cast("long").alias("n"), "value")


def _offsets(c: DataFrame) -> DataFrame:
    """Offsets of candidates: running sums within a split, on top of the sums of the file's earlier splits."""
    by_block = c.groupBy("file", "block").agg(F.sum(F.col("n") + len(MAGIC)).alias("size"))
    start = by_block.select("file", "block", F.coalesce(F.sum("size").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    run = F.coalesce(F.sum(F.col("n") + len(MAGIC)).over(W.partitionBy("file", "block").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return c.withColumn("run", run).join(start, ["file", "block"]).withColumn("off", F.col("start") + F.col("run") - len(MAGIC)).drop("run", "start").where(F.col("off") >= 0)


def reachable_runs(heads: DataFrame) -> DataFrame:
    """Pointer jumping: of ``file, off, to`` (each run's start and where its last record leads), the ``file, off`` reached from offset 0."""
    rounds = math.ceil(math.log2(max(2, heads.groupBy("file").count().agg(F.max("count")).first()[0] or 0))) + 1
    hop = heads.where("to IS NOT NULL")
    found, old = heads.where("off = 0").select("file", "off"), []
    for _ in range(rounds):
        further = found.join(hop, ["file", "off"]).select("file", F.col("to").alias("off"))
        now = written(found.union(further).distinct(), "warc-reached")
        far = hop.select("file", F.col("off").alias("to"), F.col("to").alias("far"))
        then = written(hop.join(far, ["file", "to"]).select("file", "off", F.col("far").alias("to")), "warc-hops")
        dropped(*old)
        found, hop, old = now, then, [now, then]
    return found


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """``file, off`` and the fields of every record of the archives at ``path``, plain or compressed as a whole.

    Payload bytes and digest are those of the bytes in the record, so of a revisit those of its empty payload. A
    file that doesn't begin with a record has none; a chain that leads to no record's start ends there. Payloads may
    hold any bytes. No files, or empty ones, give an empty result.
    """
    c = written(_record(_candidates(spark, path)).drop("value", "payload"), "warc-parsed")
    c = written(_offsets(c), "warc-candidates").withColumn("next", F.col("off") + len(MAGIC) + F.col("n")).withColumn("succ", F.col("off") + len(MAGIC) + F.col("claims"))
    whole = F.coalesce(F.col("succ") == F.col("next"), F.lit(False))
    breaks = c.where(~whole).select("file", "off", "next", "succ")
    keys = ["file", "off"]
    if breaks.isEmpty():
        started = c.where("off = 0").select("file")
        return c.join(started, "file", "left_semi").select(*keys, *FIELDS)
    starts = c.select("file", "off")
    jumps = breaks.select("file", F.col("off").alias("from"), F.col("succ").alias("off")).join(starts, keys, "left_semi")
    at = jumps.select(*keys).union(breaks.select("file", F.col("next").alias("off"))).union(starts.where("off = 0")).distinct()
    after = at.select("file", "off", F.lead("off").over(W.partitionBy("file").orderBy("off")).alias("until"))
    broken = breaks.select("file", F.col("next").alias("until"), F.col("off").alias("from"))
    leads = after.join(broken, ["file", "until"], "left").join(jumps.select("file", "from", F.col("off").alias("target")), ["file", "from"], "left")
    heads = written(leads.select("file", "off", F.when(F.col("from").isNull(), F.col("until")).otherwise(F.col("target")).alias("to")), "warc-runs")
    reached = reachable_runs(heads).withColumn("ok", F.lit(True))
    flags = heads.select(*keys).join(reached, keys, "left").select(*keys, F.coalesce("ok", F.lit(False)).alias("ok"))
    # a candidate is as reachable as the last run start at or before it: looked up within its split, else from the splits before
    marked = c.join(flags, keys, "left")
    last = marked.groupBy("file", "block").agg(F.max_by("ok", F.when(F.col("ok").isNotNull(), F.col("off"))).alias("last"))
    carry = last.select("file", "block", F.last("last", ignorenulls=True).over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)).alias("carry"))
    in_block = W.partitionBy("file", "block").orderBy("off").rowsBetween(W.unboundedPreceding, 0)
    marked = marked.withColumn("ok", F.last("ok", ignorenulls=True).over(in_block)).join(carry, ["file", "block"], "left").withColumn("ok", F.coalesce("ok", "carry", F.lit(False)))
    marked = written(marked.withColumn("whole", whole), "warc-marked")
    plain = marked.where("ok AND whole").select(*keys, *FIELDS)
    # a record that holds magic is put together from its pieces: files with such records are read again, and as splits
    # may differ from those of the first reading, pieces are known by their offsets alone
    own = marked.where(~F.col("ok") | ~F.col("whole")).withColumn("owner", F.last(F.when(F.col("ok"), F.col("off")), ignorenulls=True).over(W.partitionBy("file").orderBy("off").rowsBetween(W.unboundedPreceding, 0)))
    spans = own.join(marked.where("ok AND NOT whole").select("file", F.col("off").alias("owner"), F.col("succ").alias("end")), ["file", "owner"]).where("off < end").select("file", "off", "owner")
    again = written(_candidates(spark, path).join(written(breaks.select("file").distinct(), "warc-broken"), "file", "left_semi"), "warc-again")
    places = _offsets(again.drop("value")).join(spans, keys).select("file", "block", "seq", "off", "owner")
    pieces = again.select("file", "block", "seq", "value").join(places, ["file", "block", "seq"]).groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("off", "value"))).alias("p"))
    parts = pieces.select("file", F.col("owner").alias("off"), F.array_join(F.transform("p", lambda x: x["value"]), MAGIC).alias("value"))
    return plain.unionByName(_record(parts).select(*keys, *FIELDS).where(F.col("payload_bytes").isNotNull()))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_dir(spark, "warc")
    write_archive(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    page = lambda c: F.regexp_extract(c, r"^<urn:x-page:(-?\d+)>$", 1).try_cast("long")  # noqa: E731  # the whole form: other ids are none
    records = written(read_archive(spark, path).select(page("record_id").alias("page_id"), "record_type", page("refers_to_id").alias("refers_to"), "declared_digest", "payload_bytes", "payload_digest"), "warc-records")
    full = records.where("record_type = 'response'").groupBy(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("declared_digest")).agg(F.max("payload_bytes").alias("b"))
    out = salted_join(records, full, ["refers_to", "declared_digest"], "page_id", "left", merge=False)
    return out.select("page_id", F.coalesce("b", "payload_bytes").alias("payload_bytes"), F.when(F.col("b").isNotNull(), F.col("declared_digest")).otherwise(F.col("payload_digest")).alias("payload_digest"), "record_type", "refers_to")


SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
g AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= {MIN_REVISIT_BYTES} AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {MIN_REVISIT_BYTES} AND page_id <> top THEN top END AS refers_to FROM g"""

QUERIES = {"op3_warc": op3_warc}
ORACLES = {"op3_warc": SQL}
