"""Operator 5, line dedup by distinct-site spread, in DataFrame functions only.

A HyperLogLog sketch of the sites of every line hash is built in each task and merged by aggregation. Lines whose
estimate is near the threshold get an exact distinct count; lines on enough sites are cross-site boilerplate and
are cut out of every document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WHITE, line_key, table, text_of, written

MIN_SITES = 10
#: An estimate within this share of the threshold is counted exactly: six standard errors at LG_K = 12.
NEAR = 0.1
LG_K = 12
#: Parts into which each boilerplate hash is dealt, so that a line that a third of all documents hold isn't one task.
SALTS = 16


def _row_key(doc_id: str, text: str):
    return line_key(F.concat_ws("\x00", F.coalesce(F.col(doc_id).cast("string"), F.lit("\x01")), text_of(text)))


def spread_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """``row_key, pos``: every place of a line that stands on at least ``min_sites`` distinct sites."""
    lines = docs.select(_row_key(doc_id, text).alias("row_key"), F.col(site).cast("string").alias("_site"), F.posexplode(F.split(text_of(text), "\n", -1)).alias("pos", "line")).where(F.trim("line", F.lit(WHITE)) != "").withColumn("key", line_key(F.col("line"))).drop("line")
    est = lines.where(F.col("_site").isNotNull()).groupBy("key").agg(F.hll_sketch_agg("_site", LG_K).alias("sketch")).select("key", F.hll_sketch_estimate("sketch").alias("est")).where(F.col("est") >= F.lit(min_sites * (1 - NEAR)))
    dealt = est.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    hits = written(lines.withColumn("salt", F.pmod("row_key.a", F.lit(SALTS)).cast("int")).join(dealt, ["key", "salt"]).drop("salt"), "line-hits")
    near = hits.where((F.col("est") < F.lit(min_sites * (1 + NEAR))) & F.col("_site").isNotNull())
    exact = near.groupBy("key", "_site").agg(F.lit(1).alias("one")).groupBy("key").agg(F.count("one").alias("exact")).where(F.col("exact") >= min_sites)
    sure = hits.where(F.col("est") >= F.lit(min_sites * (1 + NEAR))).select("row_key", "pos")
    chosen = exact.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).drop("exact")
    close = hits.where(F.col("est") < F.lit(min_sites * (1 + NEAR))).withColumn("salt", F.pmod("row_key.a", F.lit(SALTS)).cast("int")).join(chosen, ["key", "salt"], "left_semi").select("row_key", "pos")
    return sure.unionByName(close)


def line_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """``docs`` with ``text`` cleaned of boilerplate lines, and ``n_lines, n_lines_removed``.

    Every line on ``min_sites`` distinct sites goes, also where that leaves nothing of a document, as with texts that
    are themselves copied to so many sites. Lines are compared exactly; blank lines are never boilerplate. A null site counts for no spread, though the lines
    of its documents are cut like others. A null text counts as empty and comes back empty, with one (blank) line.
    Repeated rows are cleaned alike, each site once; an empty table gives an empty result; other columns pass
    through, and columns of the names above are replaced.
    """
    other = [c for c in docs.columns if c not in ("n_lines", "n_lines_removed")]
    docs = docs.select(*other)
    cut = spread_lines(docs, doc_id, text, site, min_sites).groupBy("row_key").agg(F.collect_set("pos").alias("_cut"))
    df = docs.withColumn("row_key", _row_key(doc_id, text)).join(cut, "row_key", "left").withColumn("_lines", F.split(text_of(text), "\n", -1))
    df = df.withColumn("_keep", F.when(F.col("_cut").isNotNull(), F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "_cut")))
    df = df.withColumn("_clean", F.when(F.col("_cut").isNotNull(), F.array_join(F.transform("_keep", lambda i: F.get("_lines", i)), "\n")))
    return df.select(*[F.coalesce("_clean", text_of(c)).alias(c) if c == text else F.col(c) for c in other], F.size("_lines").cast("long").alias("n_lines"), F.coalesce(F.size("_lines") - F.size("_keep"), F.lit(0)).cast("long").alias("n_lines_removed"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return line_dedup(docs).select("doc_id", "n_lines", "n_lines_removed", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, source FROM documents),
l AS (SELECT rid, source, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS pos FROM d),
b AS (SELECT line FROM l WHERE trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '' GROUP BY line HAVING count(DISTINCT source) >= {MIN_SITES}),
c AS (SELECT rid, count(*) AS n, count(*) FILTER (l.line IN (SELECT line FROM b)) AS cut, coalesce(string_agg(l.line, chr(10) ORDER BY pos) FILTER (l.line NOT IN (SELECT line FROM b)), '') AS clean FROM l GROUP BY rid)
SELECT doc_id, CAST(n AS BIGINT) AS n_lines, CAST(cut AS BIGINT) AS n_lines_removed, CAST(length(clean) AS BIGINT) AS n_chars, md5(clean) AS text_md5 FROM c JOIN d USING (rid)"""

QUERIES = {"op5_line_dedup": op5_line_dedup}
ORACLES = {"op5_line_dedup": SQL}
