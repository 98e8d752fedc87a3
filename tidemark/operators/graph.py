"""Connected components of a table of edges, by alternating large-star and small-star."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..sources.shared import dropped, shared_table

#: Parts into which a hub's edges are dealt, and edges that a task of a round may have.
SALTS, EDGES = 16, 100_000


def _star(edges: DataFrame, large: bool, few: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Links the larger neighbours of each node, or the smaller ones and itself, to the least of it and its neighbours."""
    back = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    near = edges.union(back) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = few(near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
    salt = F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")
    dealt = least.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = few(near.withColumn("_salt", salt).join(dealt.hint("merge"), ["u", "_salt"]))
    if large:
        return joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return joined.select("v", "m").union(least.select("u", "m")).toDF("u", "v").where("u <> v")


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for each node of ``edges (u, v)``: the least node that it reaches. Loops and nulls are ignored.

    Rounds end when the edges' count and hash sum, observed while a round is written, stay the same; the count also
    says how many tasks the next round needs. No group of edges is collected anywhere.
    """
    now = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    most = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at, seen = None, None
    while True:
        by = Observation()
        table = shared_table(now.observe(by, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")), "components")
        if at is not None:
            dropped(at)
        at, got = table, by.get
        if not got.get("n") or got == seen:
            break
        tasks = max(1, -(-got["n"] // EDGES))
        few = (lambda df, n=tasks: df.coalesce(n)) if tasks < most else (lambda df: df)
        seen, now = got, few(_star(_star(at, True, few), False, few).distinct())
    return at.select(F.col("u").alias("node"), F.col("v").alias("component")).union(at.select("v", F.col("v").alias("component")).distinct())
