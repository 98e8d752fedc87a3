"""Connected components of an edge table by alternating large-star and small-star."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import dropped, written

#: Parts into which a hub's edges are dealt, so that a node with a third of all edges isn't one task.
SALTS = 16
#: A key with more than one in so many rows is a hub.
HEAVY = 500
#: Edges that a task of a round may have: a graph of few edges needs no more tasks than that.
EDGES = 100_000


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], spread: str, how: str = "inner", merge: bool = True, hot: str | None = None) -> DataFrame:
    """``big`` joined with ``small``, whose keys are distinct, with each key of ``big`` dealt out by a hash of ``spread``.

    By sort-merge, unless ``merge`` is false: Spark's size check sees ``small`` before its rows are repeated for the salts.
    ``hot`` names a flag that both sides have for each key; only keys with it are dealt out.
    """
    salt, salts = F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"), F.sequence(F.lit(0), F.lit(SALTS - 1))
    if hot:
        salt, salts, keys = F.when(F.col(hot), salt).otherwise(0), F.when(F.col(hot), salts).otherwise(F.array(F.lit(0))), [*keys, hot]
    dealt = small.withColumn("_salt", F.explode(salts))
    return big.withColumn("_salt", salt).join(dealt.hint("merge") if merge else dealt, [*keys, "_salt"], how).drop("_salt")


def heavy_join(big: DataFrame, small: DataFrame, keys: list[str], spread: str, count: str = "c", how: str = "inner") -> DataFrame:
    """``big`` joined with ``small``, which has a row for each key and in ``count`` the rows of ``big`` with it.

    Keys with over one in HEAVY of all these rows are dealt out by a hash of ``spread``. There are HEAVY of them at
    most, so their list may be broadcast. ``small`` should be a written table: it is read three times.
    """
    total = small.agg(F.sum(count)).first()[0] or 0
    hot = small.where(F.col(count) * HEAVY > total)
    listed = hot.select(*keys, F.lit(True).alias("_hot"))
    salt, salts = F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"), F.sequence(F.lit(0), F.lit(SALTS - 1))
    dealt = small.withColumn("_salt", F.explode(F.when(F.col(count) * HEAVY > total, salts).otherwise(F.array(F.lit(0))))).drop(count)
    marked = big.join(F.broadcast(listed), keys, "left").withColumn("_salt", F.when(F.col("_hot"), salt).otherwise(0)).drop("_hot")
    return marked.join(dealt.hint("merge"), [*keys, "_salt"], how).drop("_salt")


def _star(edges: DataFrame, large: bool, few: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Links the (larger, or smaller and own) neighbours of each node u to the least of u and its neighbours."""
    near = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = few(near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
    joined = few(salted_join(near, least, ["u"], "v"))
    moved = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")) if large else joined.select("v", "m").union(least.select("u", "m")).toDF("u", "v")
    return moved.where("u <> v")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``u, component``: for each node of ``edges (u, v)`` the least node that it reaches. Nulls and loops are ignored.

    Each round is a table; the one before it is deleted. The rounds end when edge count and hash sum, observed while
    a table is written, stay the same. The count also says how many tasks the next round needs.
    """
    now, at = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), None
    seen = None
    while True:
        seen_by = Observation()
        table = written(now.observe(seen_by, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")), name)
        if at is not None:
            dropped(at)
        at, got = table, seen_by.get
        if not got.get("n") or got == seen:
            break
        tasks = max(1, -(-got["n"] // EDGES))
        few = (lambda df, n=tasks: df.coalesce(n)) if tasks < int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")) else (lambda df: df)
        seen, now = got, few(_star(_star(at, True, few), False, few).distinct())
    return at.select("u", F.col("v").alias("component")).union(at.select(F.col("v").alias("u"), F.col("v").alias("component")).distinct())
