"""Draws of days and the tests on them.

Null distributions come from the recorded generator (see :mod:`.draws`), so that its results are met draw by draw.
:func:`hash_draws` ranks days by a hash of seed, draw and day instead, in any engine alike.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import binomial_right_tail
from . import draws as D
from .draws import exact_draws  # noqa: F401


def hash_draws(pool: DataFrame, size: DataFrame | int, draws: int, seed: int) -> DataFrame:
    """``draw, d``: for each draw, ``size`` days of the pool without repetition; none if the pool has fewer. Each draw ranks the days, one a row, in its own row."""
    days = pool.agg(F.collect_list("d").alias("_days"))
    sized = days.withColumn("_m", F.lit(size)) if isinstance(size, int) else days.crossJoin(F.broadcast(size.toDF("_m")))  # one row
    sized = sized.where((F.col("_m") > 0) & (F.col("_m") <= F.size("_days")))
    key = lambda d: F.md5(F.concat_ws("|", F.lit(str(seed)), "draw", d.cast("string")))
    ranked = F.sort_array(F.transform("_days", lambda d: F.struct(key(d).alias("key"), d.alias("d"))))
    numbers = pool.sparkSession.range(draws).select(F.col("id").alias("draw"))
    drawn = numbers.join(F.broadcast(sized)).select("draw", F.slice(ranked, F.lit(1), F.col("_m").cast("int")).alias("_x"))  # a row a day
    return drawn.select("draw", F.explode("_x").alias("_x")).select("draw", "_x.d")


def placebo_pool(days: DataFrame, shocks: DataFrame, buffer: int) -> DataFrame:
    """Days that are no shock and further than ``buffer`` days from any: an anti join on the days around shocks."""
    near = shocks.select(F.explode(F.sequence(F.date_sub("d", buffer), F.date_add("d", buffer))).alias("d")).distinct()
    return days.select("d").join(near, "d", "left_anti")


def gap_stats(pairs: DataFrame) -> DataFrame:
    """One row of ``pairs (a, b)``: ``n, mean_gap, mean_abs, within_30, within_60, positive, negative`` of the days from a to b."""
    gap = F.datediff("b", "a")
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    return pairs.where(gap.isNotNull()).agg(F.count("*").alias("n"), mean(gap).alias("mean_gap"), mean(F.abs(gap)).alias("mean_abs"), F.count_if(gap.between(0, 30)).alias("within_30"), F.count_if(gap.between(0, 60)).alias("within_60"), F.count_if(gap >= 0).alias("positive"), F.count_if(gap < 0).alias("negative"))


GAPS = "total_abs long, within_30 long, within_60 long"


def _gaps_of(gap) -> list[int]:  # noqa: ANN001
    return [int(abs(gap).sum()), int(((gap >= 0) & (gap <= 30)).sum()), int(((gap >= 0) & (gap <= 60)).sum())]


def pairing_test(pairs: DataFrame, draws: int, seed: int) -> dict:
    """Gap statistics of curated ``pairs (id, a, b)`` and the shares of shuffles of ``b`` that reach them, by the recorded generator; ``p_direction`` is the binomial tail of the positive gaps.

    The pairs are a list that people keep, so their days go to the tasks; see :func:`pairing_null` for pairs that come from data.
    """
    rows = pairs.where("a IS NOT NULL AND b IS NOT NULL").orderBy("id").select(F.unix_date("a").alias("a"), F.unix_date("b").alias("b")).collect()  # curated pairs
    a, b = (np.array([r[c] for r in rows], np.int64) for c in "ab")
    null = D.over_draws(pairs.sparkSession, seed, draws, D.shuffling(len(rows)), lambda at: _gaps_of(b[at] - a), GAPS)
    return _pairing_row(gap_stats(pairs), null)


def pairing_null(pairs: DataFrame, draws: int, seed: int, block: int = 1 << 20) -> DataFrame:
    """``draw, total_abs, within_30, within_60`` of ``pairs (a, b)`` of any number, for draws that pair them anew.

    What counts is how many pairs have a day on either side, so two counts by day go to the tasks and no pair. The k-th
    pair in order of ``a`` meets the one that the draw's permutation sends k to, in order of ``b``: no sort and no
    join. A task takes a block of places of one draw.
    """
    spark, known = pairs.sparkSession, pairs.where("a IS NOT NULL AND b IS NOT NULL")
    count = lambda c: known.groupBy(F.unix_date(c).alias("d")).agg(F.count("*").alias("n")).orderBy("d").collect()  # noqa: E731  # a row a day
    sides = [(np.array([r["d"] for r in x], np.int64), np.cumsum([r["n"] for r in x]).astype(np.int64)) for x in map(count, "ab")]
    n = int(sides[0][1][-1]) if len(sides[0][1]) else 0
    blocks = max(1, -(-n // block))

    def run(frames):  # noqa: ANN001, ANN202
        import pandas as pd

        for f in frames:
            out = []
            for i in f["id"].tolist():
                draw, part = divmod(i, blocks)
                at = np.arange(part * block, min(n, (part + 1) * block))
                day = lambda side, k: side[0][np.searchsorted(side[1], k, side="right")]
                out.append((draw, *_gaps_of(day(sides[1], D.feistel(at, n, draw, seed)) - day(sides[0], at))))
            yield pd.DataFrame(out, columns=["draw", *[c.split()[0] for c in GAPS.split(", ")]]).astype("int64")

    names = [c.split()[0] for c in GAPS.split(", ")]
    parts = spark.range(draws * blocks if n else 0).repartition(max(1, min(draws, spark.sparkContext.defaultParallelism))).mapInPandas(run, f"draw long, {GAPS}")
    return parts if blocks == 1 else parts.groupBy("draw").agg(*[F.sum(c).alias(c) for c in names])


def _pairing_row(stats: DataFrame, null: DataFrame) -> dict:
    """The statistics with the shares of draws that reach them; 1 without draws."""
    seen = stats.first().asDict()
    total = round(seen["mean_abs"] * seen["n"])
    got = null.agg(F.count("*").alias("draws"), F.avg((F.col("total_abs") <= total).cast("double")).alias("p_abs"), F.avg((F.col("within_30") >= seen["within_30"]).cast("double")).alias("p_30"), F.avg((F.col("within_60") >= seen["within_60"]).cast("double")).alias("p_60")).first().asDict()
    return seen | {k: 1.0 if v is None else v for k, v in got.items()} | {"p_direction": binomial_right_tail(seen["positive"], seen["n"], 0.5)}


def pairing_of(pairs: DataFrame, draws: int, seed: int) -> dict:
    """As :func:`pairing_test`, by :func:`pairing_null`."""
    return _pairing_row(gap_stats(pairs), pairing_null(pairs, draws, seed))


def null_table(days: DataFrame, columns: list[str], pool: DataFrame, size: int, draws: int, seed: int, peak: int | None = None) -> DataFrame:
    """``draw`` and, for each of ``columns`` of ``days (d, ...)``, its mean over the ``size`` days that the recorded generator samples of ``pool`` in order, nulls left out.

    The series go to the tasks as one array, a row a day. No rows for a size of 0 or over the pool's. With ``peak``,
    means are rounded to so many places and the largest of them comes back as ``peak`` instead.
    """
    wanted = pool.select("d").distinct()
    rows = days.select("d", *[F.col(c).cast("double").alias(c) for c in columns]).join(wanted, "d").orderBy("d").collect()  # a row a day
    values = np.array([[np.nan if r[c] is None else r[c] for c in columns] for r in rows], float).reshape(len(rows), len(columns))
    known = ~np.isnan(values)
    filled = np.where(known, values, 0.0)
    out = ["peak"] if peak is not None else list(columns)
    schema = ", ".join(f"`{c}` double" for c in out)
    if not 0 < size <= len(rows):
        return days.sparkSession.createDataFrame([], f"draw long, {schema}")

    def means(at) -> list:  # noqa: ANN001
        n = known[at].sum(axis=0)
        m = np.where(n > 0, filled[at].sum(axis=0) / np.maximum(n, 1), np.nan)
        if peak is not None:
            m = [np.nanmax(np.round(m, peak)) if (n > 0).any() else np.nan]
        return [None if np.isnan(x) else float(x) for x in m]

    return D.over_draws(days.sparkSession, seed, draws, D.sampling(len(rows), size), means, schema)


def p_of(null: DataFrame, observed: dict[str, float | None]) -> DataFrame:
    """``name, p, p_negative, draws, null_low, null_high`` for each observed value: the shares of draws at least as large, and at most as large; p is null without draws."""
    cells = []
    for c, x in observed.items():
        v, o = F.round(c, 9), F.lit(None if x is None else round(x, 9)).cast("double")
        cells.append(F.struct(F.lit(c).alias("name"), F.avg(F.when(v.isNotNull(), (v >= o).cast("double"))).alias("p"), F.avg(F.when(v.isNotNull(), (v <= o).cast("double"))).alias("p_negative"), F.count(c).alias("draws"), F.percentile(c, 0.025).alias("null_low"), F.percentile(c, 0.975).alias("null_high")))
    return null.agg(F.array(*cells).alias("x")).select(F.inline("x"))
