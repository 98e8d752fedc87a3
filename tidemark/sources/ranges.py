"""Scans of day ranges from a source that may refuse them.

The open ranges are partitions of a data source, whose tasks ask for them one after another: by each mode in turn,
then, for short ranges, by a fallback. What stays unanswered is cut in halves and asked for again, down to a floor.
A round is a table, so an answer is asked for once, and the rounds are as many as halvings of the longest range.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.gates import slice_ranges, split_range
from .shared import shared_table

#: ``fetch(query, mode, start, end)`` gives counts by day, or raises.
Fetch = Callable[[str, str, date, date], dict[date, int]]


class Limited(Exception):
    """The source asks for a pause."""


@dataclass(frozen=True)
class ScanPlan:
    """``modes`` are asked in turn, ``fallback`` (if any) for ranges of at most ``fallback_days``; a range of more than the floor is split.

    The floor is ``min_split_days``, or ``fallback_days`` where that is less and there is a fallback. Each mode is tried
    ``retries`` times, with a pause that doubles up to ``most_pause``, and lasts at least ``cooldown`` when the source is
    limited. ``tasks`` ask at the same time, at most.
    """

    modes: tuple[str, ...] = ("timeline_volraw", "timeline_vol")
    fallback: str | None = None
    fallback_days: int = 14
    chunk_days: int = 5000
    min_split_days: int = 90
    retries: int = 3
    cooldown: float = 45.0
    most_pause: float = 120.0
    tasks: int = 16

    @property
    def floor(self) -> int:
        least = max(1, self.min_split_days)
        return min(least, max(1, self.fallback_days)) if self.fallback else least

    def pause(self, attempt: int, limited: bool) -> float:
        base = min(self.most_pause, 1.2 * 2.0 ** (attempt - 1))
        return max(self.cooldown, base) if limited else base


def ask(fetch: Fetch, plan: ScanPlan, query: str, start: date, end: date, sleep: Callable[[float], None] = time.sleep) -> tuple[str | None, dict[date, int], str]:
    """The mode that answered, its counts, and what the others said."""
    modes = list(plan.modes)
    if plan.fallback and (end - start).days + 1 <= max(1, plan.fallback_days):
        modes.append(plan.fallback)
    errors = []
    for mode in modes:
        said = "unknown_error"
        for attempt in range(1, max(1, plan.retries) + 1):
            try:
                return mode, fetch(query, mode, start, end), " | ".join(errors)
            except Exception as e:  # whatever the source's client raises
                said = f"attempt={attempt}: {e}"
                if attempt < plan.retries:
                    sleep(plan.pause(attempt, isinstance(e, Limited)))
        errors.append(f"{mode}: {said}")
    return None, {}, " | ".join(errors)


class _Part(InputPartition):
    def __init__(self, ranges: list[list]) -> None:
        super().__init__(0)
        self.ranges = ranges


ANSWER = "query string, ord long, start date, end date, source string, counts array<struct<d: date, n: long>>, error string"


def range_source(fetch: Fetch, plan: ScanPlan, name: str) -> type[DataSource]:
    """A data source of that name; its option ``ranges`` lists the ranges to ask for, which its partitions share."""

    class Reader(DataSourceReader):
        def __init__(self, ranges: str) -> None:
            self.ranges = json.loads(ranges)

        def partitions(self) -> list[InputPartition]:
            n = max(1, min(plan.tasks, len(self.ranges)))
            return [_Part(self.ranges[k::n]) for k in range(n)]

        def read(self, partition: _Part) -> Iterator[tuple]:
            for query, order, a, b in partition.ranges:
                start, end = date.fromisoformat(a), date.fromisoformat(b)
                mode, counts, error = ask(fetch, plan, query, start, end)
                yield query, order, start, end, mode, sorted(counts.items()) if mode else None, error

    class Ranges(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return ANSWER

        def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
            return Reader(self.options["ranges"])

    return Ranges


def answers(spark: SparkSession, ranges: DataFrame, fetch: Fetch, plan: ScanPlan = ScanPlan()) -> DataFrame:
    """A row for each range that was answered, or given up: ``query, ord, start, end, source, counts, error``; source and counts are null for the latter.

    ``ranges (query, start, end)`` and, where they overlap, ``ord``, their order. The driver lists the ranges that are
    still open: as many as there are requests to make.
    """
    name = f"ranges_{uuid.uuid4().hex}"
    spark.dataSource.register(range_source(fetch, plan, name))
    asked = ranges if "ord" in ranges.columns else ranges.withColumn("ord", F.lit(0).cast("long"))
    frontier = slice_ranges(asked.select("query", "start", "end", "ord"), max(1, plan.chunk_days)).select("query", "ord", "start", "end")
    out = None
    while True:
        rows = [[r["query"], r["ord"], r["start"].isoformat(), r["end"].isoformat()] for r in frontier.orderBy("query", "ord", "start").collect()]
        if not rows:
            return out if out is not None else spark.createDataFrame([], ANSWER)
        got = shared_table(spark.read.format(name).option("ranges", json.dumps(rows)).load(), "range-answers")
        again = F.col("source").isNull() & (F.datediff("end", "start") + 1 > plan.floor)
        settled = got.where(~again)
        out = settled if out is None else out.unionByName(settled)
        halves = got.where(again).select("query", "ord", F.explode(split_range(F.col("start"), F.col("end"))).alias("h"))
        frontier = halves.select("query", "ord", "h.start", "h.end")


def scan_table(found: DataFrame) -> DataFrame:
    """One table of :func:`answers`: ``query, kind, d, until, source, n, error``.

    ``count`` rows have a day's count and the source that gave it last, in the order of the ranges; ``covered`` rows the
    source of each day of an answered range, whether it came with a count or not; ``failed`` rows a range given up, from
    ``d`` to ``until``, with all that was said.
    """
    null = lambda kind: F.lit(None).cast(kind)
    place = F.struct("ord", "start")
    last = lambda df, *cols: df.groupBy("query", "d").agg(F.max_by(F.struct(*cols), place).alias("x"))
    ok = found.where("source IS NOT NULL")
    counts = last(ok.select("query", "ord", "start", "source", F.inline("counts")), "source", "n").select("query", F.lit("count").alias("kind"), "d", null("date").alias("until"), "x.source", "x.n", null("string").alias("error"))
    covered = last(ok.select("query", "ord", "start", "source", F.explode(F.sequence("start", "end")).alias("d")), "source").select("query", F.lit("covered").alias("kind"), "d", null("date").alias("until"), "x.source", null("long").alias("n"), null("string").alias("error"))
    failed = found.where("source IS NULL").select("query", F.lit("failed").alias("kind"), F.col("start").alias("d"), F.col("end").alias("until"), null("string").alias("source"), null("long").alias("n"), "error")
    return counts.unionByName(covered).unionByName(failed)


def scan(spark: SparkSession, ranges: DataFrame, fetch: Fetch, plan: ScanPlan = ScanPlan()) -> DataFrame:
    return scan_table(answers(spark, ranges, fetch, plan))


def status_of(scanned: DataFrame) -> Column:
    """For use in an aggregation by query: whether all, some or no ranges were answered."""
    bad, good = F.count_if(F.col("kind") == "failed"), F.count_if(F.col("kind") == "covered")
    return F.when(bad == 0, "full_success").when(good > 0, "partial_success").otherwise("failed")
