"""The daily panel as a stream: events in, keyed rows out, each once however often a batch is repeated."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.readers import exists
from ..sources.sinks import upsert


def daily_stream(events: DataFrame, ts: str = "ts", late: str = "120 days") -> DataFrame:
    """Counts per day of a stream with ``event_type``; events later than ``late`` are dropped, repeated event ids too."""
    once = events.withWatermark(ts, late).dropDuplicatesWithinWatermark(["event_id"])
    kind = F.col("event_type")
    return once.groupBy(F.window(ts, "1 day").alias("w")).agg(F.count_if(kind == "error").alias("crisis"), F.count_if(kind == "purchase").alias("outcome"), F.count_if(~kind.isin("error", "purchase")).alias("control")).select(F.to_date("w.start").alias("d"), "crisis", "outcome", "control")


def upsert_days(new: DataFrame, path: str, keys: tuple[str, ...] = ("d",)) -> None:
    """Puts ``new`` into the panel at ``path``, which is partitioned by month: only the months of its days are read and replaced.

    New rows stand for the old ones of their keys; put in once more, they change nothing. ``new`` is computed once. The
    months' new state is written beside the panel first, as a table can't replace what it is read from; a batch that
    fails in between is put in again whole.
    """
    spark = new.sparkSession
    beside = f"{path.rstrip('/')}-new-{uuid.uuid4().hex}"
    new.withColumn("month", F.trunc("d", "month")).write.parquet(f"{beside}/in")
    rows = spark.read.parquet(f"{beside}/in")
    months = [r["month"] for r in rows.select("month").distinct().collect()]  # bounded by the calendar
    if months:
        if exists(spark, path):
            rows = upsert(spark.read.parquet(path).where(F.col("month").isin(months)), rows, list(keys))
        rows.write.partitionBy("month").parquet(f"{beside}/out")
        spark.read.parquet(f"{beside}/out").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(beside)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def read_days(spark, path: str) -> DataFrame:  # noqa: ANN001
    return spark.read.parquet(path).drop("month")


def upsert_stream(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keeps the panel at ``path`` up to date, a batch at a time. The stream's own state is keyed by day, so a batch holds the days that changed."""
    return counts.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, _: upsert_days(df, path)).start()
