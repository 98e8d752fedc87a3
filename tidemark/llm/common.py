"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the word rule, space and 0x09 to 0x0D, as characters and as a pattern.
WHITE = " \t\n\x0b\x0c\r"
WHITE_RUN = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: ``spark.checkpoint.dir``. Where it is unset, a local session (tests) gets a temporary one; a cluster gets an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors see")
        found = tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/tidemark/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: its lineage ends there, and a lost executor costs no recomputation of it."""
    spark = df.sparkSession
    path = fresh_dir(spark, name)
    df.write.parquet(path)
    out = spark.read.parquet(path)
    out._written_at = path
    return out


def written_apart(df: DataFrame, name: str, by: str, values: list[str]) -> dict[str, DataFrame]:
    """As :func:`written`, a table for each of ``by``'s values, each of which :func:`dropped` can delete by itself."""
    spark = df.sparkSession
    path = fresh_dir(spark, name)
    df.write.partitionBy(by).option("compression", "zstd").parquet(path)
    out = {}
    for v in values:
        out[v] = spark.read.schema(df.schema).parquet(path).where(F.col(by) == v).drop(by)
        out[v]._written_at = f"{path}/{by}={v}"
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes tables of :func:`written` that no later step reads."""
    for t in tables:
        sc = t.sparkSession.sparkContext
        at = sc._jvm.org.apache.hadoop.fs.Path(t._written_at)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)
    gc.collect()  # lets Spark delete the shuffle files behind them


def freed(df: DataFrame) -> None:
    """Lets Spark delete the shuffle files of steps that no table needs any longer: its cleaner follows the driver's collections."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, in order; an empty array for a text without words."""
    inner = F.trim(text, F.lit(WHITE))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, WHITE_RUN))


def line_key(line: Column) -> Column:
    """128 bits of a string, as two independent hashes: no text is shuffled as a key."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(7), line).alias("b"))


def one_text_each(base: DataFrame, id: str = "id", text: str = "_text") -> DataFrame:
    """``base`` with one row for each id: that with the longest text, then the largest hash. Ids seen once, the rule, pass without a shuffle of texts."""
    sizes = base.groupBy(id).agg(F.count("*").alias("_n")).where("_n > 1").select(id)
    again = written(sizes, "repeated-ids")
    if again.isEmpty():
        return base
    key = F.struct(F.octet_length(text).alias("n"), F.sha2(F.col(text).cast("binary"), 256).alias("sha"))
    chosen = base.join(again, id, "left_semi").groupBy(id).agg(F.max(key).alias("_key"))
    several = base.withColumn("_k", key).join(chosen, id).where("_k = _key").dropDuplicates([id]).drop("_k", "_key")
    return base.join(again, id, "left_anti").unionByName(several)
