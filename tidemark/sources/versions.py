"""Tables kept in versions: each save is a folder of its own that appears at once, and none is written over.

A save is written beside the versions and then renamed to the next free number, which fails if another one took it
meanwhile; the save is then made anew from what that one left. Readers take the last version, whole.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sinks import append_new


class LockMismatch(Exception):
    """A catalog isn't the one that the lock names."""


def _path(spark: SparkSession, path: str):  # noqa: ANN202
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def versions(spark: SparkSession, path: str) -> list[int]:
    at = _path(spark, path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit())


def read_version(spark: SparkSession, path: str, n: int | None = None) -> DataFrame | None:
    """The version of that number, else the last one; none before the first save."""
    found = versions(spark, path)
    if not found or n is not None and n not in found:
        return None
    return spark.read.parquet(f"{path}/v{found[-1] if n is None else n}")


def commit(spark: SparkSession, path: str, make: Callable[[DataFrame | None], DataFrame], tries: int = 5) -> int:
    """Saves ``make(last version or None)`` as the next version, and returns its number."""
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(_path(spark, path).toUri(), spark._jsc.hadoopConfiguration())
    no_options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
    for _ in range(tries):
        found = versions(spark, path)
        n = found[-1] + 1 if found else 0
        beside = f"{path}/new-{uuid.uuid4().hex}"
        make(read_version(spark, path, n - 1) if found else None).write.parquet(beside)
        try:
            context.rename(_path(spark, beside), _path(spark, f"{path}/v{n}"), no_options)
            return n
        except Exception as e:  # the number is taken
            context.delete(_path(spark, beside), True)
            if "FileAlreadyExists" not in str(e):
                raise
    raise RuntimeError(f"{path}: {tries} saves came in between")


def save_panel(spark: SparkSession, path: str, rows: DataFrame, keys: list[str], at) -> int:  # noqa: ANN001
    """A panel with ``rows`` put in by key, stamped ``updated_at``; its version."""

    def make(old: DataFrame | None) -> DataFrame:
        new = rows.withColumn("updated_at", F.lit(at).cast("timestamp"))
        if old is None:
            return new
        kept = old.drop("updated_at").join(rows.select(*keys), keys, "left_anti").withColumn("updated_at", F.lit(at).cast("timestamp"))
        return kept.unionByName(new, allowMissingColumns=True)

    return commit(spark, path, make)


def append_history(spark: SparkSession, path: str, runs: DataFrame, lock: str | None = None, signature: str | None = None) -> int:
    """A history of reviews with those of ``runs`` that it doesn't hold yet, by ``generated_at`` and ``signature``; refused if ``lock`` names another catalog than ``signature``."""
    if lock is not None:
        enforce_lock(spark, lock, signature or "")
    keys = ["generated_at", "signature"]
    once = runs.dropDuplicates(keys)
    return commit(spark, path, lambda old: once if old is None else append_new(old, once, keys))


LOCK = "generated_at timestamp, schema string, policy string, catalog_file string, catalog_signature_sha256 string, lock_file string, source_hashes map<string, string>, config map<string, string>"


def write_lock(spark: SparkSession, path: str, signature: str, policy: str, catalog_file: str, source_hashes: dict[str, str], config: dict[str, str], at) -> int:  # noqa: ANN001
    """A lock on a catalog's signature, as a version of its own."""
    row = (at, "shock_catalog_lock_v1", policy, catalog_file, signature, path, source_hashes, config)
    return commit(spark, path, lambda _: spark.createDataFrame([row], LOCK))


def lock_signature(spark: SparkSession, path: str) -> str:
    """The signature that the last lock names; empty without one."""
    last = read_version(spark, path)
    row = None if last is None or "catalog_signature_sha256" not in last.columns else last.first()
    return (row["catalog_signature_sha256"] or "") if row else ""


def enforce_lock(spark: SparkSession, path: str, signature: str) -> None:
    """Raises unless the lock names this signature."""
    known = lock_signature(spark, path)
    if not known or known != signature:
        raise LockMismatch(f"{path}: {'no lock' if not known else 'the lock names ' + known}, the catalog is {signature or 'unsigned'}")
