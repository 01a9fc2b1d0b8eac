"""Stored tables: logs and vectors by source file, history by appending."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.reports import history_rows

# Characters that partition folder names hold as %XX.
_ESCAPED = r"""[\x01-\x1f\x7f"#%'*/:=?\\{\[\]^]"""


def replace_source(
    records: DataFrame, path: str, sources: Iterable[str] = (), spread: int | None = None
) -> None:
    """Write records, replacing all earlier ones of the source files they hold.

    Rows stay in the tasks that read them; each task sorts its rows by time, so
    row groups can be skipped on time filters. ``spread`` gathers small inputs:
    each file then goes to at most that many tasks. ``sources`` names files
    that must be emptied when they have no records.
    """
    spark = records.sparkSession
    rows = records
    if spread:
        rows = rows.repartition("source_file", F.pmod(F.xxhash64("id"), F.lit(spread)))
    in_order = ["source_file"] + [c for c in ("event_ts",) if c in records.columns]
    (
        rows.sortWithinPartitions(*in_order)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("source_file")
        .parquet(path)
    )
    drop_sources(spark, path, sources)


def drop_sources(spark: SparkSession, path: str, sources: Iterable[str]) -> None:
    """Delete the folders of some source files; no job runs."""
    for source in sources:
        system, folder = _filesystem(spark, f"{path.rstrip('/')}/source_file={_folder_name(source)}")
        system.delete(folder, True)


def _folder_name(value: str) -> str:
    """A partition value as it appears in a folder name."""
    return re.sub(_ESCAPED, lambda m: f"%{ord(m[0]):02X}", value)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A table written by :func:`replace_source`."""
    table = spark.read.parquet(path)
    if "source_file" not in table.columns:  # all sources were emptied
        return table.withColumn("source_file", F.lit(None).cast("string"))
    return table.withColumn("source_file", F.col("source_file").cast("string"))


def stored_sources(spark: SparkSession, path: str) -> DataFrame:
    """``source_file`` of every stored source, from the list of table files alone."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    return files.select(F.col("source_file").cast("string")).distinct()


def table_exists(spark: SparkSession, path: str) -> bool:
    """Whether a table that :func:`replace_table` writes is there; ends a swap that was interrupted."""
    system, target = _filesystem(spark, path)
    if system.exists(target):
        return True
    old = system.globStatus(_path(spark, f"{path.rstrip('/')}.old-*"))
    if old is None or not len(old):
        return False
    return bool(system.rename(old[0].getPath(), target)) or bool(system.exists(target))


def replace_table(rows: DataFrame, path: str) -> None:
    """Write a table anew, which ``rows`` may be made from; at any moment the old or the new one can be read or restored.

    The new one is written beside the old and then takes its name. Of two writers at a time the second fails, and has
    changed nothing.
    """
    spark, path = rows.sparkSession, path.rstrip("/")
    mark = uuid.uuid4().hex
    rows.write.parquet(f"{path}.new-{mark}")
    system, target = _filesystem(spark, path)
    new, old = _path(spark, f"{path}.new-{mark}"), _path(spark, f"{path}.old-{mark}")
    had = system.exists(target)
    if had and not system.rename(target, old):
        system.delete(new, True)
        raise RuntimeError(f"{path} is being replaced by another writer")
    if system.exists(target) or not system.rename(new, target):
        raise RuntimeError(f"{path} was replaced by another writer; its table is kept")
    if had:
        system.delete(old, True)


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _filesystem(spark: SparkSession, path: str):
    target = _path(spark, path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def append_history(reports: DataFrame, path: str) -> None:
    """Add one row per answered query to the history table."""
    history_rows(reports).write.mode("append").parquet(path)
