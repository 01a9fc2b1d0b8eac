"""Per-file previews and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import PREVIEW_ROWS, SAMPLE_ROWS
from .ranking import first_per_key

_RANGE_BITS = 16


def upload_preview(rows: DataFrame, order: str = "row_index", n: int = PREVIEW_ROWS) -> DataFrame:
    """Row count, column names and first ``n`` rows (as structs) of each file.

    Takes raw file rows or normalized records, with ``source_file`` and an
    ``order`` column.
    """
    shown = [c for c in rows.columns if c not in ("source_file", order) or c == "id"]
    counts = rows.groupBy("source_file").agg(F.count("*").alias("rows"))
    head = first_per_key(rows, ["source_file"], [order], n, order).withColumnRenamed("rank", "_r")
    # collects n rows per file
    row = F.struct("_r", F.struct(*[_named(c) for c in shown]).alias("row"))
    previews = head.groupBy("source_file").agg(F.array_sort(F.collect_list(row)).alias("_rows"))
    return counts.join(previews, "source_file").select(
        "source_file",
        "rows",
        F.array(*[F.lit(c) for c in shown]).alias("columns"),
        F.col("_rows.row").alias("preview"),
    )


def _named(column: str) -> Column:
    """A column whose name may hold dots, as CSV headers do."""
    return F.col("`" + column.replace("`", "``") + "`")


def sample_cap(
    records: DataFrame, max_rows: int = SAMPLE_ROWS, key: str = "id", seed: int = 42
) -> DataFrame:
    """A repeatable random sample of at most ``max_rows`` records per file.

    Records are ordered by a hash of their key. Counting hashes in ranges shows
    up to which range a file's sample reaches; only those records are ranked,
    so a huge file does not end up in one task.
    """
    hashed = F.xxhash64(key, F.lit(seed))
    part = F.shiftright(hashed, 64 - _RANGE_BITS)
    ranges = records.groupBy("source_file", part.alias("part")).agg(F.count("*").alias("n"))
    so_far = Window.partitionBy("source_file").orderBy("part")
    reach = (
        ranges.withColumn("before", F.sum("n").over(so_far) - F.col("n"))
        .where(F.col("before") < max_rows)
        .groupBy("source_file")
        .agg(F.max("part").alias("_reach"))
    )
    near = records.join(reach, "source_file").where(part <= F.col("_reach"))
    ranked = near.withColumn(
        "_r", F.row_number().over(Window.partitionBy("source_file").orderBy(hashed, key))
    )
    return ranked.where(F.col("_r") <= max_rows).select(*records.columns)
