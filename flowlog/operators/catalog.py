"""The table of uploaded files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import RECENT_FILES


def upsert_files(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Add files; a known name only gets its new row count.

    Both have ``filename, uploaded_at, rows``, ``stored`` also ``indexed``.
    """
    old = stored.select(
        "filename", F.col("uploaded_at").alias("_at"), F.col("rows").alias("_rows"), "indexed"
    )
    return old.join(new, "filename", "full").select(
        "filename",
        F.coalesce("_at", "uploaded_at").alias("uploaded_at"),
        F.coalesce("rows", "_rows").alias("rows"),
        F.coalesce("indexed", F.lit(False)).alias("indexed"),
    )


def mark_indexed(files: DataFrame, stored_sources: DataFrame) -> DataFrame:
    """Set ``indexed`` for files whose records are stored; never clears it.

    ``stored_sources`` has ``source_file``; the function of that name in
    ``sources.tables`` lists them without reading records.
    """
    names = stored_sources.select(F.col("source_file").alias("filename")).distinct()
    hits = names.withColumn("_stored", F.lit(True))
    already = F.coalesce(F.col("indexed"), F.lit(False)) if "indexed" in files.columns else F.lit(False)
    joined = files.join(hits, "filename", "left")
    return joined.withColumn("indexed", already | F.coalesce("_stored", F.lit(False))).drop("_stored")


def file_inventory(
    files: DataFrame, stored_sources: DataFrame | None = None, limit: int | None = None
) -> DataFrame:
    """Files, newest upload first; ``stored_sources`` refreshes the indexed flag."""
    listed = files if stored_sources is None else mark_indexed(files, stored_sources)
    newest = listed.orderBy(F.desc("uploaded_at"), "filename")
    return newest if limit is None else newest.limit(limit)


def recent_files(files: DataFrame, n: int = RECENT_FILES) -> DataFrame:
    return file_inventory(files, limit=n)
