"""From a folder of CSV files to the stored tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.catalog import mark_indexed, upsert_files
from ..operators.normalize import normalize_csv
from ..operators.partials import partial_counts
from ..operators.reports import auto_evidence, parse_reports
from ..operators.vectors import embed_messages, fit_embedder, vector_records
from ..session import materialize
from ..sources.csv_files import read_log_csv
from ..sources.tables import (
    append_history,
    drop_sources,
    read_table,
    replace_source,
    replace_table,
    stored_sources,
    table_exists,
)

_FILES = "filename string, uploaded_at timestamp_ntz, rows bigint, indexed boolean"
#: Files that are listed in a partition filter; more are joined.
MAX_LISTED = 1000


@dataclass(frozen=True)
class Store:
    """Paths of the stored tables below one folder."""

    root: str

    @property
    def logs(self) -> str:
        return f"{self.root}/logs"

    @property
    def vectors(self) -> str:
        return f"{self.root}/vectors"

    @property
    def partials(self) -> str:
        """Counts per source file, see ``operators.partials``."""
        return f"{self.root}/partials"

    @property
    def files(self) -> str:
        return f"{self.root}/files"

    @property
    def history(self) -> str:
        return f"{self.root}/history"

    @property
    def model(self) -> str:
        return f"{self.root}/embedder"


#: Evidence rows to ``query_id, raw``: the text of a report on each, from a language model of the caller's.
Reporter = Callable[[DataFrame], DataFrame]


def ingest_csv(
    spark: SparkSession,
    paths: str | list[str],
    store: Store,
    model: PipelineModel | None = None,
    max_rows: int | None = None,
    recursive: bool = False,
    at: str | None = None,
    report: Reporter | None = None,
    month_first: bool = False,
    **reading,
) -> PipelineModel:
    """Normalize, store and embed all CSV files below ``paths``.

    Records of a file that was stored before are replaced; a file without rows
    loses its records. The vectors are built from the stored records of these
    files only, so the files are parsed once and no other partition is read; so are their partial counts.
    Without a ``model`` one is fitted on the stored log table and saved. With
    the time ``at`` the files are also entered in the stored file table, and with ``report`` each gets a first report from
    its own records, whose outcome is added to the history. ``reading`` are options of ``read_log_csv``.
    """
    if report is not None and at is None:
        raise ValueError("a history row needs the time of the upload")
    layouts = read_log_csv(spark, paths, recursive, **reading)
    files = materialize(reduce(DataFrame.unionByName, [layout.files for layout in layouts]))
    files = files.groupBy("source_file").agg(F.max("filled").alias("filled"))
    empty = files.where(~F.col("filled")).select("source_file")
    # folders of emptied files are deleted one by one, without a job
    names = (row.source_file for row in empty.toLocalIterator())
    if any(layout.header for layout in layouts):
        replace_source(normalize_csv(layouts, max_rows, month_first), store.logs)
    drop_sources(spark, store.logs, names)
    stored = read_table(spark, store.logs)
    if model is None:
        model = fit_embedder(stored, "message")
        model.write().overwrite().save(store.model)
    touched = _of_files(stored, files.where("filled"))
    replace_source(partial_counts(touched), store.partials)
    replace_source(embed_messages(vector_records(touched), model, "document"), store.vectors)
    for path in (store.partials, store.vectors):
        drop_sources(spark, path, (row.source_file for row in empty.toLocalIterator()))
    if at is not None:
        counted = touched.groupBy("source_file").agg(F.count("*").alias("rows"))
        none = empty.withColumn("rows", F.lit(0).cast("bigint"))
        _enter_files(spark, store, counted.unionByName(none), at, stored_sources(spark, store.logs))
    if report is not None:
        filled = files.where("filled").select(F.col("source_file").alias("filename"))
        record_reports(first_evidence(spark, store, model, filled), report, at, store)
    return model


def _of_files(table: DataFrame, files: DataFrame) -> DataFrame:
    """The rows of some source files: by partition filter if they are few, else by a join."""
    head = files.select("source_file").limit(MAX_LISTED + 1).collect()
    if len(head) <= MAX_LISTED:
        return table.where(F.col("source_file").isin(sorted(row.source_file for row in head)))
    return table.join(files.select("source_file"), "source_file", "left_semi")


def read_files(spark: SparkSession, store: Store) -> DataFrame:
    """The stored file table; empty before the first upload."""
    if table_exists(spark, store.files):
        return spark.read.schema(_FILES).parquet(store.files)
    return spark.createDataFrame([], _FILES)


def _enter_files(spark: SparkSession, store: Store, counted: DataFrame, at: str, stored: DataFrame) -> None:
    """Rewrite the stored file table, a row per file."""
    replace_table(register_upload(read_files(spark, store), counted, at, stored), store.files)


def record_reports(evidence: DataFrame, report: Reporter, at: str, store: Store) -> None:
    """Ask for a report on each row of evidence, parse it and add its outcome to the stored history.

    A row gets its number from what it says, so a repeated call adds rows with the same numbers.
    """
    asked = materialize(evidence)
    raw = asked.join(report(asked).select("query_id", "raw"), "query_id", "left").select(
        F.lit(at).cast("timestamp_ntz").alias("queried_at"),
        "query",
        F.col("evidence_count").alias("top_k"),
        "evidence_count",
        F.coalesce("raw", F.lit("")).alias("raw"),
    )
    append_history(parse_reports(raw), store.history)


def first_evidence(
    spark: SparkSession, store: Store, model: PipelineModel, filenames: list[str] | DataFrame, most: int = 10
) -> DataFrame:
    """Evidence for a first report on some stored files, each from its own records."""
    if not isinstance(filenames, DataFrame):
        filenames = spark.createDataFrame([(name,) for name in filenames], "filename string")
    files = read_files(spark, store).join(filenames.distinct(), "filename", "left_semi")
    vectors = _of_files(read_table(spark, store.vectors), filenames.select(F.col("filename").alias("source_file")))
    return auto_evidence(files, vectors, lambda asked: embed_messages(asked, model, "query"), most, only_file=True)


def register_upload(files: DataFrame, counted: DataFrame, at: str, stored: DataFrame) -> DataFrame:
    """The file table after an upload.

    ``counted`` has ``source_file, rows`` (see ``upload_preview``), ``at`` is
    the upload time, ``stored`` the sources with stored records.
    """
    new = counted.select(
        F.col("source_file").alias("filename"),
        F.lit(at).cast("timestamp_ntz").alias("uploaded_at"),
        "rows",
    )
    return mark_indexed(upsert_files(files, new), stored)
