"""Index CSV files as they arrive in a folder."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

from ..plans.ingest import Store, ingest_csv
from ..sources.csv_files import CSV_GLOB, glob_escape


def watch_uploads(
    spark: SparkSession,
    folder: str,
    store: Store,
    model: PipelineModel,
    checkpoint: str,
    files_per_batch: int = 1000,
    **options,
) -> DataStreamWriter:
    """A stream writer that ingests each new file once it is complete.

    Only names are streamed; each micro-batch runs the batch ingest over its
    files, so mixed headers are fine. A batch that is repeated after a failure
    replaces the same source files again, which makes the sink idempotent. The
    files are entered in the stored file table with the time of their batch; a file that is known keeps its first time.
    ``options`` are those of ``ingest_csv``.
    """
    arriving = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length long, content binary")
        .option("pathGlobFilter", CSV_GLOB)
        .option("maxFilesPerTrigger", files_per_batch)
        .load(folder)
        .select("path")
    )

    def index(batch: DataFrame, _: int) -> None:
        # at most files_per_batch names
        paths = [glob_escape(row.path) for row in batch.collect()]
        if paths:
            now = datetime.now(UTC).strftime("%Y-%m-%d %H:%M:%S")
            ingest_csv(batch.sparkSession, paths, store, model, at=now, **options)

    return arriving.writeStream.foreachBatch(index).option("checkpointLocation", checkpoint)
