"""Session helpers: where intermediate tables go."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder shared by driver and executors, as named by the cluster.

    Only a session in one process (``local[...]``) that names none gets a temporary one, removed when the process ends.
    On a cluster such a folder would be another one on each machine, so that is an error.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        master = context.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="flowlog-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; :func:`remove_scratch` deletes what was written to such paths."""
    return f"{_scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def remove_scratch(spark: SparkSession) -> None:
    """Delete the scratch tables of this application, once no result that reads them is needed any more."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_scratch_root(spark))
    root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(root, True)


def _scratch_root(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/flowlog-{spark.sparkContext.applicationId}"


def materialize(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives executor loss and cuts the lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
