"""Counts per source file that add up: a dashboard of a growing store, and where its newest records lie.

The counts of a file are replaced with the file, so a change reads that file's records only. They are far fewer than the records: a row
per file and value.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import FILTER_LIMIT, TOP_N
from ..session import materialize
from .filters import filter_logs
from .stats import best_lists

_DIMENSIONS = ["protocol", "action", "src_ip", "dst_port", "hour"]
_STEP = 8


def partial_counts(logs: DataFrame) -> DataFrame:
    """``source_file, dimension, value, count``: records per file by protocol, action, source address, destination port and
    hour, and in all."""
    rows = logs.select("source_file", *_DIMENSIONS[:-1], F.date_trunc("hour", "event_ts").alias("hour"))
    sets = [*(["source_file", d] for d in _DIMENSIONS), ["source_file"]]
    counts = rows.groupingSets(sets, "source_file", *_DIMENSIONS).agg(
        F.count("*").alias("count"), *[F.grouping(d).alias(f"_{d}") for d in _DIMENSIONS]
    )
    dimension = F.coalesce(*[F.when(F.col(f"_{d}") == 0, F.lit(d)) for d in _DIMENSIONS], F.lit("total"))
    value = F.coalesce(*[F.col(d).cast("string") for d in _DIMENSIONS])
    return counts.select("source_file", dimension.alias("dimension"), value.alias("value"), "count")


def cube_of_partials(partials: DataFrame, n: int = TOP_N) -> DataFrame:
    """What ``dashboard_cube`` says of the records that the partial counts are of."""
    counts = partials.where(F.col("dimension") != "hour").groupBy("dimension", "value")
    return best_lists(counts.agg(F.sum("count").alias("count")), n)


def newest_bound(partials: DataFrame, rows: int, source_file: str | None = None) -> datetime | None:
    """The latest full hour from which on there are at least ``rows`` records; None if there are fewer with a time."""
    hours = partials.where((F.col("dimension") == "hour") & F.col("value").isNotNull())
    if source_file:
        hours = hours.where(F.col("source_file") == source_file)
    # a row per hour, ordered by one task
    hours = hours.groupBy(F.col("value").cast("timestamp_ntz").alias("hour")).agg(F.sum("count").alias("n"))
    since = F.sum("n").over(Window.orderBy(F.desc("hour")))
    found = hours.withColumn("since", since).where(F.col("since") >= rows).agg(F.max("hour")).first()
    return found[0]


def filter_newest(
    logs: DataFrame, partials: DataFrame, limit: int = FILTER_LIMIT, source_file: str | None = None, **filters
) -> DataFrame:
    """:func:`filter_logs`, reading only the hours that can hold the newest hits.

    The first look goes back as far as ``limit`` records of any kind do. If fewer of these pass the filters, the next goes back
    over eight times as many, until there are enough or all were seen; so at most a seventh is read twice.
    """
    wanted = limit
    while True:
        bound = newest_bound(partials, wanted, source_file)
        if bound is None:
            return filter_logs(logs, limit=limit, source_file=source_file, **filters)
        recent = logs.where(F.col("event_ts") >= F.lit(bound.isoformat(sep=" ")).cast("timestamp_ntz"))
        found = materialize(filter_logs(recent, limit=limit, source_file=source_file, **filters))
        if found.count() == limit:
            return found.orderBy(F.desc("event_ts"), F.desc("id"))
        wanted *= _STEP
