"""Structured filters and keyword search."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import contains_text, matches_all, search_terms
from ..schema import FILTER_LIMIT, SEARCH_COLUMNS


def _newest(df: DataFrame, limit: int) -> DataFrame:
    return df.orderBy(F.desc("event_ts"), F.desc("id")).limit(limit)


def filter_logs(
    logs: DataFrame,
    src_ip: str | None = None,
    dst_ip: str | None = None,
    hours: int | None = None,
    protocol: str | None = None,
    action: str | None = None,
    source_file: str | None = None,
    as_of: datetime | None = None,
    limit: int = FILTER_LIMIT,
) -> DataFrame:
    """Newest records that pass all given filters; blank or 0 means "any".

    Addresses match by substring, ``hours`` counts back from ``as_of``
    (now, in UTC, by default). Time and source file are compared with
    literals, so they prune row groups and partitions at the scan.
    """
    if hours is not None and hours < 0:
        raise ValueError("hours must not be negative")
    if src_ip:
        logs = logs.where(contains_text(F.col("src_ip"), src_ip))
    if dst_ip:
        logs = logs.where(contains_text(F.col("dst_ip"), dst_ip))
    if protocol:
        # stored protocols are upper case already, so the scan can use this
        logs = logs.where(F.col("protocol") == protocol.upper())
    if action:
        logs = logs.where(F.upper("action") == F.upper(F.lit(action)))
    if source_file:
        logs = logs.where(F.col("source_file") == source_file)
    if hours:
        if as_of is None:
            as_of = datetime.now(timezone.utc).replace(tzinfo=None)
        since = (as_of - timedelta(hours=hours)).isoformat(sep=" ")
        logs = logs.where(F.col("event_ts") >= F.lit(since).cast("timestamp_ntz"))
    return _newest(logs, limit)


def keyword_search(
    logs: DataFrame,
    query: str | None,
    limit: int = 10,
    columns: Sequence[str] = SEARCH_COLUMNS,
) -> DataFrame:
    """Newest records in which every term of ``query`` occurs, ignoring case."""
    terms = search_terms(query)
    if not terms:
        return logs.where(F.lit(False))
    return _newest(logs.where(matches_all(terms, columns)), limit)
