"""Raw CSV rows of any known layout to canonical records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import (
    event_time,
    nullify_missing,
    port_number,
    protocol_name,
    python_strip,
    record_message,
    tolerant_long,
)
from ..schema import ALIASES, LOG_SCHEMA, TAGS, UNKNOWN
from ..session import materialize
from ..sources.csv_files import Layout
from .preview import sample_cap

OFFSETS = 2_000_000


def normalize_csv(
    layouts: list[Layout], max_rows: int | None = None, month_first: bool = False
) -> DataFrame:
    """Canonical records of all files in ``layouts``.

    ``id`` is ``<file>:<row>``, so reading a file again gives the same ids.
    ``max_rows`` keeps a random sample per file (off by default).
    """
    layouts = [layout for layout in layouts if layout.header]
    if not layouts:
        raise ValueError("no CSV files with a header")
    numbered = [_fields(lay, month_first) for lay in layouts if lay.numbered]
    others = [lay for lay in layouts if not lay.numbered]
    if others:
        rows = reduce(DataFrame.unionByName, [_fields(lay, month_first) for lay in others])
        numbered.append(_numbered(rows, reduce(DataFrame.unionByName, [_blocks(lay) for lay in others])))
    records = _records(reduce(DataFrame.unionByName, numbered))
    return records if max_rows is None else sample_cap(records, max_rows)


def _fields(layout: Layout, month_first: bool) -> DataFrame:
    nothing = F.lit(None).cast("string")
    cells = {field: _cells(layout, names) for field, names in ALIASES.items()}
    parts = layout.rows.select(
        "source_file",
        *layout.place,
        *[
            F.coalesce(*[value for _, value in found], nothing).alias(field)
            for field, found in cells.items()
        ],
        F.coalesce(
            *[F.when(value.isNotNull(), F.lit(name)) for name, value in cells["bytes"]], nothing
        ).alias("bytes_source"),
    )
    typed = parts.select(
        "source_file",
        *layout.place,
        "timestamp",
        event_time(F.col("timestamp"), month_first).alias("event_ts"),
        "src_ip",
        "dst_ip",
        port_number(F.col("src_port")).alias("src_port"),
        port_number(F.col("dst_port")).alias("dst_port"),
        protocol_name(F.col("protocol")).alias("protocol"),
        tolerant_long(F.col("bytes")).alias("bytes"),
        "bytes_source",
        F.coalesce(python_strip(F.col("action")), F.lit(UNKNOWN)).alias("action"),
    )
    return typed.withColumn("message", record_message())


def _cells(layout: Layout, names: list[str]) -> list[tuple[str, Column]]:
    """The cells called ``names`` in order of preference, null when missing."""
    return [
        (name, nullify_missing(f"c{i}")) for name in names for i in _positions(layout.header, name)
    ]


def _positions(header: tuple[str, ...], name: str) -> list[int]:
    """Columns whose stripped name is ``name``; of repeated raw names the first."""
    first: dict[str, int] = {}
    for i, raw in enumerate(header):
        if raw.strip() == name:
            first.setdefault(raw, i)
    return list(first.values())


def _blocks(layout: Layout) -> DataFrame:
    """Rows per split of each file. Only counts lines; cells are not parsed."""
    return layout.rows.groupBy("source_file", "_path", "_block").agg(
        F.count("*").alias("_n"), F.min("_pos").alias("_first")
    )


def _numbered(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """Number the rows of each file without gathering a file in one task.

    A row's number is its position in its split plus the rows of the splits before. There is one offset row per split, known
    by a 64-bit hash of its file and place. Up to ``OFFSETS`` of them, 40 bytes each, are sent to the tasks, so that no row is
    shuffled; more are joined by split.
    """
    before = (
        Window.partitionBy("source_file")
        .orderBy("_path", "_block")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offset = F.coalesce(F.sum("_n").over(before), F.lit(0))
    key = F.xxhash64("_path", "_block").alias("_split")
    offsets = materialize(blocks.select(key, "_n", "_first", offset.alias("_offset")))
    known = offsets.agg(F.count("*"), F.count_distinct("_split")).first()
    if known[0] != known[1]:
        raise ValueError("two splits have one hash; read these files in two parts")
    if known[0] <= OFFSETS:
        offsets = F.broadcast(offsets)
    place = F.col("_pos") - F.col("_first")
    index = F.when((place >= 0) & (place < F.col("_n")), F.col("_offset") + place).otherwise(
        F.raise_error(F.lit("files changed while their rows were numbered")).cast("bigint")
    )
    # left: a split that was not counted fails the job instead of losing rows
    numbered = rows.withColumn("_split", F.xxhash64("_path", "_block")).join(offsets, "_split", "left")
    return numbered.withColumn("row_index", index).drop("_split", "_n", "_first", "_offset", "_path", "_block", "_pos")


def _records(numbered: DataFrame) -> DataFrame:
    return numbered.withColumns(
        {
            "id": F.concat("source_file", F.lit(":"), F.col("row_index").cast("string")),
            "tags": F.array(*[F.lit(t) for t in TAGS]),
        }
    ).select(*LOG_SCHEMA.fieldNames())
