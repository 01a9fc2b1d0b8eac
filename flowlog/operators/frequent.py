"""Exact top lists of a column with very many values, without shuffling a row per value.

A first pass keeps a bounded table of counters in every task: when it overflows, all counters lose what the largest one left out has, so
a counter is too low by at most what was ever taken off. Added up over the tasks, the tables name the candidates and bound what any
other value can have. A second pass counts the candidates exactly. If the last of the list is beyond the bound, the list is the true one;
if not, the values are too even for any sketch, and all are counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import TOP_N
from ..session import materialize

COUNTERS = 10_000


class Counters:
    """At most ``size`` values with counts that are too low by ``lost`` at most."""

    def __init__(self, size: int):
        self.size, self.lost = size, 0
        self.values: pa.Array | None = None
        self.counts = np.zeros(0, np.int64)

    def add(self, values: pa.Array, counts: np.ndarray) -> None:
        if self.values is not None:
            values = pa.concat_arrays([self.values, values])
            counts = np.concatenate((self.counts, counts))
            coded = values.dictionary_encode()
            counts = np.bincount(coded.indices.to_numpy(), counts, minlength=len(coded.dictionary)).astype(np.int64)
            values = coded.dictionary
        if len(values) > self.size:
            largest = np.partition(counts, len(counts) - self.size - 1)[len(counts) - self.size - 1]
            kept = np.flatnonzero(counts > largest)
            values, counts = values.take(pa.array(kept)), counts[kept] - largest
            self.lost += int(largest)
        self.values, self.counts = values, counts


def sketch(rows: DataFrame, column: str, counters: int = COUNTERS) -> DataFrame:
    """``value, count, lost``: the counters of each task, and in a row without a value how much they may be too low."""
    kind = rows.schema[column].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Counters(counters)
        for batch in batches:
            found = pc.value_counts(batch.column(0).drop_null())
            if len(found):
                table.add(found.field("values"), found.field("counts").to_numpy())
        if table.values is not None:
            n = len(table.counts)
            values = pa.concat_arrays([table.values, pa.nulls(1, table.values.type)])
            numbers = pa.array(np.append(table.counts, 0)), pa.array(np.append(np.zeros(n, np.int64), table.lost))
            yield pa.RecordBatch.from_arrays([values, *numbers], ["value", "count", "lost"])

    return rows.select(column).mapInArrow(count, f"value {kind}, count bigint, lost bigint")


def most_frequent(rows: DataFrame, column: str, n: int = TOP_N, counters: int = COUNTERS) -> DataFrame:
    """``<column>, count``: the ``n`` most frequent values that are not null, ties by value; exact.

    What is shuffled is bounded by the counters of the tasks. ``counters`` should be well above ``n``.
    """
    tables = materialize(sketch(rows, column, counters))
    lost = tables.agg(F.coalesce(F.sum("lost"), F.lit(0))).first()[0]
    merged = tables.where("value is not null").groupBy("value").agg(F.sum("count").alias("least"))
    merged = materialize(merged.orderBy(F.desc("least"), "value").limit(counters + 1))
    # a value that is no candidate has at most what the first one left out has, and what was lost
    beyond = merged.orderBy(F.desc("least"), "value").offset(counters).agg(F.coalesce(F.max("least"), F.lit(0))).first()[0]
    candidates = merged.orderBy(F.desc("least"), "value").limit(counters).select(F.col("value").alias("candidate"))
    counted = rows.join(F.broadcast(candidates), F.col(column) == F.col("candidate"))
    counted = counted.groupBy(column).agg(F.count("*").alias("count"))
    top = materialize(counted.orderBy(F.desc("count"), column).limit(n))
    known = top.agg(F.count("*"), F.min("count")).first()
    if lost + beyond == 0 or (known[0] == n and known[1] > lost + beyond):
        return top.orderBy(F.desc("count"), column)
    every = rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("count"))
    return every.orderBy(F.desc("count"), column).limit(n)
