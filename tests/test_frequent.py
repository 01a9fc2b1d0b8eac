"""Top lists by two passes."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flowlog.operators import frequent
from flowlog.operators.frequent import Counters, most_frequent, sketch


def test_counters_are_too_low_by_what_was_lost():
    rng = np.random.default_rng(2)
    table, true = Counters(40), Counter()
    for _ in range(60):
        values = np.minimum(rng.zipf(1.3, 200), 3000)
        found, counts = np.unique(values, return_counts=True)
        true.update(dict(zip(found.tolist(), counts.tolist(), strict=True)))
        table.add(pa.array(found), counts)
        assert len(table.counts) <= 40
    kept = dict(zip(table.values.to_pylist(), table.counts.tolist(), strict=True))
    assert all(true[v] - table.lost <= n <= true[v] for v, n in kept.items())
    assert all(true[v] <= table.lost for v in true if v not in kept)
    assert table.lost <= true.total() / 40


@pytest.fixture(scope="module")
def rows(spark):
    """A few hot values, one a third of all, among very many."""
    value = F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 7 == 0, F.concat(F.lit("w"), F.col("id") % 20))
    return spark.range(60_000).select(value.otherwise(F.concat(F.lit("v"), F.xxhash64("id"))).alias("v")).repartition(5)


def plain(rows, n):
    top = rows.where("v is not null").groupBy("v").count().orderBy(F.desc("count"), "v").limit(n)
    return [tuple(r) for r in top.collect()]


def test_same_as_counting_all(rows, monkeypatch):
    assert [tuple(r) for r in most_frequent(rows, "v", 10, 2000).collect()] == plain(rows, 10)
    # ties at the end of the list, and values that no sketch can tell apart, are counted all
    assert [tuple(r) for r in most_frequent(rows, "v", 30, 50).collect()] == plain(rows, 30)
    assert most_frequent(rows.where("v is null"), "v").collect() == []
    numbers = rows.select(F.length("v").alias("v"))
    assert [tuple(r) for r in most_frequent(numbers, "v", 2).collect()] == plain(numbers, 2)


def test_shuffle_is_bounded_by_the_counters(spark, rows):
    found = sketch(rows, "v", 100)
    assert found.count() <= 5 * 101
    exact = rows.groupBy("v").count().count()
    assert exact > 20_000
    top = most_frequent(rows, "v", 5, 100)
    assert "v#" in top._jdf.queryExecution().toString() and [r.v for r in top.collect()][0] == "hot"
