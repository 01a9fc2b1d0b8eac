"""Mergeable counts, the newest records by them, and risk flags in windows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from flowlog.operators.filters import filter_logs
from flowlog.operators.ips import ip_risk
from flowlog.operators.partials import cube_of_partials, filter_newest, newest_bound, partial_counts
from flowlog.operators.stats import dashboard_cube
from flowlog.sources.events import logs_from_events
from flowlog.sources.tables import read_table, replace_source
from flowlog.streaming.risk import risk_by_window, watch_risk

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("partials")
    logs = logs_from_events(spark, SF)
    replace_source(logs, f"{root}/logs")
    replace_source(partial_counts(logs), f"{root}/partials")
    return root


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_cube_after_a_file_was_replaced(spark, stored, tmp_path):
    logs = read_table(spark, f"{stored}/logs")
    path = str(tmp_path / "partials")
    replace_source(partial_counts(logs), path)
    assert rows(cube_of_partials(read_table(spark, path))) == rows(dashboard_cube(logs))
    new = logs.where("source_file = 'capture_2.csv' AND action <> 'ACK'").withColumn("dst_port", F.lit(99))
    plan = partial_counts(new)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(source_file" in plan and "capture_2.csv" in plan
    replace_source(partial_counts(new), path)
    whole = logs.where("source_file <> 'capture_2.csv'").unionByName(new)
    assert rows(cube_of_partials(read_table(spark, path), 3)) == rows(dashboard_cube(whole, 3))


@pytest.mark.parametrize(
    "limit, filters",
    [
        (5, {}),
        (500, {}),
        (2000, {}),
        (7, {"source_file": "capture_1.csv"}),
        (40, {"protocol": "tcp", "action": "SYN"}),
        (10, {"src_ip": "10.0.3."}),
        (3, {"dst_ip": "nowhere"}),
    ],
)
def test_newest_records_by_hours(spark, stored, limit, filters):
    logs, partials = read_table(spark, f"{stored}/logs"), read_table(spark, f"{stored}/partials")
    # ties in time, and records without one
    logs = logs.withColumn("event_ts", F.when(F.col("id") % 50 != 0, F.date_trunc("day", "event_ts")).cast("timestamp_ntz"))
    partials = partial_counts(logs) if limit % 2 else partials.unionByName(partials.limit(0))
    if not limit % 2:
        logs = read_table(spark, f"{stored}/logs")
    want = [r.id for r in filter_logs(logs, limit=limit, **filters).collect()]
    assert [r.id for r in filter_newest(logs, partials, limit, **filters).collect()] == want


def test_bound_reaches_the_scan(spark, stored):
    logs, partials = read_table(spark, f"{stored}/logs"), read_table(spark, f"{stored}/partials")
    bound = newest_bound(partials, 5)
    assert logs.where(F.col("event_ts") >= F.lit(bound)).count() >= 5
    assert logs.where(F.col("event_ts") >= F.lit(bound)).count() < 100
    assert newest_bound(partials, 10_000) is None
    recent = logs.where(F.col("event_ts") >= F.lit(bound.isoformat(sep=" ")).cast("timestamp_ntz"))
    plan = filter_logs(recent)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(event_ts" in plan.split("PushedFilters")[1]


def timed(logs):
    return logs.withColumn("event_time", F.col("event_ts").cast("timestamp"))


def test_one_window_over_all_is_the_batch_rule(spark):
    logs = logs_from_events(spark, SF)
    flags = risk_by_window(timed(logs), "3000 days", "3000 days").drop("start", "end")
    assert rows(flags) == rows(ip_risk(logs))


def test_flags_of_a_stream_with_late_records(spark, tmp_path):
    logs = logs_from_events(spark, SF).select("id", "event_ts", "src_ip", "dst_port", "action").orderBy("event_ts")
    start = logs.agg(F.min("event_ts")).first()[0]
    hour = F.floor((F.unix_timestamp(F.col("event_ts").cast("timestamp")) - int(start.timestamp())) / 3600)
    logs = logs.withColumn("hour", hour)
    folder, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    # every fifth record comes one file late, within the watermark
    part = F.floor(F.col("hour") / 24) + F.when(F.col("id") % 5 == 0, 1).otherwise(0)
    parts = logs.withColumn("part", part)
    last = parts.agg(F.max("part")).first()[0]

    def run():
        stream = spark.readStream.schema(logs.schema).option("maxFilesPerTrigger", 1).parquet(folder)
        query = watch_risk(stream, out, progress, late="3 days", length="24 hours", slide="12 hours")
        query = query.trigger(availableNow=True).start()
        assert query.awaitTermination(240) and query.exception() is None

    def arrive(rows_):
        rows_.drop("part").coalesce(1).write.mode("append").parquet(folder)

    middle = last // 2
    for n in range(0, last + 1, 5):
        arrive(parts.where((F.col("part") >= n) & (F.col("part") < n + 5) & (F.col("part") <= middle)))
    run()
    early = spark.read.parquet(out).count()
    run()  # a restart without new files repeats nothing
    assert spark.read.parquet(out).count() == early
    arrive(parts.where(F.col("part") > middle))
    # a record far ahead closes all windows
    arrive(parts.limit(1).withColumn("event_ts", F.expr("event_ts + interval 400 days")).withColumn("src_ip", F.lit("far")))
    run()
    found = spark.read.parquet(out)
    want = risk_by_window(timed(logs), "24 hours", "12 hours")
    assert rows(found.where("ip <> 'far'").select(*want.columns)) == rows(want)
    without_late = risk_by_window(timed(parts.where("id % 5 <> 0")), "24 hours", "12 hours")
    assert rows(without_late) != rows(want)
