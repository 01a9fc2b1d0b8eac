"""Counts, per-address reports and their plans."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from flowlog.functions import readable_bytes, risk_class, similarity_pct
from flowlog.operators import filters, ips, keywords, stats
from flowlog.operators.preview import sample_cap
from flowlog.plans.derived import keyword_queries
from flowlog.sources.events import logs_from_events
from flowlog.sources.tables import read_table, replace_source

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def logs(spark):
    return logs_from_events(spark, SF_DIR)


@pytest.fixture(scope="module")
def table(spark, logs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("logs") / "t")
    replace_source(logs, path)
    return read_table(spark, path)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_distributions_add_up(logs):
    for dist in (stats.protocol_dist, stats.action_dist):
        rows = dist(logs).collect()
        assert sum(r["count"] for r in rows) == 1000
        assert rows[0].pct == 100
        assert [r["count"] for r in rows] == sorted((r["count"] for r in rows), reverse=True)


def test_null_group_is_kept_in_distributions(spark):
    logs = spark.createDataFrame([(None,), (None,), ("TCP",)], "protocol string")
    assert [tuple(r) for r in stats.protocol_dist(logs).collect()] == [(None, 2, 100), ("TCP", 1, 50)]
    assert stats.protocol_dist(logs.limit(0)).count() == 0


def test_cube_equals_single_reports(logs):
    cube = {}
    for r in stats.dashboard_cube(logs).collect():
        cube.setdefault(r.dimension, {})[r.value] = r["count"]
    assert cube["total"] == {None: 1000}
    for name, report in {
        "protocol": stats.protocol_dist,
        "action": stats.action_dist,
        "src_ip": stats.top_src_ips,
        "dst_port": stats.top_dst_ports,
    }.items():
        assert cube[name] == {str(r[name]): r["count"] for r in report(logs).collect()}


def test_cube_keeps_null_groups(spark):
    logs = spark.createDataFrame(
        [(None, "x", None, None), ("TCP", "x", "a", 1)],
        "protocol string, action string, src_ip string, dst_port int",
    )
    got = sorted(map(str, ((r.dimension, r.value, r["count"]) for r in stats.dashboard_cube(logs).collect())))
    assert got == sorted(
        map(str, [("protocol", None, 1), ("protocol", "TCP", 1), ("action", "x", 2), ("src_ip", "a", 1),
                  ("dst_port", "1", 1), ("total", None, 2)])
    )


def test_ports_rank_by_number_on_ties(spark):
    logs = spark.createDataFrame(
        [("a", p, "x", "TCP") for p in range(1, 13)], "src_ip string, dst_port int, action string, protocol string"
    )
    top = sorted(int(r.value) for r in stats.dashboard_cube(logs).where("dimension = 'dst_port'").collect())
    assert top == list(range(1, 11))
    assert sorted(r.dst_port for r in ips.ip_dst_ports(logs).collect()) == top


def test_risk_rules(spark):
    rows = (
        # 22 is the eleventh port of "busy", so only the unrestricted rule sees it
        [("busy", p, "ACK") for p in range(1, 11) for _ in range(2)]
        + [("busy", 22, "ACK")]
        + [("syn", 1, "SYN"), ("syn", 2, "ACK"), ("syn", 3, "ACK")]
        + [("two", 1, "SYN"), ("two", 2, "SYN"), ("two", None, "SYN")]
        + [("rdp", 3389, "PSH")]
        + [("portless", None, "ACK")]
        + [(None, 22, "PSH")]
    )
    logs = spark.createDataFrame(rows, "src_ip string, dst_port int, action string")
    got = {r.ip: tuple(r)[1:] for r in ips.ip_risk(logs).collect()}
    assert got == {
        "busy": (False, False, False, False, True),
        "syn": (False, False, False, True, False),
        "two": (False, False, False, False, True),
        "rdp": (True, False, True, False, False),
        "portless": (False, False, False, False, True),
    }
    free = {r.ip: tuple(r)[1:] for r in ips.ip_risk(logs, top_n=None).collect()}
    assert free["busy"] == (False, True, False, False, False)


def test_records_of_a_hot_address(spark):
    rows = [(i, datetime(2024, 1, 1, 0, i % 60), "hot", "hot" if i % 2 else "cold") for i in range(500)]
    logs = spark.createDataFrame(rows, "id long, event_ts timestamp_ntz, src_ip string, dst_ip string")
    found = ips.ip_records(logs)
    assert {r.ip: r["count"] for r in found.groupBy("ip").count().collect()} == {"hot": 100, "cold": 100}
    assert found.groupBy("ip", "id").count().where("count > 1").count() == 0


def test_long_lists_of_a_hot_address(spark):
    rows = [(i, datetime(2024, 1, 1, 0, i % 60), "hot", f"10.0.{i % 7}.1") for i in range(4000)]
    logs = spark.createDataFrame(rows, "id long, event_ts timestamp_ntz, src_ip string, dst_ip string")
    newest = sorted(rows, key=lambda r: (r[1], r[0]), reverse=True)[:1500]
    found = ips.ip_records(logs, "hot", n=1500)
    assert [r.id for r in found.orderBy("rank").collect()] == [r[0] for r in newest]


def test_sample_is_the_lowest_hashes_of_each_file(spark):
    logs = spark.range(30_000).selectExpr("id", "if(id % 3 = 0, 'a', if(id < 100, 'c', 'b')) AS source_file")
    sample = sample_cap(logs, 5000).withColumn("h", F.xxhash64("id", F.lit(42))).collect()
    hashed = logs.withColumn("h", F.xxhash64("id", F.lit(42))).collect()
    for name in "abc":
        expected = sorted((r.h, r.id) for r in hashed if r.source_file == name)[:5000]
        assert sorted((r.h, r.id) for r in sample if r.source_file == name) == expected


def test_display_columns(spark):
    sizes = {None: "0 B", 0: "0 B", 1: "1 B", 1023: "1023 B", 1024: "1.0 KB", 1280: "1.3 KB",
             1048575: "1024.0 KB", 1048576: "1.0 MB", 10**10: "9536.7 MB"}
    df = spark.createDataFrame([(s,) for s in sizes], "x long")
    assert {r.x: r.t for r in df.select("x", readable_bytes(F.col("x")).alias("t")).collect()} == sizes
    near = {0.0: 100, 1.0: 50, 0.01: 100, 2.0: 0, 3.5: 0, 0.03: 99}
    df = spark.createDataFrame([(d,) for d in near], "x double")
    assert {r.x: r.t for r in df.select("x", similarity_pct(F.col("x")).alias("t")).collect()} == near
    df = spark.createDataFrame([("HIGH",), ("low",), (None,)], "x string")
    assert [r[0] for r in df.select(risk_class(F.col("x"))).collect()] == ["high", "", ""]
    assert [r[0] for r in df.select(risk_class(F.col("x"), "low")).collect()] == ["high", "low", "low"]


# ------------------------------------------------------------------- plans


def test_filters_reach_the_scan(table):
    text = plan(
        filters.filter_logs(
            table, src_ip="10.0", hours=3, protocol="tcp", source_file="capture_1.csv", as_of=datetime(2024, 1, 31)
        )
    )
    assert "TakeOrderedAndProject" in text
    scan = next(line for line in text.splitlines() if "FileScan" in line)
    assert "capture_1.csv" in scan.split("PartitionFilters:")[1].split("PushedFilters:")[0]
    pushed = scan.split("PushedFilters:")[1]
    assert "GreaterThanOrEqual(event_ts" in pushed
    assert "EqualTo(protocol,TCP)" in pushed
    assert "StringContains(src_ip,10.0)" in pushed


def test_one_address_reaches_the_scan(table):
    for part in (ips.ip_profile, ips.ip_records, ips.ip_actions, ips.ip_dst_ports, ips.ip_risk):
        text = plan(part(table, "10.0.0.1"))
        assert "EqualTo(src_ip,10.0.0.1)" in text.split("PushedFilters:")[1], part.__name__


def test_top_per_address_is_cut_before_the_shuffle(table):
    batch = keywords.keyword_search_batch(table, keyword_queries(table))
    for df in (ips.ip_dst_ports(table), ips.ip_records(table), batch):
        text = plan(df)
        assert "WindowGroupLimit" in text.split("Exchange hashpartitioning")[1]


def test_only_needed_columns_are_read(table):
    text = plan(stats.protocol_dist(table))
    assert "ReadSchema: struct<protocol:string>" in text
    assert "ReadSchema: struct<src_ip:string,dst_ip:string,bytes:bigint>" in plan(ips.ip_profile(table))


def test_single_scan_and_no_python_or_cartesian(table):
    frames = [
        ips.ip_profile(table),
        ips.ip_records(table),
        ips.ip_risk(table),
        stats.dashboard_cube(table),
        keywords.keyword_search_batch(table, keyword_queries(table)),
    ]
    for df in frames:
        text = plan(df)
        assert text.count("FileScan") == 1
        for node in ("Python", "Pandas", "InArrow", "Cartesian", "NestedLoop"):
            assert node not in text


def test_shared_aggregations_run_once(table):
    for df in (stats.protocol_dist(table), ips.ip_actions(table)):
        df.collect()
        assert "ReusedExchange" in plan(df)
