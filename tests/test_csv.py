"""CSV files with all kinds of headers and cells."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from flowlog.functions import event_time, port_number, protocol_name, tolerant_long
from flowlog.operators.normalize import normalize_csv
from flowlog.operators.preview import upload_preview
from flowlog.schema import LOG_SCHEMA
from flowlog.sources.csv_files import (
    _header_lines_from_text,
    corrupt_counts,
    direct_uri,
    header_lines,
    raw_rows,
    read_log_csv,
)

FILES = {
    "flow-export.csv": " Source IP, Source Port, Destination IP, Destination Port, Protocol, Timestamp,"
    " Total Length of Fwd Packets, Label\n"
    "10.0.0.1,443.0,10.0.0.2,22,6,5/7/2017 8:55,12.7,DoS Hulk\n"
    "10.0.0.1,x,10.0.0.2,22,47,yesterday,Infinity, PSH\t\n",
    "generic.csv": "timestamp,src_ip,dst_ip,src_port,dst_port,protocol,bytes,action\n"
    "2024-01-01T10:00:00,1.1.1.1,2.2.2.2,1,2,tcp,1e3,SYN\n"
    "2024-01-01 10:00:00,1.1.1.1\n"
    "2024-01-01 10:00:00,1.1.1.1,2.2.2.2,1,2,NA,-1.9,SYN,extra,more\n",
    "generic 2.csv": "timestamp,src_ip,dst_ip,src_port,dst_port,protocol,bytes,action\n"
    "2024-01-03,7.7.7.7,2.2.2.2,1,2,udp,1,FIN\n",
    "reord+er.csv": "action,bytes,protocol,dst_port,src_port,dst_ip,src_ip,timestamp\n"
    "ACK,5,17.0,80,9,3.3.3.3,4.4.4.4,2024-01-02\n",
    "short.csv": "time,src,dst,sport,dport,proto,len,flag\n2024-01-01 1:00,a,b,1,2,0,nan,RST\n",
    "case-clash.csv": "Timestamp,timestamp,Label,label,src_ip\n,2024-02-02 00:00:00,,low,5.5.5.5\n",
    "duplicate.csv": "src,src,dst\na,b,c\n,b,c\n",
    "my capture [1].CSV": '\n\ufefftime,src,flag\n2024-01-01,z,"quo""ted, x"\n',
    "only header.csv": "src,dst\n\n",
    "notes.txt": "src,dst\n1,2\n",
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("uploads")
    for name, text in FILES.items():
        (root / name).write_text(text)
    return str(root)


@pytest.fixture(scope="module")
def records(spark, folder):
    rows = normalize_csv(read_log_csv(spark, folder)).collect()
    return {r.id: r for r in rows}


def test_schema_is_canonical(spark, folder):
    out = normalize_csv(read_log_csv(spark, folder))
    assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in LOG_SCHEMA]


def test_ids_are_file_and_row(records):
    assert sorted(records) == [
        "case-clash.csv:0",
        "duplicate.csv:0",
        "duplicate.csv:1",
        "flow-export.csv:0",
        "flow-export.csv:1",
        "generic.csv:0",
        "generic.csv:1",
        "generic.csv:2",
        "generic_2.csv:0",
        "my_capture_[1].CSV:0",
        "reord+er.csv:0",
        "short.csv:0",
    ]


def test_padded_headers_numbers_and_times(records):
    first, second = records["flow-export.csv:0"], records["flow-export.csv:1"]
    assert first.message == "TCP DoS Hulk from 10.0.0.1:443 to 10.0.0.2:22, bytes=12"
    assert first.event_ts == datetime(2017, 7, 5, 8, 55)
    assert first.bytes_source == "Total Length of Fwd Packets"
    assert first.tags == ["network", "log"]
    assert (second.src_port, second.protocol, second.bytes, second.action) == (None, "47", None, "PSH")
    assert (second.timestamp, second.event_ts) == ("yesterday", None)


def test_layouts_are_not_mixed_up(records):
    assert records["generic.csv:0"].src_ip == "1.1.1.1"
    assert records["generic_2.csv:0"].src_ip == "7.7.7.7"
    reordered = records["reord+er.csv:0"]
    assert (reordered.src_ip, reordered.dst_ip, reordered.protocol) == ("4.4.4.4", "3.3.3.3", "UDP")
    assert records["short.csv:0"].message == "HOPOPT RST from a:1 to b:2, bytes=None"


def test_names_differing_in_case_and_repeated_names(records):
    clash = records["case-clash.csv:0"]
    assert (clash.timestamp, clash.action) == ("2024-02-02 00:00:00", "low")
    assert records["duplicate.csv:0"].src_ip == "a"
    assert records["duplicate.csv:1"].src_ip is None


def test_quotes_blank_lines_and_file_names(records):
    assert records["my_capture_[1].CSV:0"].action == 'quo"ted, x'


def test_wrong_cell_counts_are_kept_and_counted(spark, folder, records):
    assert records["generic.csv:1"].dst_ip is None
    assert records["generic.csv:2"].bytes == -1
    counts = {r.source_file: (r.rows, r.corrupt) for r in corrupt_counts(read_log_csv(spark, folder)).collect()}
    assert counts["generic.csv"] == (3, 2)
    assert counts["short.csv"] == (1, 0)
    strict = read_log_csv(spark, f"{folder}/generic.csv", fail_fast=True)[0]
    with pytest.raises(Exception, match="(?i)malformed"):
        strict.rows.collect()


def test_files_without_rows_are_known(spark, folder):
    empty = [name for layout in read_log_csv(spark, folder) for name in layout.empty]
    assert empty == ["only_header.csv"]


def test_header_scan_through_spark_agrees(spark, folder):
    direct = {(r.path, r.header, r.filled) for r in header_lines(spark, folder).collect()}
    assert direct == {(r.path, r.header, r.filled) for r in _header_lines_from_text(spark, folder, False).collect()}
    assert len(direct) == len(FILES) - 1


def test_rows_are_numbered_across_splits(spark, tmp_path):
    lines = [f"10.0.0.{i % 250},{i}" for i in range(20_000)]
    (tmp_path / "big.csv").write_text("src,len\n" + "\n".join(lines) + "\n")
    (tmp_path / "small.csv").write_text("src,len\n1.1.1.1,0\n1.1.1.1,1\n")
    setting = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "20000")
    try:
        layouts = read_log_csv(spark, str(tmp_path), multi_line=False)
        assert layouts[0].rows.rdd.getNumPartitions() > 5
        wrong = normalize_csv(layouts).where("row_index <> bytes")
        assert normalize_csv(layouts).count() == 20_002
        assert wrong.count() == 0
    finally:
        spark.conf.set(setting, before)


def test_sample_is_per_file_and_repeatable(spark, folder):
    layouts = read_log_csv(spark, folder)
    sample = normalize_csv(layouts, max_rows=1)
    assert sample.groupBy("source_file").count().where("count <> 1").count() == 0
    assert sample.count() == 8
    ids = {r.id for r in sample.collect()}
    assert ids == {r.id for r in normalize_csv(layouts, max_rows=1).collect()}


def test_preview_of_raw_rows(spark, folder):
    layout = next(x for x in read_log_csv(spark, folder) if "duplicate.csv" in x.sources)
    row = upload_preview(raw_rows(layout), "row_order").first()
    assert (row.source_file, row.rows, row.columns) == ("duplicate.csv", 2, ["src", "src.1", "dst"])
    assert [tuple(r) for r in row.preview] == [("a", "b", "c"), (None, "b", "c")]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("6", "TCP"),
        ("6.0", "TCP"),
        (" 17 ", "UDP"),
        ("1", "ICMP"),
        ("0", "HOPOPT"),
        ("47", "47"),
        ("99999999999", "99999999999"),
        (" tcp\t", "TCP"),
        ("Infinity", "INFINITY"),
        (None, "UNKNOWN"),
    ],
)
def test_protocols(spark, text, expected):
    df = spark.createDataFrame([(text,)], "x string")
    assert df.select(protocol_name(F.col("x"))).first()[0] == expected


def test_numbers(spark):
    cases = {
        "12.7": 12,
        "-1.9": -1,
        "1e3": 1000,
        " 5 ": 5,
        ".5": 0,
        "7.": 7,
        "Infinity": None,
        "1e30": None,
        "12d": None,
        "0x10": None,
        "x": None,
        "": None,
        None: None,
    }
    df = spark.createDataFrame([(c,) for c in cases], "x string")
    got = {r.x: r.n for r in df.select("x", tolerant_long(F.col("x")).alias("n")).collect()}
    assert got == cases
    wide = spark.createDataFrame([("3000000000",)], "x string")
    assert wide.select(port_number(F.col("x"))).first()[0] is None


def test_times(spark):
    cases = {
        "5/7/2017 8:55": datetime(2017, 7, 5, 8, 55),
        "05/07/2017 08:55:01": datetime(2017, 7, 5, 8, 55, 1),
        "5/7/2017": datetime(2017, 7, 5),
        "2024-01-01T10:00:00": datetime(2024, 1, 1, 10),
        "2024-01-01 10:00:00.25": datetime(2024, 1, 1, 10, 0, 0, 250000),
        "31/31/2017 8:55": None,
        "1499244900": None,
        "yesterday": None,
        None: None,
    }
    df = spark.createDataFrame([(c,) for c in cases], "x string")
    got = {r.x: r.t for r in df.select("x", event_time(F.col("x")).alias("t")).collect()}
    assert got == cases
    us = spark.createDataFrame([("5/7/2017 8:55",)], "x string")
    assert us.select(event_time(F.col("x"), month_first=True)).first()[0] == datetime(2017, 5, 7, 8, 55)


def test_line_breaks_in_quotes_belong_to_their_cell(spark, tmp_path):
    text = 'src,len,flag\n1.1.1.1,1,SYN\n2.2.2.2,2,"two\nlines"\n3.3.3.3,3,ACK\n'
    (tmp_path / "a.csv").write_text(text)
    rows = normalize_csv(read_log_csv(spark, str(tmp_path))).orderBy("row_index").collect()
    assert [(r.id, r.src_ip, r.bytes, r.action) for r in rows] == [
        ("a.csv:0", "1.1.1.1", 1, "SYN"),
        ("a.csv:1", "2.2.2.2", 2, "two\nlines"),
        ("a.csv:2", "3.3.3.3", 3, "ACK"),
    ]
    with pytest.raises(Exception, match="line break in quotes"):
        read_log_csv(spark, str(tmp_path), multi_line=False)[0].rows.collect()


def test_blank_and_missing_headers(spark, tmp_path):
    (tmp_path / "tabs.csv").write_text("\t\t\nsrc,dst\n1,2\n")
    (tmp_path / "nothing.csv").write_text("")
    direct = {(r.path, r.header) for r in header_lines(spark, str(tmp_path)).collect() if r.header}
    assert direct == {(r.path, r.header) for r in _header_lines_from_text(spark, str(tmp_path), False).collect()}
    assert {h for _, h in direct} == {"src,dst"}
    layouts = read_log_csv(spark, str(tmp_path))
    assert [name for layout in layouts for name in layout.empty] == ["nothing.csv"]
    with pytest.raises(ValueError, match="no CSV files"):
        corrupt_counts([])


def test_object_store_names():
    assert direct_uri("s3a://bucket/x y.csv") == "s3://bucket/x y.csv"
    assert direct_uri("abfss://c@account/x.csv") == "abfss://c@account/x.csv"
