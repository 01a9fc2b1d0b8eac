"""Filters and keyword search."""

from __future__ import annotations

from datetime import datetime

import pytest

from flowlog.operators import keywords
from flowlog.operators.compare import compare_search
from flowlog.operators.filters import filter_logs, keyword_search
from flowlog.operators.keywords import keyword_search_batch
from flowlog.sources.events import logs_from_events

ROWS = [
    (1, "a.csv", datetime(2024, 1, 1, 0), "10.0.0.1", "fe80::A1", "TCP", "SYN", "TCP SYN from 10.0.0.1"),
    (2, "a.csv", datetime(2024, 1, 1, 5), "10.0.0.12", "10.0.0.1", "UDP", "DoS Hulk", r"path C:\bin 50% x_y"),
    (3, "b.csv", datetime(2024, 1, 1, 9), None, "10.0.0.3", "TCP", "ack", "ÉCOLE tcp"),
    (4, "b.csv", None, "10.0.0.1", None, "47", "PSH", "plain"),
    (5, "b.csv", datetime(2024, 1, 1, 9), "10.0.0.9", "10.0.0.3", "TCP", "ACK", "50 xzy"),
]


@pytest.fixture(scope="module")
def logs(spark):
    return spark.createDataFrame(
        ROWS,
        "id long, source_file string, event_ts timestamp_ntz, src_ip string, dst_ip string,"
        " protocol string, action string, message string",
    )


def ids(df):
    return [r.id for r in df.collect()]


def test_no_filter_is_newest_first_with_nulls_last(logs):
    assert ids(filter_logs(logs)) == [5, 3, 2, 1, 4]
    assert ids(filter_logs(logs, src_ip="", protocol="", action="", hours=0, source_file="")) == [5, 3, 2, 1, 4]


def test_limit(logs):
    assert ids(filter_logs(logs, limit=2)) == [5, 3]


@pytest.mark.parametrize(
    "given, expected",
    [
        ({"src_ip": "0.0.1"}, [2, 1, 4]),
        ({"dst_ip": "a1"}, [1]),
        ({"src_ip": "10%9"}, [5]),
        ({"src_ip": "10_0"}, [5, 2, 1, 4]),
        ({"protocol": "tcp"}, [5, 3, 1]),
        ({"action": "dos hulk"}, [2]),
        ({"action": "ACK"}, [5, 3]),
        ({"source_file": "b.csv", "protocol": "TCP"}, [5, 3]),
        ({"hours": 4, "as_of": datetime(2024, 1, 1, 9)}, [5, 3, 2]),
    ],
)
def test_filters(logs, given, expected):
    assert ids(filter_logs(logs, **given)) == expected


def test_negative_hours(logs):
    with pytest.raises(ValueError):
        filter_logs(logs, hours=-1)


KEYWORDS = [
    ("", []),
    ("  \t ", []),
    (None, []),
    ("tcp", [5, 3, 1]),
    ("TCP 10.0.0.3", [5, 3]),
    ("10.0.0.3  tcp", [5, 3]),
    ("50%", [5, 2]),
    ("x_y", [5, 2]),
    ("c:\\BIN", [2]),
    ("\\", [2]),
    ("école", [3]),
    ("tcp nothing", []),
    ("hulk10.0.0.1", []),
    ("1%1", [2, 1, 4]),
]


@pytest.mark.parametrize("query, expected", KEYWORDS)
def test_keywords(logs, query, expected):
    assert ids(keyword_search(logs, query)) == expected


@pytest.mark.parametrize("compiled, automaton", [(100, 0), (3, 1 << 20), (3, 0)])
def test_batch_equals_single_queries(spark, logs, compiled, automaton, monkeypatch):
    monkeypatch.setattr(keywords, "AUTOMATON_BYTES", automaton)
    queries = spark.createDataFrame(list(enumerate(q for q, _ in KEYWORDS)), "query_id int, query string")
    queries = queries.unionByName(queries.selectExpr("query_id + 1000 AS query_id", "concat(query, ' ', query) AS query"))
    hits = keyword_search_batch(logs, queries, limit=2, compiled=compiled)
    assert hits.columns == [*logs.columns, "query_id", "rank"]
    got = {}
    for r in sorted(hits.collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append(r.id)
    once = {i: e[:2] for i, (_, e) in enumerate(KEYWORDS) if e}
    assert got == once | {i + 1000: e for i, e in once.items()}


def test_terms_are_found_together():
    sets = [("a", "abc"), ("abc", "b%c"), ("_",), ("bc",), ("x",), ("%",), ("c%a",)]
    matcher = keywords.TermMatcher(sets)
    found = lambda *fields: sorted(matcher.sets("\n".join(f for f in fields if f is not None), list(fields)))
    assert found("abc") == [0, 1, 2, 3, 5]
    assert found("ab", "c") == [2, 5]
    assert found("", None) == [5] and found(None) == []
    assert found("c\na") == [2, 5, 6] and found("c", "a") == [2, 5]


def test_many_queries_are_one_scan(spark, monkeypatch):
    logs = logs_from_events(spark, "/root/testdata/sf0.001")
    queries = spark.range(2000).selectExpr(
        "id AS query_id",
        "concat(element_at(array('syn', 'ACK', 't_p', 'u', '%', '1.1'), cast(id % 6 + 1 AS int)), ' 10.0.', id % 7) AS query",
    )
    hits = keyword_search_batch(logs, queries, 3)
    assert hits._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 1
    got = {}
    for r in hits.collect():
        got.setdefault(r.query_id, set()).add((r.rank, r.id))
    few = keyword_search_batch(logs, queries.where("query_id < 42"), 3)
    want = {}
    for r in few.collect():
        want.setdefault(r.query_id, set()).add((r.rank, r.id))
    assert want and {k: v for k, v in got.items() if k < 42} == want
    assert {k % 42 for k in got} == set(want)
    monkeypatch.setattr(keywords, "AUTOMATON_BYTES", 0)
    joined = {(r.query_id, r.rank, r.id) for r in keyword_search_batch(logs, queries, 3).collect()}
    assert joined == {(q, *hit) for q, hits in got.items() for hit in hits}


def test_batch_of_blank_queries(spark, logs):
    blank = spark.createDataFrame([(1, " ")], "query_id int, query string")
    hits = keyword_search_batch(logs, blank)
    assert hits.count() == 0
    assert {"query_id", "rank"} <= set(hits.columns)


def test_compare_verdicts(spark):
    queries = spark.createDataFrame([(i,) for i in range(6)], "query_id int")
    keyword = spark.createDataFrame(
        [(0, "a"), (0, "b"), (1, "a"), (2, "a"), (2, "b"), (3, "a"), (3, "a"), (5, "a"), (5, "b"), (5, "a")],
        "query_id int, message string",
    )
    semantic = spark.createDataFrame(
        [(0, "a"), (0, "b"), (1, "c"), (2, "a"), (3, "a"), (3, "a"), (5, "a"), (5, "b")],
        "query_id int, document string",
    )
    got = {r.query_id: tuple(r)[1:] for r in compare_search(queries, keyword, semantic).collect()}
    assert got == {
        0: (2, 2, 2, 0, "identical", "same"),
        1: (1, 1, 0, 1, "semantic_extra", "same"),
        2: (2, 1, 1, 0, "keyword_more", "less"),
        3: (2, 2, 1, 1, "semantic_extra", "same"),
        4: (0, 0, 0, 0, "identical", "same"),
        5: (3, 2, 2, 0, "keyword_more", "less"),
    }
