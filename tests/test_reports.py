"""Report parsing, evidence, history and the file table."""

from __future__ import annotations

import json
from datetime import datetime, timedelta

import pytest

from flowlog.operators.catalog import file_inventory, mark_indexed, recent_files, upsert_files
from flowlog.operators.reports import auto_evidence, evidence_payload, parse_reports, query_history
from flowlog.sources.tables import append_history

FULL = {
    "risk_level": "HIGH",
    "summary": "s",
    "key_indicators": ["a", "b"],
    "recommended_actions": ["c"],
    "evidence_highlights": [{"id": "f.csv:3", "reason": "r"}],
}
TEXT = json.dumps(FULL, indent=1)


@pytest.mark.parametrize(
    "raw, status",
    [
        (TEXT, "ok"),
        (f"  \n{TEXT}\n ", "ok"),
        (f"```json\n{TEXT}\n```", "ok"),
        (f"```\n{TEXT}\n```\ntrailing ``` words", "ok"),
        (f"```json\n{TEXT}", "ok"),
        ("not json", "error"),
        ("```\nnot json\n```", "error"),
        ("{'risk_level': 'HIGH'}", "error"),
        ("", "error"),
        (None, "error"),
        ('{"risk_level": "LOW", "key_indicators": "text"}', "partial"),
        ('{"risk_level": "LOW"}', "ok"),
    ],
)
def test_parse(spark, raw, status):
    row = parse_reports(spark.createDataFrame([(1, raw)], "id long, raw string")).first()
    assert (row.id, row.status) == (1, status)
    if status == "error":
        assert row.raw == (None if raw is None else raw.replace("```", "").strip())
    elif raw and '"s"' in raw:
        assert row.asDict(recursive=True) == {"id": 1, "status": "ok", "raw": None, **FULL}
    else:
        assert (row.risk_level, row.key_indicators, row.raw) == ("LOW", None, None)


def test_evidence_payload(spark):
    queries = spark.createDataFrame([("q1", "why?"), ("q2", "none")], "query_id string, query string")
    hits = spark.createDataFrame(
        [("q1", 2, "b", 0.5, "doc b", ("x", 0)), ("q1", 1, "a", 0.25, "dóc a", ("y", 3))],
        "query_id string, rank int, id string, distance double, document string,"
        " metadata struct<src_ip: string, bytes: bigint>",
    )
    rows = {r.query_id: r for r in evidence_payload(hits, queries).collect()}
    assert rows["q1"].evidence_ids == ["a", "b"]
    assert json.loads(rows["q1"].payload) == {
        "query": "why?",
        "evidence": [
            {"id": "a", "distance": 0.25, "document": "dóc a", "metadata": {"src_ip": "y", "bytes": 3}},
            {"id": "b", "distance": 0.5, "document": "doc b", "metadata": {"src_ip": "x", "bytes": 0}},
        ],
    }
    assert json.loads(rows["q2"].payload) == {"query": "none", "evidence": []}
    assert rows["q2"].evidence_count == 0


def test_auto_evidence_limits_by_rows_of_the_file(spark):
    vectors = spark.createDataFrame(
        [(f"v{i}", [float(i), 0.0], f"d{i}", (f"f{i % 2}.csv",)) for i in range(30)],
        "id string, embedding array<float>, document string, metadata struct<source: string>",
    )
    files = spark.createDataFrame([("f0.csv", 3), ("f1.csv", 50)], "filename string, rows long")

    def embed(questions):
        return questions.selectExpr("*", "array(cast(0 as float), cast(0 as float)) AS embedding")

    rows = {r.query_id: r for r in auto_evidence(files, vectors, embed).collect()}
    assert rows["f0.csv"].evidence_ids == ["v0", "v1", "v2"]
    assert rows["f1.csv"].evidence_ids == [f"v{i}" for i in range(10)]
    assert rows["f0.csv"].query == "Analiziraj sigurnosne prijetnje u fajlu f0.csv"
    own = {r.query_id: r for r in auto_evidence(files, vectors, embed, only_file=True).collect()}
    assert own["f0.csv"].evidence_ids == ["v0", "v2", "v4"]


def test_history_round_trip(spark, tmp_path):
    path = str(tmp_path / "history")
    raw = spark.createDataFrame(
        [(1, TEXT), (2, "broken"), (3, '{"risk_level": "other"}')], "id long, raw string"
    ).selectExpr(
        "*", "timestamp_ntz'2024-01-01 00:00:00' + make_interval(0,0,0,id) AS queried_at",
        "'q' AS query", "5 AS top_k", "2 AS evidence_count",
    )
    append_history(parse_reports(raw.where("id < 3")), path)
    append_history(parse_reports(raw.where("id = 3")), path)
    rows = query_history(spark.read.parquet(path)).collect()
    assert [r.queried_at.day for r in rows] == [4, 3, 2]
    assert [r.risk_class for r in rows] == ["", "", "high"]
    assert [r.key_indicators for r in rows] == [[], [], ["a", "b"]]
    assert rows[1].risk_level is None and rows[1].summary is None


def test_history_shows_fifty(spark):
    start = datetime(2024, 1, 1)
    history = spark.createDataFrame(
        [(i, start + timedelta(hours=i), None, '["x"]', "LOW") for i in range(60)],
        "id long, queried_at timestamp_ntz, key_indicators string, recommended_actions string, risk_level string",
    )
    rows = query_history(history).collect()
    assert [r.id for r in rows] == list(range(59, 9, -1))
    assert (rows[0].key_indicators, rows[0].recommended_actions, rows[0].risk_class) == ([], ["x"], "low")
    assert len(query_history(history, 5).collect()) == 5


def test_file_table(spark):
    at = [datetime(2024, 1, d) for d in range(1, 6)]
    stored = spark.createDataFrame(
        [("a", at[0], 1, True), ("b", at[1], 2, False), ("c", at[2], 3, False)],
        "filename string, uploaded_at timestamp_ntz, rows long, indexed boolean",
    )
    new = spark.createDataFrame(
        [("a", at[4], 10), ("d", at[3], 4), ("e", at[3], 5)],
        "filename string, uploaded_at timestamp_ntz, rows long",
    )
    merged = upsert_files(stored, new)
    assert sorted(map(tuple, merged.collect())) == [
        ("a", at[0], 10, True),
        ("b", at[1], 2, False),
        ("c", at[2], 3, False),
        ("d", at[3], 4, False),
        ("e", at[3], 5, False),
    ]
    sources = spark.createDataFrame([("b",), ("b",), ("zzz",)], "source_file string")
    listed = file_inventory(merged, sources)
    assert [(r.filename, r.indexed) for r in listed.collect()] == [
        ("d", False),
        ("e", False),
        ("c", False),
        ("b", True),
        ("a", True),
    ]
    assert [r.filename for r in recent_files(mark_indexed(merged, sources), 2).collect()] == ["d", "e"]
