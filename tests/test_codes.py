"""Approximate search over stored codes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flowlog.operators import codes
from flowlog.operators.codes import encode_vectors, fit_codes, knn_codes
from flowlog.operators.knn import knn_search
from flowlog.session import materialize
from flowlog.sources.tables import read_table, replace_source


@pytest.fixture(scope="module")
def vectors(spark):
    """Vectors that are no copies, in three source files, and queries between them."""
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id").collect()
    base = np.array([r.embedding for r in e])
    points = np.concatenate([np.roll(base, -t, axis=1) for t in range(6)])
    rows = [(i, p.tolist(), f"f{i % 3}.csv", f"d{i}") for i, p in enumerate(points)]
    v = spark.createDataFrame(rows, "id long, embedding array<float>, source_file string, document string").repartition(6)
    asked = (0.75 * base + 0.25 * np.roll(base, -1, axis=0))[:300]
    q = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(asked)], "query_id int, embedding array<float>")
    return v.cache(), q.cache()


def pairs(df):
    return {(r.query_id, r.id): r.distance for r in df.collect()}


def test_new_files_are_encoded_without_refitting(spark, vectors, tmp_path, monkeypatch):
    v, q = vectors
    model = fit_codes(v.where("source_file <> 'f2.csv'"))
    path = str(tmp_path / "codes")
    replace_source(encode_vectors(v.where("source_file <> 'f2.csv'"), model), path)
    replace_source(encode_vectors(v.where("source_file = 'f2.csv'"), model), path)
    stored = read_table(spark, path)
    assert stored.count() == v.count() and stored.agg(F.max(F.length("code")), F.min(F.length("code"))).first() == (16, 16)
    exact = pairs(knn_search(v, q, 5))
    found = knn_codes(stored, q, model)
    assert found.columns == ["query_id", "rank", "id", "distance", "similarity", *[c for c in stored.columns if c in ("document", "source_file")]]
    got = pairs(found)
    assert len(got) == 5 * 300 and len(got.keys() & exact.keys()) >= 0.9 * len(exact)
    assert all(got[p] == pytest.approx(exact[p], abs=1e-9) for p in got.keys() & exact.keys())
    assert any(i % 3 == 2 for _, i in got)
    monkeypatch.setattr(codes, "MAX_QUERIES", 100)
    assert pairs(knn_codes(stored, q, model)) == got


def test_scan_reads_codes_only(spark, vectors, tmp_path):
    v, q = vectors
    model = fit_codes(v.where("id < 500"))
    path = str(tmp_path / "codes")
    replace_source(encode_vectors(v, model), path)
    found = codes._candidates(read_table(spark, path), q, model, 50)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:bigint,cell:smallint,code:binary>" in plan


def test_edges(spark, vectors):
    v, q = vectors
    few = v.where("id < 3").unionByName(v.where("id = 3").withColumn("embedding", F.lit(None).cast("array<float>")))
    model = fit_codes(few)
    coded = encode_vectors(few, model)
    assert coded.count() == 3
    assert pairs(knn_codes(coded, q.where("query_id < 2"), model)) == pytest.approx(pairs(knn_search(few, q.where("query_id < 2"))))
    assert knn_codes(coded, q.limit(0), model).count() == 0
    assert knn_codes(coded.where("id < 0"), q, model).count() == 0
    with pytest.raises(ValueError):
        fit_codes(v.limit(0))


def test_a_task_keeps_no_more_than_the_nearest(spark, vectors, monkeypatch):
    v, q = vectors
    model = fit_codes(v)
    coded = materialize(encode_vectors(v.select("id", "embedding"), model).coalesce(1))
    want = {tuple(r) for r in codes._candidates(coded, q, model, 7).collect()}
    monkeypatch.setattr(codes, "_bounds", lambda sample, q, share, most: np.full(len(q), np.inf, np.float32))
    monkeypatch.setattr(codes, "_STEP", 500)
    monkeypatch.setattr(codes, "_FOUND", 1000)
    tight = codes._candidates(coded, q, model, 7)
    assert {tuple(r) for r in tight.collect()} == want and len(want) == 7 * 300
    # what a task keeps between its batches: the nearest, and ids of these only
    kept = codes._Kept(3)
    limit = np.full(2, np.inf, np.float32)
    for near in ([5, 1, 4, 2], [3, 0, 9, 9]):
        first = kept.ids_from(pa.array([f"{x}" for x in near]))
        kept.add(np.array([0, 0, 0, 1]), np.arange(4) + first, np.array(near, np.float32))
        kept.reduce(limit)
    (rows, ids, near), = kept.parts()
    assert limit.tolist() == [3, np.inf]
    assert sorted(zip(rows.tolist(), ids.to_pylist(), near.tolist())) == [(0, "0", 0), (0, "1", 1), (0, "3", 3), (1, "2", 2), (1, "9", 9)]


def test_a_part_of_the_vectors_bounds_the_candidates(spark, vectors, monkeypatch):
    """The model's small sample would let several times as many candidates through as are wanted."""
    v, q = vectors
    model = fit_codes(v.where("id < 200"))
    coded = materialize(encode_vectors(v.select("id", "embedding"), model))
    found, scan = [], codes._scan

    def counted(*args):
        out = scan(*args)
        found.append(out.count())
        return out

    monkeypatch.setattr(codes, "_scan", counted)
    got = {tuple(r) for r in codes._candidates(coded, q, model, 100).collect()}
    assert len(found) == 2 and found[1] <= 4.5 * 100 * 300
    monkeypatch.setattr(codes, "_bounds", lambda sample, q, share, most: np.full(len(q), np.inf, np.float32))
    monkeypatch.setattr(codes, "SCAN_SHARE", 1 << 30)
    assert {tuple(r) for r in codes._candidates(coded, q, model, 100).collect()} == got and len(got) == 100 * 300
