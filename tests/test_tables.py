"""Stored tables, the whole ingest and the folder watcher."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from flowlog.operators.vectors import fit_embedder
from flowlog.operators.partials import cube_of_partials
from flowlog.operators.stats import dashboard_cube
from flowlog.plans.ingest import Store, first_evidence, ingest_csv, read_files, register_upload
from flowlog.plans.reports import dashboard, ip_detail, retrieve_evidence, semantic_search
from flowlog.session import materialize, remove_scratch, scratch_path, shared_dir
from flowlog.sources.events import logs_from_events
from flowlog.functions.scalars import iso_time, stamped_name
from flowlog.sources.tables import read_table, replace_source, replace_table, stored_sources, table_exists
from flowlog.streaming.uploads import watch_uploads

HEADER = "timestamp,src_ip,dst_ip,src_port,dst_port,protocol,bytes,action\n"


def lines(ip, n):
    return HEADER + "".join(f"2024-01-0{i + 1},{ip},9.9.9.9,{i},22,6,{i},SYN\n" for i in range(n))


def stored(spark, path):
    return sorted((r.source_file, r.id) for r in read_table(spark, path).collect())


def test_replace_touches_only_its_sources_and_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(1, "a b.csv"), (2, "a b.csv"), (3, "c=%.csv")], "id long, source_file string")
    replace_source(rows, path)
    assert stored(spark, path) == [("a b.csv", 1), ("a b.csv", 2), ("c=%.csv", 3)]
    change = spark.createDataFrame([(9, "a b.csv")], "id long, source_file string")
    for _ in range(2):
        replace_source(change, path)
        assert stored(spark, path) == [("a b.csv", 9), ("c=%.csv", 3)]
    replace_source(change, path, sources=["c=%.csv"])
    assert stored(spark, path) == [("a b.csv", 9)]
    assert {r.source_file for r in stored_sources(spark, path).collect()} == {"a b.csv"}
    replace_source(rows, path, spread=4)
    assert len(stored(spark, path)) == 3


def test_emptied_sources_with_special_names(spark, tmp_path):
    path = str(tmp_path / "t")
    names = ["a (é+1) [x].csv", "b&c,d~'e.csv", "p%20q={r}^.csv", "keep.csv"]
    rows = spark.createDataFrame(list(enumerate(names)), "id long, source_file string")
    replace_source(rows, path)
    assert sorted(stored(spark, path)) == sorted((n, i) for i, n in enumerate(names))
    replace_source(rows.where("id = 3"), path, sources=names[:3])
    assert stored(spark, path) == [("keep.csv", 3)]
    assert {r.source_file for r in stored_sources(spark, path).collect()} == {"keep.csv"}


def test_source_and_time_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    replace_source(logs_from_events(spark, "/root/testdata/sf0.001"), path)
    table = read_table(spark, path)
    assert table.count() == 1000
    hit = table.where("source_file = 'capture_1.csv'")
    assert hit.count() == 250


def test_ingest_search_and_reingest(spark, tmp_path):
    folder, store = tmp_path / "in", Store(str(tmp_path / "store"))
    folder.mkdir()
    (folder / "one.csv").write_text(lines("1.1.1.1", 4))
    (folder / "two.csv").write_text(lines("2.2.2.2", 3).replace("src_ip", "src"))
    model = ingest_csv(spark, str(folder), store)
    assert read_table(spark, store.logs).count() == read_table(spark, store.vectors).count() == 7
    assert {r.id for r in read_table(spark, store.vectors).collect()} == {
        *(f"one.csv:{i}" for i in range(4)),
        *(f"two.csv:{i}" for i in range(3)),
    }

    # a file that shrinks leaves nothing behind, an emptied one neither
    (folder / "one.csv").write_text(lines("1.1.1.1", 2))
    (folder / "two.csv").write_text("")
    ingest_csv(spark, str(folder), store, model, at="2024-05-01 00:00:00")
    files = {r.filename: (r.rows, r.indexed) for r in read_files(spark, store).collect()}
    assert files == {"one.csv": (2, True), "two.csv": (0, False)}
    assert first_evidence(spark, store, model, ["one.csv"]).first().evidence_ids == ["one.csv:0", "one.csv:1"]
    for path in (store.logs, store.vectors):
        assert [i for _, i in stored(spark, path)] == ["one.csv:0", "one.csv:1"]
    cube = {tuple(r) for r in cube_of_partials(read_table(spark, store.partials)).collect()}
    assert cube == {tuple(r) for r in dashboard_cube(read_table(spark, store.logs)).collect()}

    questions = spark.createDataFrame([("q", "SYN from 1.1.1.1 port 22")], "query_id string, query string")
    vectors = read_table(spark, store.vectors)
    hits = semantic_search(vectors, questions, model, 5).collect()
    assert sorted(h.id for h in hits) == ["one.csv:0", "one.csv:1"]
    assert retrieve_evidence(vectors, questions, model).first().evidence_count == 2


def test_upload_is_registered(spark):
    files = spark.createDataFrame([], "filename string, uploaded_at timestamp_ntz, rows long, indexed boolean")
    counted = spark.createDataFrame([("a.csv", 3)], "source_file string, rows long")
    logs = spark.createDataFrame([("a.csv",)], "source_file string")
    once = register_upload(files, counted, "2024-01-01 00:00:00", logs.limit(0))
    assert [(r.rows, r.indexed) for r in once.collect()] == [(3, False)]
    again = register_upload(once, counted.withColumn("rows", F.lit(5)), "2025-01-01 00:00:00", logs)
    assert [(r.uploaded_at.year, r.rows, r.indexed) for r in again.collect()] == [(2024, 5, True)]


def test_watcher_indexes_new_files(spark, tmp_path):
    folder, store = tmp_path / "in", Store(str(tmp_path / "store"))
    folder.mkdir()
    model = fit_embedder(logs_from_events(spark, "/root/testdata/sf0.001"), "message")

    def run():
        writer = watch_uploads(spark, str(folder), store, model, str(tmp_path / "progress"))
        query = writer.trigger(availableNow=True).start()
        assert query.awaitTermination(120)

    (folder / "one [1].csv").write_text(lines("1.1.1.1", 2))
    run()
    (folder / "two.csv").write_text(lines("2.2.2.2", 3))
    run()
    assert read_table(spark, store.logs).groupBy("source_file").count().count() == 2
    assert read_table(spark, store.vectors).count() == 5
    files = {r.filename: (r.rows, r.indexed, r.uploaded_at is not None) for r in read_files(spark, store).collect()}
    assert files == {"one_[1].csv": (2, True, True), "two.csv": (3, True, True)}


def test_ingest_reports_and_reader_options(spark, tmp_path):
    folder, store = tmp_path / "in", Store(str(tmp_path / "store"))
    folder.mkdir()
    (folder / "one.csv").write_text(lines("1.1.1.1", 4))
    (folder / "two.csv").write_text(lines("2.2.2.2", 12))

    def report(evidence):
        level = F.when(F.col("evidence_count") > 5, "HIGH").otherwise("LOW")
        text = F.to_json(F.struct(level.alias("risk_level"), F.col("query").alias("summary")))
        return evidence.where("query_id <> 'one.csv'").select("query_id", text.alias("raw"))

    with pytest.raises(ValueError, match="time"):
        ingest_csv(spark, str(folder), store, report=report)
    ingest_csv(spark, str(folder), store, at="2024-05-01 10:00:00", report=report, split_bytes=50)
    rows = {r["query"].rsplit(" ", 1)[-1]: r for r in spark.read.parquet(store.history).collect()}
    assert {n: (r.top_k, r.risk_level, r.queried_at.hour) for n, r in rows.items()} == {
        "one.csv": (4, None, 10), "two.csv": (10, "HIGH", 10),
    }
    (folder / "two.csv").write_text(lines("2.2.2.2", 2) + "only one cell\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        ingest_csv(spark, str(folder), store, at="2024-05-02 10:00:00", fail_fast=True)


def test_replaced_table_is_never_lost(spark, tmp_path):
    path = str(tmp_path / "t")
    assert not table_exists(spark, path)
    replace_table(spark.range(3), path)
    replace_table(spark.read.parquet(path).withColumn("id", F.col("id") + 1), path)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [1, 2, 3]
    # a crash between the two renames
    (tmp_path / "t").rename(tmp_path / "t.old-1")
    assert table_exists(spark, path) and spark.read.parquet(path).count() == 3
    assert [p.name for p in tmp_path.iterdir()] == ["t"]


def test_times_as_text(spark):
    row = spark.sql("SELECT timestamp_ntz'2024-01-02 03:04:05.5' AS a, timestamp_ntz'2024-01-02 03:04:05' AS b, 'x y.csv' AS n")
    got = row.select(iso_time(F.col("a")), iso_time(F.col("b")), stamped_name(F.col("n"), F.col("b"))).first()
    assert tuple(got) == ("2024-01-02T03:04:05.500000", "2024-01-02T03:04:05", "20240102_030405_x_y.csv")


def test_pages(spark):
    logs = logs_from_events(spark, "/root/testdata/sf0.001")
    files = spark.createDataFrame(
        [("capture_0.csv", None, 250, True)], "filename string, uploaded_at timestamp_ntz, rows long, indexed boolean"
    )
    history = spark.createDataFrame([(1,)], "id long")
    page = dashboard(logs, files, history)
    assert page["totals"].first().asDict() == {
        "total_records": 1000,
        "total_files": 1,
        "indexed_files": 1,
        "total_queries": 1,
        "psh_count": page["totals"].first().psh_count,
    }
    assert page["recent_files"].count() == 1
    ip = "10.0.0.3"
    everyone, one = ip_detail(logs), ip_detail(logs, ip)
    for part in one:
        expected = everyone[part].where(F.col("ip") == ip)
        columns = [c for c in expected.columns if c != "tags"]
        assert sorted(map(str, expected.select(columns).collect())) == sorted(
            map(str, one[part].select(columns).collect())
        )


def test_shared_folder_comes_from_the_session(spark, tmp_path):
    before = spark.conf.get("spark.checkpoint.dir", None)
    folder = shared_dir(spark)
    assert folder == (before or folder)
    assert scratch_path(spark, "x") != scratch_path(spark, "x")
    assert scratch_path(spark, "x").startswith(folder)
    assert materialize(spark.range(5)).count() == 5


def test_a_cluster_must_name_its_shared_folder(monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session())


def test_scratch_tables_can_be_removed(spark):
    path = scratch_path(spark, "gone")
    spark.range(3).write.parquet(path)
    assert spark.read.parquet(path).count() == 3
    remove_scratch(spark)
    with pytest.raises(Exception, match="(?i)path"):
        spark.read.parquet(path)


def test_ingest_reads_only_the_partitions_of_its_files(spark, tmp_path):
    path = str(tmp_path / "t")
    replace_source(logs_from_events(spark, "/root/testdata/sf0.001"), path)
    touched = read_table(spark, path).where(F.col("source_file").isin(["capture_1.csv"]))
    plan = touched._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "capture_1.csv" in plan.split("PartitionFilters: [")[1].split("]")[0]
