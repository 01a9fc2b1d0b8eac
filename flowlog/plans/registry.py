"""One query per operator over the given tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import action_class, row_severity
from ..functions.scalars import iso_time
from ..operators import catalog, codes, compare, filters, frequent, ips, keywords, knn, latent, partials, preview, reports, stats, vectors
from ..operators.normalize import normalize_csv
from ..session import materialize, scratch_path
from ..sources import csv_files
from ..sources.csv_files import read_log_csv
from ..sources.events import logs_from_events
from ..sources.tables import append_history, read_table, replace_source
from ..streaming.risk import risk_by_window
from . import derived
from .ingest import Store, ingest_csv, read_files
from .reports import semantic_search

Query = Callable[[SparkSession, str], DataFrame]

AS_OF = datetime(2024, 1, 31)
MAX_JUDGED = 4_000_000  # hits of a report whose ids are sent to all tasks
RECORD = [
    "id",
    "source_file",
    "timestamp",
    "src_ip",
    "dst_ip",
    "src_port",
    "dst_port",
    "protocol",
    "bytes",
    "action",
    "message",
]


# folders of stored log tables and CSV uploads by data folder, see use_stored_logs
_stored: dict[str, str] = {}
_uploads: dict[str, str] = {}


def use_stored_logs(spark: SparkSession, sf_dir: str) -> None:
    """Store the logs of ``sf_dir`` once and let later queries read that table."""
    path = scratch_path(spark, "stored-logs")
    replace_source(logs_from_events(spark, sf_dir), path)
    _stored[sf_dir] = path


def write_uploads(spark: SparkSession, sf_dir: str) -> None:
    """Write the CSV files of ``sf_dir`` once and let later queries read those."""
    _uploads[sf_dir] = derived.write_csv_folder(logs_of(spark, sf_dir))


def _csv_folder(spark: SparkSession, sf_dir: str) -> str:
    return _uploads.get(sf_dir) or derived.write_csv_folder(logs_of(spark, sf_dir))


def logs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    if sf_dir in _stored:
        return read_table(spark, _stored[sf_dir])
    return logs_from_events(spark, sf_dir)


def _over_logs(operator: Callable[[DataFrame], DataFrame], *columns: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = operator(logs_of(spark, sf_dir))
        return out.select(*columns) if columns else out

    return run


def _clock(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(column)


def _joined(column: str) -> Column:
    return F.concat_ws("|", column).alias(column)


# ------------------------------------------------------- sources and tables


def _read_log_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per header line and how many of them have a source address."""
    folder = _csv_folder(spark, sf_dir)
    parts = []
    for layout in read_log_csv(spark, folder, recursive=True):
        if not layout.header:
            continue
        address = next(
            c for c, n in zip(layout.cells, layout.header) if n.strip() in ("Source IP", "src_ip", "src")
        )
        parts.append(
            layout.rows.agg(
                F.lit("|".join(n.strip() for n in layout.header)).alias("header"),
                F.count("*").alias("rows"),
                F.count(address).alias("with_source"),
            )
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _read_quoted_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cell of one file with line breaks in quotes, read in many splits, and the numbers of the rows."""
    folder = derived.write_quoted_csv(logs_of(spark, sf_dir))
    layout = read_log_csv(spark, folder, split_bytes=20_000)[0]
    cells = [F.col(c).alias(n) for c, n in zip(layout.cells, layout.header)]
    rows = layout.rows.select("row_index", *cells, csv_files.CORRUPT)
    return rows.select(
        F.col("id").cast("bigint").alias("id"),
        "row_index",
        F.col("action").alias("note"),
        F.coalesce("src_ip", F.lit("")).alias("src_ip"),
        F.col("bytes").cast("bigint").alias("bytes"),
        F.col(csv_files.CORRUPT).isNotNull().alias("corrupt"),
    )


def _normalize_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _csv_folder(spark, sf_dir)
    records = normalize_csv(read_log_csv(spark, folder, recursive=True))
    # file names are chosen by the writer, so they and the ids are left out
    kept = [c for c in RECORD if c not in ("id", "source_file", "timestamp")]
    return records.select(_clock("event_ts"), *kept, "bytes_source", _joined("tags"))


def _upload_preview(logs: DataFrame) -> DataFrame:
    seen = preview.upload_preview(logs, "id")
    return seen.select(
        "source_file",
        "rows",
        F.size("columns").alias("n_columns"),
        F.concat_ws("|", F.transform("preview", lambda r: r["message"])).alias("first_messages"),
    )


def _replace_source(logs: DataFrame) -> DataFrame:
    """Store everything, then replace two files by their SYN records."""
    path = scratch_path(logs.sparkSession, "logs")
    replace_source(logs, path)
    changed = logs.where(
        F.col("source_file").isin("capture_1.csv", "capture_2.csv") & (F.col("action") == "SYN")
    )
    replace_source(changed.withColumn("bytes", F.col("bytes") + 1), path)
    return read_table(logs.sparkSession, path).select(*RECORD)


def _append_history(logs: DataFrame) -> DataFrame:
    path = scratch_path(logs.sparkSession, "history")
    parsed = reports.parse_reports(derived.raw_reports(logs))
    append_history(parsed.where(F.col("status") == "ok"), path)
    append_history(parsed.where(F.col("status") != "ok"), path)
    stored = logs.sparkSession.read.parquet(path)
    return stored.groupBy("query", "risk_level", "key_indicators", "recommended_actions").agg(
        F.count("*").alias("count"), F.sum("evidence_count").alias("evidence")
    )


def _query_history(logs: DataFrame) -> DataFrame:
    newest = reports.query_history(derived.history_table(logs))
    return newest.select(
        "id",
        _clock("queried_at"),
        "query",
        "top_k",
        "risk_level",
        "risk_class",
        "summary",
        _joined("key_indicators"),
        F.size("recommended_actions").alias("n_actions"),
        "evidence_count",
    )


def _upsert_files(logs: DataFrame) -> DataFrame:
    merged = catalog.upsert_files(*derived.file_tables(logs))
    return merged.select("filename", _clock("uploaded_at"), "rows", "indexed")


def _file_inventory(logs: DataFrame) -> DataFrame:
    files = catalog.file_inventory(*derived.files_and_sources(logs))
    return files.select("filename", _clock("uploaded_at"), "rows", "indexed")


def _recent_files(logs: DataFrame) -> DataFrame:
    files, stored = derived.files_and_sources(logs)
    recent = catalog.recent_files(catalog.mark_indexed(files, stored))
    return recent.select("filename", _clock("uploaded_at"), "rows", "indexed")


def _upsert_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replace the vectors of labels under 5 by their mirror image, add copies."""
    stored = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(
        F.col("vec_id").alias("id"), "embedding", "label"
    )
    mirrored = stored.withColumn("embedding", F.reverse("embedding"))
    new = mirrored.where(F.col("label") < 5).unionByName(
        mirrored.where(F.col("label") >= 5).withColumn("id", -F.col("id") - 1)
    )
    merged = vectors.upsert_vectors(stored, new)
    return merged.select("id", "label", F.round(F.col("embedding")[0].cast("double"), 6).alias("first"))


def _sample_cap(logs: DataFrame) -> DataFrame:
    sample = preview.sample_cap(logs, 1000)
    return sample.groupBy("source_file").agg(
        F.count("*").alias("sampled"), F.count_distinct("id").alias("distinct_ids")
    )


def _vector_records(logs: DataFrame) -> DataFrame:
    return vectors.vector_records(logs).select("id", "document", "metadata.*")


# ------------------------------------------------------------------- search


def _filter_logs(logs: DataFrame) -> DataFrame:
    return filters.filter_logs(
        logs, src_ip="10.0.", dst_ip="168.1.", hours=240, protocol="tcp", action="ack", as_of=AS_OF
    )


def _filter_by_file(logs: DataFrame) -> DataFrame:
    return filters.filter_logs(logs, src_ip="0_0.%.1", source_file="capture_3.csv", hours=0, action="")


def _document_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest documents (by number) with both terms in their whole text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        F.col("doc_id").alias("id"),
        F.lit(None).cast("timestamp_ntz").alias("event_ts"),
        "text",
        "lang",
        "source",
        "n_chars",
    )
    hits = filters.keyword_search(docs, "THE src_", 25, ["text", "lang", "source"])
    return hits.select("id", "lang", "source", "n_chars")


def _keyword_search_batch(logs: DataFrame) -> DataFrame:
    return keywords.keyword_search_batch(logs, derived.keyword_queries(logs))


def _row_severity(logs: DataFrame) -> DataFrame:
    return logs.groupBy(
        row_severity(F.col("action"), F.col("dst_port")).alias("row_severity"),
        action_class(F.col("action")).alias("action_class"),
    ).agg(F.count("*").alias("count"))


# ------------------------------------------------------------------ vectors


def _embed_messages(logs: DataFrame) -> DataFrame:
    """Per message the size and length of its vector, and how many vectors it has: equal messages are embedded alike."""
    messages = logs.select("id", F.col("message").alias("document"))
    embedded = vectors.embed_messages(messages, vectors.fit_embedder(messages))
    squares = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return embedded.groupBy("document").agg(
        F.max(F.size("embedding")).alias("size"),
        F.round(F.sqrt(F.max(squares)), 3).alias("norm"),
        F.count_distinct("embedding").alias("vectors"),
        F.count("*").alias("count"),
    ).drop("document")


def _embed_latent(logs: DataFrame) -> DataFrame:
    """Size, length and number of the vectors of each message, in the reduced space of all messages."""
    texts = logs.select(F.col("message").alias("document"))
    embedded = latent.embed_latent(texts, latent.fit_latent(texts, rank=32, size=1024))
    squares = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return embedded.groupBy("document").agg(
        F.max(F.size("embedding")).alias("size"),
        F.round(F.sqrt(F.max(squares)), 3).alias("norm"),
        F.count_distinct("embedding").alias("vectors"),
        F.count("*").alias("count"),
    ).drop("document")


def _hits(found: DataFrame) -> DataFrame:
    return found.select(
        "query_id",
        "rank",
        "id",
        F.round("distance", 6).alias("distance"),
        "similarity",
        "document",
        F.col("metadata.src_ip").alias("src_ip"),
        F.col("metadata.bytes").alias("bytes"),
    )


def _keyword_search_many(logs: DataFrame) -> DataFrame:
    """The way for more queries than a plan can hold."""
    return keywords.keyword_search_batch(logs, derived.address_queries(logs), 3, compiled=0)


def _ingest_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read, store and embed CSV files in one call; then ask for a message of each protocol and action."""
    store = Store(scratch_path(spark, "ingested"))
    model = ingest_csv(spark, _csv_folder(spark, sf_dir), store, recursive=True, at="2024-02-01 08:00:00")
    found = read_table(spark, store.vectors)
    first = found.groupBy("metadata.protocol", "metadata.action").agg(F.min("document").alias("query"))
    hits = semantic_search(found, first.select(F.col("query").alias("query_id"), "query"), model, 1)
    files = read_files(spark, store).where("indexed").agg(
        F.sum("rows").alias("stored_rows"), F.max(iso_time(F.col("uploaded_at"))).alias("uploaded_at")
    )
    told = hits.select(F.col("query_id").alias("query"), F.round("distance", 6).alias("distance"), "similarity")
    return told.crossJoin(F.broadcast(files))  # one row


def _replaced(logs: DataFrame) -> DataFrame:
    """The records after one file was uploaded again, with its SYN records only."""
    return logs.where((F.col("source_file") != "capture_1.csv") | (F.col("action") == "SYN"))


def _dashboard_partials(logs: DataFrame) -> DataFrame:
    """The cube of stored counts, after those of one file were replaced."""
    path = scratch_path(logs.sparkSession, "partials")
    replace_source(partials.partial_counts(logs), path)
    replace_source(partials.partial_counts(_replaced(logs).where(F.col("source_file") == "capture_1.csv")), path)
    return partials.cube_of_partials(read_table(logs.sparkSession, path))


def _filter_newest(logs: DataFrame) -> DataFrame:
    return partials.filter_newest(logs, materialize(partials.partial_counts(logs)), 300, protocol="udp", action="ACK")


def _frequent_sources(logs: DataFrame) -> DataFrame:
    """The top source addresses by two passes over a bounded number of counters; fewer than there are addresses."""
    return frequent.most_frequent(logs, "src_ip", counters=40)


def _frequent_contacts(logs: DataFrame) -> DataFrame:
    """Pairs of addresses that talk most, ports included."""
    talk = F.concat_ws(" > ", "src_ip", "dst_ip", F.col("dst_port").cast("string"))
    return frequent.most_frequent(logs.where("src_ip is not null and dst_ip is not null").select(talk.alias("contact")), "contact", 20)


def _risk_windows(logs: DataFrame) -> DataFrame:
    flags = risk_by_window(logs.withColumn("event_time", F.col("event_ts").cast("timestamp")), "12 hours", "6 hours")
    return flags.select(_clock("start"), _clock("end"), *flags.columns[2:])


def _knn_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = derived.stored_vectors(logs_of(spark, sf_dir), sf_dir)
    return _hits(knn.knn_search(stored, derived.vector_queries(spark, sf_dir)))


def _knn_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search through the path for query tables of any size."""
    stored = derived.stored_vectors(logs_of(spark, sf_dir), sf_dir)
    return _hits(knn.knn_search(stored, derived.vector_queries(spark, sf_dir), max_queries=0))


def _knn_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of the approximate search: true distances, and nine in ten of the exact neighbours."""
    stored = materialize(derived.stored_vectors(logs_of(spark, sf_dir), sf_dir).select("id", "embedding"))
    queries = materialize(derived.vector_queries(spark, sf_dir))
    return recall_report(knn.knn_lsh(stored, queries), stored, queries)


def _knn_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of the search over codes that are stored by source file; two files were encoded with what the others taught."""
    stored = derived.stored_vectors(logs_of(spark, sf_dir), sf_dir).select("id", "embedding", F.col("metadata.source").alias("source_file"))
    stored = materialize(stored)
    late = F.col("source_file").isin("capture_2.csv", "capture_3.csv")
    model = codes.fit_codes(stored.where(~late))
    path = scratch_path(spark, "codes")
    replace_source(codes.encode_vectors(stored.where(~late), model), path)
    replace_source(codes.encode_vectors(stored.where(late), model), path)
    queries = materialize(derived.vector_queries(spark, sf_dir))
    return recall_report(codes.knn_codes(read_table(spark, path), queries, model), stored, queries)


def recall_report(hits: DataFrame, stored: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """Hits, false distances and recall of an approximate search."""
    hits = materialize(hits.select("query_id", "id", "distance"))
    # few of the vectors are hits; without the others the join shuffles no second copy of the whole table
    found = stored.select("id", "embedding")
    if hits.count() <= MAX_JUDGED:
        found = found.join(F.broadcast(hits.select("id").distinct()), "id", "left_semi")
    own = queries.select("query_id", F.col("embedding").alias("asked"))
    both = hits.join(found, "id").join(own, "query_id")
    gap = F.zip_with("embedding", "asked", lambda a, b: a.cast("double") - b.cast("double"))
    true = F.aggregate(F.transform(gap, lambda x: x * x), F.lit(0.0), lambda s, x: s + x)
    exact = knn.knn_search(stored, queries, k).select("query_id", "id", F.lit(True).alias("exact"))
    judged = both.withColumn("true", true).join(exact, ["query_id", "id"], "left")
    counted = judged.agg(
        F.count_distinct("query_id").alias("queries"),
        F.count("*").alias("hits"),
        F.count_if(F.abs(F.col("distance") - F.col("true")) > 1e-9).alias("wrong"),
        F.count("exact").alias("found"),
    )
    return counted.withColumn("nine_in_ten", F.col("found") >= 0.9 * k * F.col("queries")).drop("found")


def _compare_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = logs_of(spark, sf_dir)
    stored = derived.stored_vectors(logs, sf_dir)
    queries = materialize(derived.paired_queries(stored))
    keyword = keywords.keyword_search_batch(logs, queries, 5)
    return compare.compare_search(queries, keyword, knn.knn_search(stored, queries))


def _evidence_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = derived.stored_vectors(logs_of(spark, sf_dir), sf_dir)
    queries = materialize(derived.paired_queries(stored))
    payload = reports.evidence_payload(knn.knn_search(stored, queries), queries)
    return payload.select(
        "query_id",
        "query",
        "evidence_count",
        _joined("evidence_ids"),
        F.get_json_object("payload", "$.query").alias("payload_query"),
        F.get_json_object("payload", "$.evidence[0].metadata.source").alias("first_source"),
    )


def _auto_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence per source file; its question has the vector of the file's first record."""
    stored = derived.stored_vectors(logs_of(spark, sf_dir), sf_dir)
    files = stored.groupBy(F.col("metadata.source").alias("filename")).agg(
        F.count_if(F.col("metadata.action") == "PSH").alias("rows"),
        F.min_by("embedding", "id").alias("embedding"),
    )
    by_name = files.select(F.col("filename").alias("query_id"), "embedding")
    payload = reports.auto_evidence(
        files.select("filename", "rows"), stored, lambda q: q.join(by_name, "query_id")
    )
    return payload.select("query_id", "query", "evidence_count", _joined("evidence_ids"))


def _parse_reports(logs: DataFrame) -> DataFrame:
    parsed = reports.parse_reports(derived.raw_reports(logs))
    return parsed.select(
        "id",
        "status",
        "risk_level",
        "summary",
        _joined("key_indicators"),
        _joined("recommended_actions"),
        F.concat_ws("|", "evidence_highlights.id").alias("highlight_ids"),
        F.concat_ws("|", "evidence_highlights.reason").alias("highlight_reasons"),
        "raw",
    )


def _dashboard_totals(logs: DataFrame) -> DataFrame:
    files, stored = derived.files_and_sources(logs)
    return stats.dashboard_totals(logs, catalog.mark_indexed(files, stored), derived.history_table(logs))


QUERIES: dict[str, Query] = {
    "read_log_csv": _read_log_csv,
    "read_quoted_csv": _read_quoted_csv,
    "normalize_csv": _normalize_csv,
    "upload_preview": _over_logs(_upload_preview),
    "replace_source": _over_logs(_replace_source),
    "upsert_files": _over_logs(_upsert_files),
    "file_inventory": _over_logs(_file_inventory),
    "recent_files": _over_logs(_recent_files),
    "upsert_vectors": _upsert_vectors,
    "append_history": _over_logs(_append_history),
    "query_history": _over_logs(_query_history),
    "sample_cap": _over_logs(_sample_cap),
    "vector_records": _over_logs(_vector_records),
    "filter_logs": _over_logs(_filter_logs, *RECORD),
    "filter_logs_by_file": _over_logs(_filter_by_file, *RECORD),
    "keyword_search": _over_logs(lambda x: filters.keyword_search(x, " syn 192.168.1.7 "), *RECORD),
    "keyword_search_wildcard": _over_logs(lambda x: filters.keyword_search(x, "t_p p%h", 50), *RECORD),
    "keyword_search_documents": _document_logs,
    "keyword_search_batch": _over_logs(_keyword_search_batch, "query_id", "rank", *RECORD),
    "keyword_search_many": _over_logs(_keyword_search_many, "query_id", "rank", *RECORD),
    "ingest_search": _ingest_search,
    "dashboard_totals": _over_logs(_dashboard_totals),
    "protocol_dist": _over_logs(stats.protocol_dist),
    "action_dist": _over_logs(stats.action_dist),
    "top_src_ips": _over_logs(stats.top_src_ips),
    "top_dst_ports": _over_logs(stats.top_dst_ports),
    "dashboard_cube": _over_logs(stats.dashboard_cube),
    "frequent_sources": _over_logs(_frequent_sources),
    "frequent_contacts": _over_logs(_frequent_contacts),
    "dashboard_partials": _over_logs(_dashboard_partials),
    "filter_newest": _over_logs(_filter_newest, *RECORD),
    "risk_windows": _over_logs(_risk_windows),
    "list_ips": _over_logs(stats.list_ips),
    "ip_profile": _over_logs(ips.ip_profile),
    "ip_actions": _over_logs(ips.ip_actions),
    "ip_dst_ports": _over_logs(ips.ip_dst_ports),
    "ip_src_ports": _over_logs(ips.ip_src_ports),
    "ip_contacts": _over_logs(ips.ip_contacts),
    "ip_risk": _over_logs(ips.ip_risk),
    "ip_records": _over_logs(ips.ip_records, "ip", "rank", *RECORD),
    "row_severity": _over_logs(_row_severity),
    "compare_search": _compare_search,
    "embed_messages": _over_logs(_embed_messages),
    "embed_latent": _over_logs(_embed_latent),
    "knn_search": _knn_search,
    "knn_search_cells": _knn_cells,
    "knn_lsh": _knn_lsh,
    "knn_codes": _knn_codes,
    "evidence_payload": _evidence_payload,
    "auto_evidence": _auto_evidence,
    "parse_reports": _over_logs(_parse_reports),
}
