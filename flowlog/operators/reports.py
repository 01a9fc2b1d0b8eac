"""Report input (evidence) and report output (parsed text, history)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import python_strip, risk_class
from ..schema import AUTO_QUESTION, HISTORY_COLUMNS, HISTORY_LIMIT, REPORT_SCHEMA
from .knn import knn_search, knn_within

_FENCE = r"(?U)^[\s\x1c-\x1f]*```"
_FENCED = rf"(?s){_FENCE}(?:json)?[\s\x1c-\x1f]*(.*?)[\s\x1c-\x1f]*(?:```.*)?$"


def evidence_payload(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """Per query the JSON text a report is written from.

    ``hits`` is a search result with ``rank, id, distance, document, metadata``,
    ``queries`` has ``query_id, query``. A query without hits gets an empty list.
    """
    hit = F.struct("rank", "id", "distance", "document", "metadata")
    found = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(hit)).alias("_hits"))
    joined = queries.select("query_id", "query").join(found, "query_id", "left")
    parts = ["id", "distance", "document", "metadata"]
    compact = F.transform("_hits", lambda h: F.struct(*[h[p].alias(p) for p in parts]))
    empty = F.array().cast(found.select(compact).schema[0].dataType)
    evidence = F.coalesce(compact, empty)
    payload = F.to_json(F.struct("query", evidence.alias("evidence")), {"ignoreNullFields": "false"})
    return joined.select(
        "query_id",
        "query",
        F.size(evidence).alias("evidence_count"),
        F.transform(evidence, lambda h: h["id"]).alias("evidence_ids"),
        payload.alias("payload"),
    )


def auto_questions(files: DataFrame, most: int = 10) -> DataFrame:
    """The fixed question for each stored file and how many records to retrieve.

    ``files`` has ``filename, rows``.
    """
    return files.select(
        F.col("filename").alias("query_id"),
        F.concat(F.lit(AUTO_QUESTION), "filename").alias("query"),
        F.least(F.lit(most), "rows").cast("int").alias("k"),
    )


def auto_evidence(
    files: DataFrame,
    vectors: DataFrame,
    embed: Callable[[DataFrame], DataFrame],
    most: int = 10,
    only_file: bool = False,
) -> DataFrame:
    """Evidence for a first report on each stored file.

    ``embed`` adds ``embedding`` to a table with a ``query`` column. The whole
    collection is searched; with ``only_file`` each question only looks at the
    records of its file.
    """
    questions = auto_questions(files, most)
    if only_file:
        hits = knn_within(vectors, embed(questions), F.col("metadata.source"), most)
    else:
        hits = knn_search(vectors, embed(questions), most)
    return evidence_payload(hits, questions)


def parse_reports(raw: DataFrame, column: str = "raw") -> DataFrame:
    """Report text to typed columns with ``status`` ok, partial or error.

    A code fence around the JSON is dropped. ``partial`` means a field had the
    wrong type and is null; on ``error`` the text is kept in ``raw``.
    """
    text = F.col(column)
    body = F.when(text.rlike(_FENCE), F.regexp_extract(text, _FENCED, 1)).otherwise(python_strip(text))
    corrupt = "_corrupt"
    schema = T.StructType([*REPORT_SCHEMA.fields, T.StructField(corrupt, T.StringType())])
    options = {
        "mode": "PERMISSIVE",
        "columnNameOfCorruptRecord": corrupt,
        "allowSingleQuotes": "false",
    }
    names = REPORT_SCHEMA.fieldNames()

    def judged(body: Column, report: Column) -> Column:
        some = reduce(or_, [report[n].isNotNull() for n in names])
        broken = report.isNull() | report[corrupt].isNotNull()
        status = F.when(~broken, "ok").when(some, "partial").otherwise("error")
        kept = F.when(broken & ~F.coalesce(some, F.lit(False)), body)
        fields = [report[n].alias(n) for n in names]
        return F.struct(*fields, status.alias("status"), kept.alias("raw"))

    # The text is bound to a lambda variable and parsed once per row; as plain
    # columns every field and every later filter would repeat the parsing.
    bodies = F.transform(
        F.array(body), lambda b: F.struct(b.alias("body"), F.from_json(b, schema, options).alias("report"))
    )
    parsed = F.transform(bodies, lambda x: judged(x["body"], x["report"]))
    others = [c for c in raw.columns if c != column]
    return raw.select(*others, parsed[0].alias("_report")).select(*others, "_report.*")


def history_rows(reports: DataFrame) -> DataFrame:
    """Rows of the history table: parsed reports with the query they answer.

    ``reports`` has ``queried_at, query, top_k, evidence_count`` next to the
    parsed columns. Missing lists are stored as empty ones. A row keeps its
    ``id``; without one it gets a stable number from what it says.
    """
    lists = {
        c: F.coalesce(F.to_json(c), F.lit("[]")) for c in ("key_indicators", "recommended_actions")
    }
    rows = reports.withColumns(lists)
    number = F.col("id").cast("bigint") if "id" in reports.columns else F.xxhash64(*HISTORY_COLUMNS)
    return rows.select(number.alias("id"), *HISTORY_COLUMNS)


def query_history(history: DataFrame, limit: int = HISTORY_LIMIT) -> DataFrame:
    """Newest history rows with their lists and a display class for the level."""

    def as_list(name: str):
        return F.from_json(F.coalesce(name, F.lit("[]")), "array<string>")

    tie = ["id"] if "id" in history.columns else ["query"]
    newest = history.orderBy(F.desc("queried_at"), *[F.desc(c) for c in tie]).limit(limit)
    return newest.withColumns(
        {
            "key_indicators": as_list("key_indicators"),
            "recommended_actions": as_list("recommended_actions"),
            "risk_class": risk_class(F.col("risk_level")),
        }
    ).orderBy(F.desc("queried_at"), *[F.desc(c) for c in tie])
