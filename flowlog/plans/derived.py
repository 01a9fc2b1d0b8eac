"""Inputs of the registered queries, derived by Spark from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.catalog import upsert_files
from ..operators.vectors import vector_records
from ..session import scratch_path

_HALF = "timestamp_ntz'2024-01-16 00:00:00'"

# header names and the time pattern of each CSV layout
CSV_LAYOUTS = [
    (
        " Source IP, Source Port, Destination IP, Destination Port, Protocol, Timestamp,"
        " Total Length of Fwd Packets, Label",
        ["src_ip", "src_port", "dst_ip", "dst_port", "protocol", "timestamp", "bytes", "action"],
        "d/M/yyyy H:mm:ss.SSSSSS",
    ),
    (
        "timestamp,src_ip,dst_ip,src_port,dst_port,protocol,bytes,action",
        ["timestamp", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "bytes", "action"],
        "yyyy-MM-dd HH:mm:ss.SSSSSS",
    ),
    (
        "time,src,dst,sport,dport,proto,len,flag",
        ["timestamp", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "bytes", "action"],
        "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    ),
    (
        "action,bytes,protocol,dst_port,src_port,dst_ip,src_ip,timestamp",
        ["action", "bytes", "protocol", "dst_port", "src_port", "dst_ip", "src_ip", "timestamp"],
        "yyyy-MM-dd HH:mm:ss.SSSSSS",
    ),
]

_RAW_REPORT = """
  CASE id % 7
    WHEN 0 THEN concat('{"risk_level": "HIGH", "summary": "', message, '", "key_indicators": ["',
        action, '", "', protocol, '"], "recommended_actions": ["check ', dst_ip,
        '"], "evidence_highlights": [{"id": "', cast(id AS string), '", "reason": "', action, '"}]}')
    WHEN 1 THEN concat('```json\n{"risk_level": "LOW", "summary": "', message,
        '", "key_indicators": ["', protocol, '"]}\n```')
    WHEN 2 THEN concat('```\n{"risk_level": "MEDIUM", "recommended_actions": ["', action, '"]}')
    WHEN 3 THEN concat('no report for ', message)
    WHEN 4 THEN concat('{''risk_level'': ''', action, '''}')
    WHEN 5 THEN concat('{"risk_level": "LOW", "key_indicators": "', action, '"}')
    ELSE concat('  {"risk_level": "', action, '"}  ')
  END"""


def stored_vectors(logs: DataFrame, sf_dir: str) -> DataFrame:
    """``id, embedding, document, metadata`` of every record.

    The embeddings repeat over the records, turned by one place each time, so that hardly two records have the same.
    """
    embeddings = logs.sparkSession.read.parquet(f"{sf_dir}/embeddings.parquet")
    shared = embeddings.count()
    records = vector_records(logs.withColumn("row_index", F.col("id")))
    records = records.withColumn(
        "_id", F.substring_index("id", ":", -1).cast("bigint")
    ).drop("id", "source_file")
    # A small file is one split, but searching it is work for all cores. The join takes the rows as they are dealt here, so
    # they are shuffled once, and looks the embeddings up in a hash table, so they are not sorted
    spark = logs.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    records = records.withColumn("_vec", F.col("_id") % shared).repartition(tasks, "_vec")
    turn = (F.floor(F.col("_id") / shared) % F.size("embedding")).cast("int")
    turned = F.concat(F.slice("embedding", turn + 1, F.size("embedding")), F.slice("embedding", F.lit(1), turn))
    return records.join(embeddings.hint("shuffle_hash"), F.col("vec_id") == F.col("_vec")).select(
        F.col("_id").alias("id"), turned.alias("embedding"), "document", "metadata"
    )


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query for each embedding, a quarter of the way to the next one, where no record is."""
    embeddings = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    n = embeddings.count()
    following = embeddings.select(((F.col("vec_id") + n - 1) % n).alias("before"), F.col("embedding").alias("next"))
    between = F.zip_with("embedding", "next", lambda a, b: a.cast("double") * 0.75 + b.cast("double") * 0.25)
    both = embeddings.join(following, F.col("vec_id") == F.col("before"))
    return both.select(F.col("vec_id").alias("query_id"), between.alias("embedding"))


def keyword_queries(logs: DataFrame) -> DataFrame:
    """A two-term query for each protocol and action that occur together."""
    pairs = logs.select("protocol", "action").distinct()
    text = F.concat(F.lower("protocol"), F.lit(" "), "action")
    return pairs.select(text.alias("query_id"), text.alias("query"))


def address_queries(logs: DataFrame) -> DataFrame:
    """A two-term query for each action and destination that occur together."""
    text = F.concat("action", F.lit(" "), "dst_ip")
    return logs.where("dst_ip is not null").select(text.alias("query_id"), text.alias("query")).distinct()


def paired_queries(vectors: DataFrame) -> DataFrame:
    """Keyword queries with the vector of the first record they describe."""
    pair = vectors.select(
        F.concat(F.lower("metadata.protocol"), F.lit(" "), "metadata.action").alias("query"),
        "id",
        "embedding",
    )
    return (
        pair.groupBy("query")
        .agg(F.min_by("embedding", "id").alias("embedding"))
        .select(F.col("query").alias("query_id"), "query", "embedding")
    )


def file_tables(logs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored and newly uploaded files: one file per source or destination address."""

    def per_address(rows: DataFrame, column: str) -> DataFrame:
        return (
            rows.where(F.col(column).isNotNull())
            .groupBy(F.concat(F.col(column), F.lit(".csv")).alias("filename"))
            .agg(F.min("event_ts").alias("uploaded_at"), F.count("*").alias("rows"))
        )

    stored = per_address(logs.where(f"event_ts < {_HALF}"), "src_ip")
    new = per_address(logs.where(f"event_ts >= {_HALF}"), "dst_ip")
    return stored.withColumn("indexed", F.col("rows") % 2 == 0), new


def files_and_sources(logs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A merged file table and the sources whose records are stored."""
    stored = logs.where(F.col("action") == "PSH").select(
        F.concat("src_ip", F.lit(".csv")).alias("source_file")
    )
    return upsert_files(*file_tables(logs)), stored.where(F.col("source_file").isNotNull())


def raw_reports(logs: DataFrame) -> DataFrame:
    """A report text for each record, in every shape a report can have."""
    return logs.select(
        "id",
        F.col("event_ts").alias("queried_at"),
        F.concat(F.lit("what is "), "action").alias("query"),
        (F.col("id") % 10 + 1).cast("int").alias("top_k"),
        (F.col("id") % 6).cast("int").alias("evidence_count"),
        F.expr(_RAW_REPORT).alias("raw"),
    )


def history_table(logs: DataFrame) -> DataFrame:
    """A history row for each record; some have no list text."""
    return logs.select(
        "id",
        F.col("event_ts").alias("queried_at"),
        F.concat(F.lit("what is "), "action").alias("query"),
        (F.col("id") % 10 + 1).cast("int").alias("top_k"),
        F.expr("CASE action WHEN 'PSH' THEN 'HIGH' WHEN 'SYN' THEN 'MEDIUM' WHEN 'ACK' THEN 'LOW' END").alias(
            "risk_level"
        ),
        F.col("message").alias("summary"),
        F.when(F.col("id") % 7 != 0, F.to_json(F.array("action", "protocol"))).alias("key_indicators"),
        F.lit("[]").alias("recommended_actions"),
        (F.col("id") % 6).cast("int").alias("evidence_count"),
    )


def write_csv_folder(logs: DataFrame) -> str:
    """Write the records as CSV in four layouts, one per source file."""
    folder = scratch_path(logs.sparkSession, "uploads")
    # protocol numbers in the first layout, names in the others
    number = F.expr(
        "CASE protocol WHEN 'TCP' THEN '6' WHEN 'UDP' THEN '17.0' WHEN 'ICMP' THEN '1'"
        " WHEN 'HOPOPT' THEN '0' END"
    )
    for i, (header, columns, pattern) in enumerate(CSV_LAYOUTS):
        rows = logs.where(F.col("source_file") == f"capture_{i}.csv").withColumns(
            {
                "timestamp": F.date_format("event_ts", pattern),
                "protocol": number if i == 0 else F.col("protocol"),
            }
        )
        names = header.split(",")
        rows.select(*[F.col(c).alias(n) for c, n in zip(columns, names)]).write.option(
            "header", True
        ).option("ignoreLeadingWhiteSpace", False).csv(f"{folder}/layout_{i}")
    return folder


def write_quoted_csv(logs: DataFrame) -> str:
    """Write the records as one file whose cells hold line breaks, quotes, commas and blanks where they can mislead."""
    folder = scratch_path(logs.sparkSession, "quoted")
    note = F.expr(_NOTE)
    rows = logs.select("id", note.alias("action"), F.coalesce("src_ip", F.lit("")).alias("src_ip"), "bytes")
    # one file, in the order of the ids
    rows.repartitionByRange(1, "id").sortWithinPartitions("id").write.option("header", True).option("escape", '"').option(
        "ignoreLeadingWhiteSpace", False
    ).option("ignoreTrailingWhiteSpace", False).csv(folder)
    return folder


_NOTE = """
  CASE id % 9
    WHEN 0 THEN concat(action, '\\n', id, ',"x"\\n')
    WHEN 1 THEN concat('"', action, '"')
    WHEN 2 THEN concat(action, ', "', id)
    WHEN 3 THEN concat('\\n\\n', action, '\\n"\\n,')
    WHEN 4 THEN repeat(concat(action, ',\\n'), 20)
    ELSE action
  END"""
