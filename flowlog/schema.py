"""Canonical log schema and the fixed vocabularies the operators share."""

from __future__ import annotations

from pyspark.sql import types as T

LOG_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("source_file", T.StringType(), False),
        T.StructField("row_index", T.LongType(), False),
        T.StructField("timestamp", T.StringType()),
        T.StructField("event_ts", T.TimestampNTZType()),
        T.StructField("src_ip", T.StringType()),
        T.StructField("dst_ip", T.StringType()),
        T.StructField("src_port", T.IntegerType()),
        T.StructField("dst_port", T.IntegerType()),
        T.StructField("protocol", T.StringType(), False),
        T.StructField("bytes", T.LongType()),
        T.StructField("bytes_source", T.StringType()),
        T.StructField("action", T.StringType(), False),
        T.StructField("message", T.StringType(), False),
        T.StructField("tags", T.ArrayType(T.StringType(), False), False),
    ]
)

REPORT_SCHEMA = T.StructType(
    [
        T.StructField("risk_level", T.StringType()),
        T.StructField("summary", T.StringType()),
        T.StructField("key_indicators", T.ArrayType(T.StringType())),
        T.StructField("recommended_actions", T.ArrayType(T.StringType())),
        T.StructField(
            "evidence_highlights",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("id", T.StringType()),
                        T.StructField("reason", T.StringType()),
                    ]
                )
            ),
        ),
    ]
)

HISTORY_COLUMNS = [
    "queried_at",
    "query",
    "top_k",
    "risk_level",
    "summary",
    "key_indicators",
    "recommended_actions",
    "evidence_count",
]

# Accepted column names per field, first match wins, case-sensitive.
ALIASES = {
    "timestamp": ["Timestamp", "timestamp", "time", "date", "datetime"],
    "src_ip": ["Source IP", "src_ip", "source_ip", "src", "ip_src"],
    "dst_ip": ["Destination IP", "dst_ip", "destination_ip", "dst", "ip_dst"],
    "src_port": ["Source Port", "src_port", "sport", "source_port"],
    "dst_port": ["Destination Port", "dst_port", "dport", "destination_port"],
    "protocol": ["Protocol", "protocol", "proto"],
    "bytes": [
        "Total Length of Fwd Packets",
        "Total Fwd Packets",
        "Flow Bytes/s",
        "Flow Packets/s",
        "bytes",
        "len",
        "size",
        "tot_bytes",
    ],
    "action": ["Label", "flag", "action", "event", "label"],
}

# Cell texts that count as missing (the pandas CSV defaults).
MISSING_TEXTS = [
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
]

# IP protocol number -> name.
PROTOCOL_NAMES = {0: "HOPOPT", 1: "ICMP", 6: "TCP", 17: "UDP"}

# Destination port -> service hint.
PORT_SERVICES = {
    22: "SSH",
    23: "Telnet",
    80: "HTTP",
    443: "HTTPS",
    3306: "MySQL",
    3389: "RDP",
    8080: "HTTP-alt",
}

# Constants of the record and report formats.
UNKNOWN = "UNKNOWN"
TAGS = ["network", "log"]
AUTO_QUESTION = "Analiziraj sigurnosne prijetnje u fajlu "

# Columns a keyword is looked for in.
SEARCH_COLUMNS = ("message", "src_ip", "dst_ip", "action", "protocol")

# Result sizes of the individual reports.
FILTER_LIMIT = 500
IP_RECORDS_LIMIT = 100
HISTORY_LIMIT = 50
TOP_N = 10
RECENT_FILES = 5
PREVIEW_ROWS = 5
SEARCH_K = 5
SAMPLE_ROWS = 5000
