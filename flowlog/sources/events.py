"""Canonical log records derived from the ``events`` table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import record_message
from ..schema import TAGS

_FIELDS = [
    "event_id AS id",
    "concat('capture_', cast(event_id % 4 AS string), '.csv') AS source_file",
    "date_format(ts, 'yyyy-MM-dd HH:mm:ss.SSSSSS') AS timestamp",
    "ts AS event_ts",
    """CASE WHEN event_id % 97 = 0 THEN NULL
            ELSE concat('10.0.', cast(user_id div 50 AS string), '.',
                        cast(user_id % 50 AS string)) END AS src_ip""",
    """CASE WHEN k % 10 = 0 THEN concat('10.0.0.', cast(k div 10 AS string))
            ELSE concat('192.168.1.', cast(k AS string)) END AS dst_ip""",
    "cast(1024 + event_id % 64000 AS int) AS src_port",
    """cast(CASE WHEN event_id % 89 = 0 THEN NULL
                 WHEN event_id % 3 = 0 THEN 1000 + k
                 WHEN user_id % 4 = 0 THEN 443
                 ELSE element_at(array(22, 23, 80, 443, 3306, 3389, 8080, 53), k % 8 + 1)
            END AS int) AS dst_port""",
    """CASE event_id % 5 WHEN 0 THEN 'TCP' WHEN 1 THEN 'UDP' WHEN 2 THEN 'ICMP'
                         WHEN 3 THEN 'HOPOPT' ELSE 'UNKNOWN' END AS protocol""",
    """CASE WHEN event_type = 'click' AND user_id % 5 <> 0 THEN 'SYN'
            WHEN event_type = 'purchase' AND user_id % 3 = 0 THEN 'PSH'
            WHEN event_type = 'signup' THEN 'FIN'
            WHEN event_type = 'error' THEN 'RST'
            ELSE 'ACK' END AS action""",
    """CASE WHEN event_id % 83 = 0 THEN NULL
            ELSE cast(floor(value * 100) AS bigint) END AS bytes""",
]


def logs_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One log record per event, see ``FIXTURES.md`` section 2."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    logs = events.withColumn("k", F.get_json_object("props", "$.k").cast("int")).selectExpr(*_FIELDS)
    tags = F.array(*[F.lit(t) for t in TAGS])
    return logs.withColumns({"message": record_message(), "tags": tags})
