"""Risk flags of source addresses in sliding windows, as logs arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..schema import TOP_N


def risk_by_window(logs: DataFrame, length: str = "1 hour", slide: str = "30 minutes", top_n: int = TOP_N) -> DataFrame:
    """The flags of ``ip_risk`` per address and window of ``event_time``: ``start, end, ip, has_psh, ...``.

    For stored and for streamed records. Records are counted per port first; an address then has a row per port, of
    which there are 65,536 at most, so its list of ports is bounded.
    """
    pairs = (
        logs.where(F.col("src_ip").isNotNull())
        .groupBy(F.window("event_time", length, slide).alias("window"), F.col("src_ip").alias("ip"), "dst_port")
        .agg(
            F.count("*").alias("count"),
            F.max(F.col("action") == "PSH").alias("psh"),
            F.max(F.col("action") == "SYN").alias("syn"),
        )
    )
    ports = F.collect_list(F.when(F.col("dst_port").isNotNull(), F.struct((-F.col("count")).alias("n"), "dst_port")))
    flags = pairs.groupBy("window", "ip").agg(
        F.coalesce(F.max("psh"), F.lit(False)).alias("has_psh"),
        F.coalesce(F.max("syn"), F.lit(False)).alias("has_syn"),
        F.slice(F.array_sort(ports), 1, top_n).alias("ports"),
    )
    at = lambda port: F.exists("ports", lambda p: p["dst_port"] == port)
    flags = flags.select(
        F.col("window.start").alias("start"),
        F.col("window.end").alias("end"),
        "ip",
        "has_psh",
        at(22).alias("targets_ssh"),
        at(3389).alias("targets_rdp"),
        (F.col("has_syn") & (F.size("ports") >= 3)).alias("many_syn_ports"),
    )
    some = F.col("has_psh") | F.col("targets_ssh") | F.col("targets_rdp") | F.col("many_syn_ports")
    return flags.withColumn("clean", ~some)


def watch_risk(
    logs: DataFrame,
    path: str,
    checkpoint: str,
    late: str = "1 hour",
    length: str = "1 hour",
    slide: str = "30 minutes",
    top_n: int = TOP_N,
) -> DataStreamWriter:
    """A stream writer that adds a window's flags to the table at ``path`` once no more records of it are waited for.

    ``logs`` is a stream of records. Records up to ``late`` behind the newest one still count. The table's own log and the
    checkpoint make a restart go on without repeating a window.
    """
    timed = logs.withColumn("event_time", F.col("event_ts").cast("timestamp")).withWatermark("event_time", late)
    flags = risk_by_window(timed, length, slide, top_n)
    return flags.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
