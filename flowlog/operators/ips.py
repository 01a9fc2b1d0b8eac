"""Per-address reports, for every address in one job.

Each operator takes ``ip=`` to restrict it to one address; the equality then
reaches the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import percent_of, port_service, readable_bytes
from ..schema import IP_RECORDS_LIMIT, TOP_N
from .ranking import first_per_key


def _sources(logs: DataFrame, ip: str | None) -> DataFrame:
    if ip is None:
        return logs.where(F.col("src_ip").isNotNull())
    return logs.where(F.col("src_ip") == ip)


def _touching(logs: DataFrame, ip: str | None) -> DataFrame:
    if ip is None:
        return logs
    return logs.where((F.col("src_ip") == ip) | (F.col("dst_ip") == ip))


def _only(df: DataFrame, ip: str | None) -> DataFrame:
    return df if ip is None else df.where(F.col("ip") == ip)


def ip_profile(logs: DataFrame, ip: str | None = None) -> DataFrame:
    """Records as source and as destination, and bytes sent, per address.

    Both endpoints of a record become rows of one aggregation, so there is a
    single scan and a single partially aggregated shuffle, and no join.
    """
    source = F.struct(
        F.col("src_ip").alias("ip"),
        F.lit(1).alias("src"),
        F.lit(0).alias("dst"),
        F.coalesce("bytes", F.lit(0)).cast("bigint").alias("sent"),
    )
    destination = F.struct(
        F.col("dst_ip").alias("ip"),
        F.lit(0).alias("src"),
        F.lit(1).alias("dst"),
        F.lit(0).cast("bigint").alias("sent"),
    )
    ends = _touching(logs, ip).select(F.explode(F.array(source, destination)).alias("e"))
    ends = _only(ends.select("e.*").where(F.col("ip").isNotNull()), ip)
    return (
        ends.groupBy("ip")
        .agg(
            F.sum("src").alias("as_source"),
            F.sum("dst").alias("as_destination"),
            F.sum("sent").alias("total_bytes"),
        )
        .withColumn("bytes_text", readable_bytes(F.col("total_bytes")))
    )


def ip_actions(logs: DataFrame, ip: str | None = None) -> DataFrame:
    """Action counts of each source address with their share of its largest."""
    counts = _sources(logs, ip).groupBy(F.col("src_ip").alias("ip"), "action").agg(
        F.count("*").alias("count")
    )
    # own aggregation instead of a window: no task holds all actions of an address
    largest = counts.groupBy("ip").agg(F.max("count").alias("largest"))
    joined = counts.join(largest, "ip")
    return joined.select(
        "ip", "action", "count", percent_of(F.col("count"), F.col("largest")).alias("pct")
    )


def _top_per_ip(logs: DataFrame, ip: str | None, column: str, n: int) -> DataFrame:
    counts = (
        _sources(logs, ip)
        .where(F.col(column).isNotNull())
        .groupBy(F.col("src_ip").alias("ip"), column)
        .agg(F.count("*").alias("count"))
    )
    top = first_per_key(counts, ["ip"], [F.desc("count"), column], n, column)
    largest = F.max("count").over(Window.partitionBy("ip"))
    return top.withColumn("pct", percent_of(F.col("count"), largest))


def ip_dst_ports(logs: DataFrame, ip: str | None = None, n: int = TOP_N) -> DataFrame:
    top = _top_per_ip(logs, ip, "dst_port", n)
    return top.withColumn("service", port_service(F.col("dst_port")))


def ip_src_ports(logs: DataFrame, ip: str | None = None, n: int = TOP_N) -> DataFrame:
    return _top_per_ip(logs, ip, "src_port", n)


def ip_contacts(logs: DataFrame, ip: str | None = None, n: int = TOP_N) -> DataFrame:
    """Addresses a source talks to most."""
    return _top_per_ip(logs, ip, "dst_ip", n)


def ip_records(logs: DataFrame, ip: str | None = None, n: int = IP_RECORDS_LIMIT) -> DataFrame:
    """Newest ``n`` records of each address, as source or destination.

    A record between an address and itself counts once.
    """
    ends = F.array_distinct(F.array_compact(F.array("src_ip", "dst_ip")))
    rows = _only(_touching(logs, ip).withColumn("ip", F.explode(ends)), ip)
    return first_per_key(rows, ["ip"], [F.desc("event_ts"), F.desc("id")], n, "id")


def ip_risk(logs: DataFrame, ip: str | None = None, top_n: int | None = TOP_N) -> DataFrame:
    """Rule flags per source address.

    Port rules look at the address's ``top_n`` destination ports only
    (``None``: at all of them). ``many_syn_ports`` needs a SYN record and three
    listed ports.
    """
    # An address has at most one row per port from here on, however many records.
    pairs = (
        _sources(logs, ip)
        .groupBy(F.col("src_ip").alias("ip"), "dst_port")
        .agg(
            F.count("*").alias("count"),
            F.max(F.col("action") == "PSH").alias("psh"),
            F.max(F.col("action") == "SYN").alias("syn"),
        )
    )
    port = F.col("dst_port")
    listed = port.isNotNull()
    if top_n is not None:
        order = Window.partitionBy("ip").orderBy(port.isNull(), F.desc("count"), port)
        pairs = pairs.withColumn("rank", F.row_number().over(order))
        listed = listed & (F.col("rank") <= top_n)
    risk = (
        pairs.groupBy("ip")
        .agg(
            F.coalesce(F.max("psh"), F.lit(False)).alias("has_psh"),
            F.coalesce(F.max(listed & (port == 22)), F.lit(False)).alias("targets_ssh"),
            F.coalesce(F.max(listed & (port == 3389)), F.lit(False)).alias("targets_rdp"),
            F.coalesce(F.max("syn"), F.lit(False)).alias("has_syn"),
            F.count_if(listed).alias("n_ports"),
        )
        .withColumn("many_syn_ports", F.col("has_syn") & (F.col("n_ports") >= 3))
        .drop("has_syn", "n_ports")
    )
    clean = ~(
        F.col("has_psh") | F.col("targets_ssh") | F.col("targets_rdp") | F.col("many_syn_ports")
    )
    return risk.withColumn("clean", clean)
