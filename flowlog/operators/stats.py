"""Distributions, top lists and totals over all records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import percent_of, port_service
from ..schema import TOP_N


def _counted(logs: DataFrame, column: str) -> DataFrame:
    return logs.groupBy(column).agg(F.count("*").alias("count"))


def _distribution(logs: DataFrame, column: str) -> DataFrame:
    counts = _counted(logs, column)
    # The scalar subquery reuses the aggregation's exchange; a window without
    # a key would move every group into one task instead.
    largest = counts.agg(F.max("count")).scalar()
    shares = counts.withColumn("pct", percent_of(F.col("count"), largest))
    return shares.orderBy(F.desc("count"), F.asc_nulls_last(column))


def protocol_dist(logs: DataFrame) -> DataFrame:
    return _distribution(logs, "protocol")


def action_dist(logs: DataFrame) -> DataFrame:
    return _distribution(logs, "action")


def _top(logs: DataFrame, column: str, n: int) -> DataFrame:
    counts = _counted(logs.where(F.col(column).isNotNull()), column)
    return counts.orderBy(F.desc("count"), column).limit(n)


def _with_pct(top: DataFrame) -> DataFrame:
    # safe without a partition key: the input is a top-n list
    largest = F.max("count").over(Window.partitionBy())
    return top.withColumn("pct", percent_of(F.col("count"), largest))


def top_src_ips(logs: DataFrame, n: int = TOP_N) -> DataFrame:
    return _with_pct(_top(logs, "src_ip", n)).orderBy(F.desc("count"), "src_ip")


def top_dst_ports(logs: DataFrame, n: int = TOP_N) -> DataFrame:
    top = _with_pct(_top(logs, "dst_port", n))
    return top.withColumn("service", port_service(F.col("dst_port"))).orderBy(
        F.desc("count"), "dst_port"
    )


def list_ips(logs: DataFrame) -> DataFrame:
    """Every source address with its record count, most frequent first."""
    counts = _counted(logs.where(F.col("src_ip").isNotNull()), "src_ip")
    return counts.select(F.col("src_ip").alias("ip"), "count").orderBy(F.desc("count"), "ip")


def dashboard_totals(logs: DataFrame, files: DataFrame, history: DataFrame) -> DataFrame:
    """One row: records, files, indexed files, queries asked, PSH records."""
    n_files = files.agg(F.count("*")).scalar()
    n_indexed = files.agg(F.count_if("indexed")).scalar()
    n_queries = history.agg(F.count("*")).scalar()
    per_log = logs.agg(
        F.count("*").alias("total_records"),
        F.count_if(F.col("action") == "PSH").alias("psh_count"),
    )
    return per_log.select(
        "total_records",
        n_files.alias("total_files"),
        n_indexed.alias("indexed_files"),
        n_queries.alias("total_queries"),
        "psh_count",
    )


def dashboard_cube(logs: DataFrame, n: int = TOP_N) -> DataFrame:
    """All dashboard counts from one scan: ``dimension, value, count``.

    Protocols and actions are listed in full, source addresses and destination
    ports as top ``n`` without nulls, plus one ``total`` row.
    """
    dims = ["protocol", "action", "src_ip", "dst_port"]
    counts = logs.groupingSets([["protocol"], ["action"], ["src_ip"], ["dst_port"], []], *dims).agg(
        F.count("*").alias("count"), F.grouping_id().alias("gid")
    )
    # grouping_id bits, protocol highest: a set bit means "not grouped by"
    gid = F.col("gid")
    dimension: Column = (
        F.when(gid == 0b0111, "protocol")
        .when(gid == 0b1011, "action")
        .when(gid == 0b1101, "src_ip")
        .when(gid == 0b1110, "dst_port")
        .otherwise("total")
    )
    value = F.coalesce("protocol", "action", "src_ip", F.col("dst_port").cast("string"))
    return best_lists(counts.select(dimension.alias("dimension"), value.alias("value"), "count"), n)


def best_lists(counts: DataFrame, n: int = TOP_N) -> DataFrame:
    """Full lists of protocols and actions, the total, and the top ``n`` addresses and ports of ``dimension, value, count``."""
    ranked = F.col("dimension").isin("src_ip", "dst_port")
    port = F.when(F.col("dimension") == "dst_port", F.col("value").cast("int"))
    flat = counts.withColumn("port", port).where(~ranked | F.col("value").isNotNull())

    # Two ranking steps so that no task sees all addresses: best n of each
    # slice first, then best n of those. Full lists only take part unranked.
    order = [F.desc("count"), F.asc("port"), F.asc("value")]
    slices = Window.partitionBy("dimension", F.pmod(F.xxhash64("value"), F.lit(1024))).orderBy(*order)
    finals = Window.partitionBy("dimension", F.when(~ranked, F.col("value"))).orderBy(*order)
    best = flat.withColumn("r", F.row_number().over(slices)).where(~ranked | (F.col("r") <= n))
    best = best.withColumn("r", F.row_number().over(finals)).where(~ranked | (F.col("r") <= n))
    return best.select("dimension", "value", "count").orderBy("dimension", F.desc("count"), "value")
