"""Keyword search against vector search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def compare_search(queries: DataFrame, keyword: DataFrame, semantic: DataFrame) -> DataFrame:
    """Counts, overlap of distinct messages and a verdict per query.

    ``keyword`` has ``query_id, message``, ``semantic`` has ``query_id,
    document``; both hold at most k rows per query. Queries without any hit are
    reported too.
    """
    none = F.lit(0)

    def side(df: DataFrame, text: str, kw: int, sem: int) -> DataFrame:
        return df.select(
            "query_id", F.col(text).alias("text"), F.lit(kw).alias("kw"), F.lit(sem).alias("sem")
        )

    asked = queries.select(
        "query_id", F.lit(None).cast("string").alias("text"), none.alias("kw"), none.alias("sem")
    )
    hits = (
        side(keyword, "message", 1, 0)
        .unionByName(side(semantic, "document", 0, 1))
        .unionByName(asked)
    )
    per_text = hits.groupBy("query_id", "text").agg(F.sum("kw").alias("kw"), F.sum("sem").alias("sem"))
    shared = (F.col("kw") > 0) & (F.col("sem") > 0)
    totals = per_text.groupBy("query_id").agg(
        F.sum("kw").alias("keyword_count"),
        F.sum("sem").alias("semantic_count"),
        F.count_if(shared).alias("overlap"),
    )
    kw, sem, overlap = F.col("keyword_count"), F.col("semantic_count"), F.col("overlap")
    verdict = (
        F.when((overlap == sem) & (overlap == kw), "identical")
        .when(sem - overlap > 0, "semantic_extra")
        .when(sem < kw, "keyword_more")
        .otherwise("similar")
    )
    direction = F.when(sem > kw, "more").when(sem < kw, "less").otherwise("same")
    return totals.select(
        "query_id",
        "keyword_count",
        "semantic_count",
        "overlap",
        (sem - overlap).alias("extra"),
        verdict.alias("verdict"),
        direction.alias("direction"),
    )
