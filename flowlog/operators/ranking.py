"""First rows per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_SLICES = (256, 16)


def first_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int, unique: str
) -> DataFrame:
    """The first ``n`` rows of each key with their ``rank``.

    Up to a limit that the session sets Spark itself keeps ``n`` rows per key
    before the shuffle. For more, a key is ranked in ever fewer slices, so that
    no task gets all its rows; the last gets 16 x ``n`` at most. ``unique`` is a
    column that tells the rows of a key apart.
    """
    rank = F.row_number()
    limit = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if n > limit:
        for slices in _SLICES:
            piece = F.pmod(F.xxhash64(unique), F.lit(slices))
            inside = Window.partitionBy(*keys, piece).orderBy(*order)
            df = df.withColumn("rank", rank.over(inside)).where(F.col("rank") <= n)
    whole = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", rank.over(whole)).where(F.col("rank") <= n)
