"""Mix sources to target weights with hash-threshold histograms.

Every row has a 60-bit hash of its key. Tokens are summed by source and the top twelve
bits; the bucket in which a source's budget ends is the only one that is summed again by
the next twelve bits, and what then remains, one row in 2**24, by the whole hash. The
result is a table with one threshold per source; rows are chosen by comparing their hash
with it, so nothing is sorted and a larger budget keeps what a smaller one has taken.

Null and empty texts have size 0 and are never taken. A null source is a source of its
own, the last. Rows with one hash (repeated rows) share what is left at the threshold in
proportion to their size, rounded down. Without rows there are no thresholds and no result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .columns import word_count

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
_BITS = 12
#: Thresholds are sent to all tasks up to this many sources; beyond, rows are joined with them by a shuffle.
MAX_BROADCAST_SOURCES = 10_000


def mix_hash(key: str) -> Column:
    """The first 60 bits of the key's MD5."""
    digest = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``.

    Sources get ``share`` of all tokens by weight; the weights repeat over the sources in code point order. A target
    stops at ``cap`` times its source, the excess goes to the others by weight. In order of cap over weight the stopped
    sources come first, so running sums find them at once. The windows run over the sources, never over rows.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    listed = F.array(*[F.lit(float(w)) for w in weights])
    everything = Window.partitionBy()
    table = sizes.select(
        "source",
        "source_size",
        F.element_at(listed, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")).alias("weight"),
        (F.col("source_size") * cap).cast("double").alias("cap"),
        (F.sum("source_size").over(everything) * share).alias("budget"),
    )
    before = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, -1
    )
    table = table.select(
        "*",
        F.coalesce(F.sum("cap").over(before), F.lit(0.0)).alias("cap_before"),
        F.coalesce(F.sum("weight").over(before), F.lit(0.0)).alias("weight_before"),
        F.sum("weight").over(everything).alias("weight_all"),
    )
    level = (F.col("budget") - F.col("cap_before")) / (F.col("weight_all") - F.col("weight_before"))
    table = table.withColumn("stopped", F.col("weight") * level >= F.col("cap"))
    stopped_cap = F.sum(F.when(F.col("stopped"), F.col("cap")).otherwise(0.0)).over(everything)
    stopped_weight = F.sum(F.when(F.col("stopped"), F.col("weight")).otherwise(0.0)).over(everything)
    rest = F.col("weight_all") - stopped_weight
    target = F.when(F.col("stopped") | (rest == 0), F.col("cap")).otherwise(
        F.col("weight") * (F.col("budget") - stopped_cap) / rest
    )
    return table.select("source", "source_size", target.alias("target"))


def _boundary(histogram: DataFrame, *keep: str) -> DataFrame:
    """The bucket of each source in which ``left`` ends, with what is left there and the bucket's sum.

    A window holds the buckets of one source: 4,096 at most, or the few rows of a twice refined bucket.
    """
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    table = histogram.withColumn("before", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    ends = (F.col("before") <= F.col("left")) & (F.col("left") < F.col("before") + F.col("tokens"))
    return table.where(ends).select("source", *keep, "bucket", (F.col("left") - F.col("before")).alias("left"), "tokens")


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= MAX_BROADCAST_SOURCES else df


def mix_thresholds(
    sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, cap: int = CAP
) -> DataFrame:
    """One row per source: ``source, source_size, target, copies, threshold, left, tied``.

    ``sizes`` has ``source, size, hash``. A row is taken ``copies`` times, once more if its hash is below
    ``threshold``, and in part (``left`` of ``tied`` tokens) if it is equal.
    """
    top, middle = F.shiftright("hash", 48), F.shiftright("hash", 36).bitwiseAND((1 << _BITS) - 1)
    first = materialize(sizes.groupBy("source", top.alias("bucket")).agg(F.sum("size").alias("tokens")))
    totals = first.groupBy("source").agg(F.sum("tokens").alias("source_size"))
    quota = F.round("target").cast("bigint")
    copies = F.when(F.col("source_size") > 0, F.expr("quota div source_size")).otherwise(F.lit(0)).cast("bigint")
    targets = materialize(
        source_targets(totals, weights, share, cap)
        .withColumn("quota", quota)
        .withColumn("copies", copies)
        .withColumn("left", F.col("quota") - F.col("copies") * F.col("source_size"))
        .drop("quota")
    )
    sources = targets.count()

    def with_left(histogram: DataFrame, table: DataFrame) -> DataFrame:
        same = F.col("h.source").eqNullSafe(F.col("t.source"))
        return histogram.alias("h").join(_small(table.alias("t"), sources), same).select("h.*", "t.left")

    cut = materialize(_boundary(with_left(first, targets)).withColumnRenamed("bucket", "top_bits").drop("tokens"))

    def inside(table: DataFrame, *bits: tuple[str, Column]) -> DataFrame:
        same = F.col("s.source").eqNullSafe(F.col("c.source"))
        for name, column in bits:
            same = same & (F.col(f"c.{name}") == F.col(f"s.{name}"))
        rows = sizes.select("source", "size", "hash", *[column.alias(name) for name, column in bits])
        return rows.alias("s").join(_small(table.alias("c"), sources), same).select("s.*", "c.left")

    bits = [("top_bits", top), ("mid_bits", middle)]
    second = inside(cut, *bits[:1]).groupBy("source", "top_bits", middle.alias("bucket"), "left")
    finer = _boundary(second.agg(F.sum("size").alias("tokens")), "top_bits").withColumnRenamed("bucket", "mid_bits")
    finer = materialize(finer.drop("tokens"))
    last = inside(finer, *bits).groupBy("source", F.col("hash").alias("bucket"), "left").agg(F.sum("size").alias("tokens"))
    exact = _boundary(last).select(
        "source", F.col("bucket").alias("threshold"), F.col("left").alias("rest"), F.col("tokens").alias("tied")
    )
    same = F.col("t.source").eqNullSafe(F.col("e.source"))
    return targets.alias("t").join(exact.alias("e"), same, "left").select(
        "t.source",
        "t.source_size",
        "t.target",
        "t.copies",
        "e.threshold",
        F.col("e.rest").alias("left"),
        "e.tied",
    )


def taken_tokens(size: Column, hashed: Column) -> Column:
    """Tokens that the mix takes of a row that is joined with its source's threshold ``m``."""
    tied = F.col("m.tied").cast("decimal(19,0)")
    share = F.col("m.left").cast("decimal(19,0)") * size.cast("decimal(18,0)")
    part = (share - share % tied) / tied  # a whole number
    extra = (
        F.when(hashed < F.col("m.threshold"), size)
        .when(hashed == F.col("m.threshold"), F.round(part).cast("bigint"))
        .otherwise(F.lit(0))
    )
    return (F.col("m.copies") * size + extra).cast("bigint")


def mix_sources(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    cap: int = CAP,
) -> DataFrame:
    """``<key>, size, source_size, target, taken`` of every row of ``docs``; ``target`` is its source's.

    ``taken`` counts the words the mix takes, repeats included: a source's taken words differ from its rounded target
    only where repeated rows share the threshold. The row at the threshold is taken in part, its first words.
    """
    sizes = materialize(
        docs.select(
            F.col(key).alias("key"),
            F.col(source).cast("string").alias("source"),
            word_count(text).alias("size"),
            mix_hash(key).alias("hash"),
        )
    )
    return with_thresholds(sizes, mix_thresholds(sizes, weights, share, cap)).select(
        F.col("s.key").alias(key),
        F.col("s.size"),
        F.col("m.source_size"),
        F.col("m.target"),
        taken_tokens(F.col("s.size"), F.col("s.hash")).alias("taken"),
    )


def with_thresholds(rows: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Rows ``s`` (with ``source``) joined with the threshold ``m`` of their source."""
    thresholds = materialize(thresholds)
    same = F.col("s.source").eqNullSafe(F.col("m.source"))
    return rows.alias("s").join(_small(thresholds.alias("m"), thresholds.count()), same)


_LOTS = 1 << 20


def mixed_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **mix: object) -> DataFrame:
    """The documents of the mix with the columns of ``docs``: a row for each time that one is taken, always whole.

    The document at a source's threshold is taken if at least half of its words are needed. Of rows that share the threshold,
    such as those with one id, each is taken or not by a hash of its text and place, so that the needed share of them is.
    Documents without words are in no mix.
    """
    rows = docs.select(
        F.struct("*").alias("__row"),
        F.col(source).cast("string").alias("source"),
        word_count(text).alias("size"),
        mix_hash(key).alias("hash"),
        F.xxhash64(F.col(text).cast("string"), F.monotonically_increasing_id()).alias("lot"),
    )
    thresholds = mix_thresholds(materialize(rows.select("source", "size", "hash")), **mix)
    size, left, tied = F.col("s.size"), F.col("m.left"), F.col("m.tied")
    lot = F.pmod(F.col("s.lot"), F.lit(_LOTS))
    needed = F.when(size == tied, 2 * left >= tied).otherwise(lot.cast("double") / _LOTS * tied < left)
    hashed, threshold = F.col("s.hash"), F.col("m.threshold")
    once_more = (hashed < threshold) | ((hashed == threshold) & needed)
    copies = F.when(size > 0, F.col("m.copies") + F.coalesce(once_more, F.lit(False)).cast("bigint")).otherwise(0)
    taken = with_thresholds(rows, thresholds).select(F.col("s.__row").alias("row"), copies.cast("int").alias("copies"))
    return taken.select(F.explode(F.array_repeat("row", F.col("copies"))).alias("row")).select("row.*")
