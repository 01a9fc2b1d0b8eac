"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint has 64 bits; a bit is 1 if it is set in over half of the XXH64 hashes of the document's word shingles.
Fingerprints link when at most ``MAX_BITS`` bits differ. The bits are split into ``BLOCKS`` blocks: differing bits touch at
most ``MAX_BITS`` of them, so linked fingerprints agree in at least ``BLOCKS - MAX_BITS``. Joining on every combination of
that many blocks (35 keys of 27 bits by default) loses no link; candidates of a key are then compared.

Copies are one fingerprint before anything is joined. A key that many different fingerprints share is cut into chunks,
and each pair of chunks is compared by itself, so that no task holds an unbounded group. From each comparison only a
spanning star of each connected part is kept, never its pairs.

Null and empty texts, and texts of blanks only, have fingerprint zero, which links like any other. Texts with fewer
words than a shingle have one shingle. Repeated rows get the same answer. Null keys get the component of their
fingerprint; a component with null keys only has a null id. No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..session import materialize
from .batches import slices, texts
from .components import components

SHINGLE_WORDS = 4
SEED = 42
MAX_BITS = 4
BLOCKS = 7
CHUNK = 512
_BITS = 64


def fingerprint(text: bytes, words: int = SHINGLE_WORDS) -> int:
    """The SimHash of one text, unsigned."""
    tokens = text.lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.fromiter(accumulate(map(len, tokens)), np.int64, len(tokens)) + np.arange(len(tokens))
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = max(0, len(tokens) - words)
    begin, end = starts[: last + 1].tolist(), ends[min(words, len(tokens)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(joined[a:b], SEED) for a, b in zip(begin, end, strict=True)], np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes, unsigned."""
    counts = np.zeros(_BITS, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8), bitorder="little")
        counts += bits.reshape(-1, _BITS).sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def with_fingerprints(docs: DataFrame, text: str, column: str = "fingerprint", words: int = SHINGLE_WORDS) -> DataFrame:
    """``docs`` and the fingerprint of each row's text as a signed long."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            values = np.array([fingerprint(value, words) for value in texts(batch, text)], np.uint64)
            yield batch.append_column(column, pa.array(values.view(np.int64)))

    return docs.mapInArrow(add, StructType([*docs.schema, StructField(column, LongType())]))


def block_masks(blocks: int = BLOCKS, max_bits: int = MAX_BITS) -> list[int]:
    """Bit masks of all combinations of ``blocks - max_bits`` blocks, as signed longs."""
    edges = [i * _BITS // blocks for i in range(blocks + 1)]
    single = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    masks = [sum(chosen) for chosen in combinations(single, blocks - max_bits)]
    return [mask - (1 << _BITS) if mask >> (_BITS - 1) else mask for mask in masks]


def _stars(values: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links from the least fingerprint of each connected part to its other members."""
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= max_bits
    open_, stars = np.ones(len(values), bool), []
    signed = values.view(np.int64)
    while open_.any():
        part = np.zeros(len(values), bool)
        frontier = np.zeros(len(values), bool)
        frontier[np.flatnonzero(open_)[0]] = True
        while frontier.any():
            part |= frontier
            frontier = near[frontier].any(axis=0) & ~part
        open_ &= ~part
        members = signed[part]
        least = members.min()
        stars += [(int(least), int(m)) for m in members if m != least]
    return stars


def fingerprint_links(prints: DataFrame, max_bits: int = MAX_BITS, blocks: int = BLOCKS) -> DataFrame:
    """``a, b``: links that connect exactly the fingerprints that chains of close pairs connect.

    ``prints`` has one column of different fingerprints.
    """
    value = F.col(prints.columns[0])
    masks = block_masks(blocks, max_bits)
    keys = F.array(*[F.xxhash64(F.lit(i), value.bitwiseAND(F.lit(m).cast("bigint"))) for i, m in enumerate(masks)])
    rows = prints.select(value.alias("print"), F.explode(keys).alias("key"))
    # rows meet in one shuffle; a join with their counts would need two
    shared = rows.withColumn("members", F.count("*").over(Window.partitionBy("key"))).where("members > 1")
    # a large key: chunk c meets chunk j in the cell (least, greatest)
    chunks = F.ceil(F.col("members") / CHUNK)
    shared = shared.select("key", "print", chunks.alias("chunks"), F.pmod(F.xxhash64("print"), chunks).alias("c"))
    shared = shared.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    cells = shared.groupBy("key", F.least("c", "j").alias("x"), F.greatest("c", "j").alias("y")).agg(
        F.collect_list("print").alias("prints")
    )

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: set[tuple[int, int]] = set()
            for values in batch.column("prints").to_pylist():
                if len(values) == 2:
                    a, b = sorted(values)
                    if ((a ^ b) & (2**64 - 1)).bit_count() <= max_bits:
                        found.add((a, b))
                else:
                    found.update(_stars(np.array(values, np.int64).view(np.uint64), max_bits))
            pairs = sorted(found)
            yield pa.RecordBatch.from_pydict(
                {
                    "a": pa.array([a for a, _ in pairs], pa.int64()),
                    "b": pa.array([b for _, b in pairs], pa.int64()),
                }
            )

    return cells.select("prints").mapInArrow(link, "a bigint, b bigint").distinct()


def _groups(rows: DataFrame, max_bits: int, blocks: int) -> DataFrame:
    """``print, component_id, keep_key, keep_print`` of every fingerprint of ``rows`` (``key, print``)."""
    prints = materialize(
        rows.groupBy("print").agg(F.min(F.struct(F.col("key").isNull().alias("no_key"), "key")).alias("least"))
    )
    roots = components(fingerprint_links(prints.select("print"), max_bits, blocks))
    placed = prints.join(roots, F.col("print") == F.col("node"), "left").select(
        "print", "least", F.coalesce("root", "print").alias("root")
    )
    best = placed.groupBy("root").agg(F.min(F.struct("least.no_key", "least.key", "print")).alias("best"))
    return placed.join(best.withColumnRenamed("root", "root2"), F.col("root") == F.col("root2")).select(
        "print",
        F.col("best.key").alias("component_id"),
        F.col("best.print").alias("keep_print"),
    )


def simhash_components(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    words: int = SHINGLE_WORDS,
    max_bits: int = MAX_BITS,
    blocks: int = BLOCKS,
) -> DataFrame:
    """``<key>, fingerprint`` (16 hex digits), ``component_id`` (least key that chains of links reach) of every row."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    rows = materialize(with_fingerprints(rows, "text", "print", words).select("key", "print"))
    groups = _groups(rows, max_bits, blocks).withColumnRenamed("print", "print2")
    return rows.join(groups, F.col("print") == F.col("print2")).select(
        F.col("key").alias(key), _hex(F.col("print")).alias("fingerprint"), "component_id"
    )


def _hex(value: Column) -> Column:
    return F.lpad(F.lower(F.hex(value)), 16, "0")


def drop_near_duplicates(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    words: int = SHINGLE_WORDS,
    max_bits: int = MAX_BITS,
    blocks: int = BLOCKS,
) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the one with the least key, once if it is repeated."""
    own_key, own_text = F.col(key).alias("key"), F.col(text).cast("string").alias("text")
    marked = docs.select(F.struct("*").alias("row"), own_key, own_text)
    marked = with_fingerprints(marked, "text", "print", words).drop("text")
    rows = with_fingerprints(docs.select(own_key, own_text), "text", "print", words)
    rows = materialize(rows.select("key", "print"))
    groups = _groups(rows, max_bits, blocks)
    keep = groups.select(F.col("component_id").alias("key2"), F.col("keep_print").alias("print2")).distinct()
    same = (F.col("print") == F.col("print2")) & F.col("key").eqNullSafe(F.col("key2"))
    return marked.join(keep, same).dropDuplicates(["print", "key"]).select("row.*")
