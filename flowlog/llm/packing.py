"""Pack tokenized documents into fixed windows by non-negative least squares.

A document's token ids, with an end id, are cut into windows of ``WINDOW`` ids and one remainder. All that the plan needs is
the histogram of remainder lengths, ``WINDOW`` numbers however large the corpus. Shallow combinations of lengths that fill a
window exactly are enumerated from it, their repeat counts are solved by non-negative least squares against the histogram and
rounded down, and what is left is packed greedily, one pattern for all the rest that it fits. Tasks then place every piece
from its rank among the pieces of its length. A length that very many pieces share is ranked in buckets of bounded size.

Null and empty texts are the end id alone. Repeated rows are packed as often as they come. No rows give no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .batches import slices, texts
from .encoding import tokenizer_path, worker_encoder

WINDOW = 2048
END_ID = 1
TOKENIZER = "byte_bpe_50k.json"
#: Partners of a length that three- and four-part combinations try: the most frequent and evenly spaced ones.
PARTNERS = 16
PARTS, HOT = 8, 4
ROUNDS = 300
BUCKET = 100_000
_SLICE = 2 << 20


def token_pieces(docs: DataFrame, key: str, text: str, window: int = WINDOW, tokenizer: str | None = None) -> DataFrame:
    """``key, start, length, ids_crc32, doc_tokens`` of every window and remainder."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = worker_encoder(tokenizer_path(TOKENIZER, tokenizer), True, False), np.array([END_ID], "<u4").tobytes()
        for batch in slices(batches, "text", _SLICE, keep=True):
            which, numbers = [], []
            for i, ids in enumerate(encoder.encode(texts(batch, "text"))):
                raw = ids.astype("<u4").tobytes() + end
                total = len(ids) + 1
                for start in range(0, total, window):
                    piece = raw[4 * start : 4 * (start + window)]
                    which.append(i)
                    numbers.append((start, len(piece) // 4, zlib.crc32(piece), total))
            columns = [pa.array(column, pa.int64()) for column in zip(*numbers, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key").take(pa.array(which)), *columns],
                ["key", "start", "length", "ids_crc32", "doc_tokens"],
            )

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(
        cut, f"key {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
    )


def combinations_of(histogram: np.ndarray, window: int = WINDOW, partners: int = PARTNERS) -> np.ndarray:
    """Rows of up to ``PARTS`` lengths, largest first and padded with 0, that sum to ``window`` and occur.

    Pairs are complete. Three and four parts take the middle ones from ``partners`` lengths, half of them the most frequent,
    half evenly spaced over those that occur. The most frequent lengths are also repeated, with one or two parts to complete
    the window.
    """
    present = np.flatnonzero(histogram)
    present = present[present > 0]
    if not len(present):
        return np.zeros((0, PARTS), np.int64)
    often = present[np.argsort(-histogram[present], kind="stable")[: partners // 2]]
    spread = present[np.linspace(0, len(present) - 1, min(len(present), partners // 2)).astype(np.int64)]
    middle = np.unique(np.concatenate([often, spread]))
    fixed = [(), *((b,) for b in middle), *((b, c) for i, b in enumerate(middle) for c in middle[i:])]
    fixed += [(b,) * n for b in often[:HOT] for n in range(1, PARTS)]
    found = []
    for parts in fixed:
        rest = window - sum(parts)
        # one free part, or two of which the second completes the window
        last = [rest - present] if len(parts) + 2 <= PARTS else []
        if 0 < rest < window and histogram[rest]:
            found.append([*parts, rest])
        for completing in last:
            good = (completing > 0) & (completing < window)
            good[good] = histogram[completing[good]] > 0
            found += [[*parts, a, z] for a, z in zip(present[good], completing[good], strict=True)]
    rows = np.zeros((len(found), PARTS), np.int64)
    for i, parts in enumerate(found):
        rows[i, : len(parts)] = sorted(parts, reverse=True)
    return np.unique(rows, axis=0)


def solve_counts(combos: np.ndarray, histogram: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Repeat counts x >= 0 with least ||A x - h||, by projected gradient steps with momentum.

    Column j of A counts the lengths in ``combos[j]``. A step is scaled by the bound of each column's sum.
    """
    if not len(combos):
        return np.zeros(0)
    goal = histogram.astype(float).copy()
    goal[0] = 0
    used = combos > 0
    apply = lambda x: np.bincount(combos.ravel(), np.repeat(x, combos.shape[1]) * used.ravel(), minlength=len(goal))
    pull = lambda r: (r[combos] * used).sum(axis=1)
    # A'A x <= scale * x for the scale below, so 1 / scale is a safe step for each column
    scale = pull(apply(np.ones(len(combos))))
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(rounds):
        residual = apply(y) - goal
        new = np.maximum(0, y - pull(residual) / scale)
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def plan_windows(histogram: np.ndarray, window: int = WINDOW) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths and how often each is used; together they use up the histogram."""
    left = histogram.astype(np.int64).copy()
    plan: list[tuple[tuple[int, ...], int]] = []
    if left[window]:
        plan.append(((window,), int(left[window])))
        left[window] = 0
    combos = combinations_of(left, window)
    counts = np.floor(solve_counts(combos, left) + 1e-6).astype(np.int64)
    for j in np.argsort(-counts, kind="stable"):
        if not counts[j]:
            break
        pattern = tuple(int(n) for n in combos[j] if n)
        times = min([int(counts[j]), *(int(left[n]) // pattern.count(n) for n in set(pattern))])
        if times:
            plan.append((pattern, times))
            for n in pattern:
                left[n] -= times
    while len(lengths := np.flatnonzero(left)):
        room, pattern = window, []
        spare = left.copy()
        while len(fits := lengths[(lengths <= room) & (spare[lengths] > 0)]):
            n = int(fits[-1])
            # as many of this length as fit, to end in fewer steps
            many = min(room // n, int(spare[n]))
            pattern += [n] * many
            spare[n] -= many
            room -= n * many
        times = min(int(left[n]) // pattern.count(n) for n in set(pattern))
        plan.append((tuple(pattern), times))
        for n in pattern:
            left[n] -= times
    return plan


def _placed(plan: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per length: first ranks, and the sequence and offset of the piece with that rank; later ranks count on."""
    table: dict[int, list[tuple[int, int, int]]] = {}
    rank: dict[int, int] = {}
    sequence = 0
    for pattern, times in plan:
        offset = 0
        for n in pattern:
            table.setdefault(n, []).append((rank.get(n, 0), sequence, offset))
            rank[n] = rank.get(n, 0) + times
            offset += n
        sequence += times
    return {n: tuple(np.array(column) for column in zip(*rows, strict=True)) for n, rows in table.items()}


def _ranked(pieces: DataFrame, spark_rows: list) -> DataFrame:
    """``pieces`` with ``rank``, 0, 1, ... among the pieces of one length."""
    spark = pieces.sparkSession
    buckets = spark.createDataFrame(
        [(n, -(-count // BUCKET)) for n, count in spark_rows], "length2 bigint, buckets bigint"
    )
    rows = pieces.join(F.broadcast(buckets), F.col("length") == F.col("length2")).drop("length2")
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("row"), F.col("buckets"))).drop("buckets")
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    offsets = counts.select(
        F.col("length").alias("length2"),
        F.col("bucket").alias("bucket2"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"),
    )
    inside = Window.partitionBy("length", "bucket").orderBy("row")
    rows = rows.withColumn("within", F.row_number().over(inside))
    same = (F.col("length") == F.col("length2")) & (F.col("bucket") == F.col("bucket2"))
    return rows.join(offsets, same).select(
        "key", "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("within") - 1).alias("rank")
    )


def pack_documents(
    docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, tokenizer: str | None = None
) -> DataFrame:
    """``<key>, start, length, ids_crc32, doc_tokens, sequence_id, offset`` of every piece.

    Sequences are numbered from 0; offsets have no gaps.
    """
    # numbered once and for all by the checkpoint, so that equal rows are dealt out too
    pieces = materialize(token_pieces(docs, key, text, window, tokenizer).withColumn("row", F.monotonically_increasing_id()))
    # at most ``window`` rows
    rows = [(row[0], row[1]) for row in pieces.groupBy("length").count().orderBy("length").collect()]
    histogram = np.zeros(window + 1, np.int64)
    for n, count in rows:
        histogram[n] = count
    table = _placed(plan_windows(histogram, window))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                chosen = np.flatnonzero(length == n)
                first, base, place_ = table[int(n)]
                slot = np.searchsorted(first, rank[chosen], side="right") - 1
                sequence[chosen] = base[slot] + rank[chosen] - first[slot]
                offset[chosen] = place_[slot]
            out = batch.drop_columns(["rank"]).append_column("sequence_id", pa.array(sequence))
            yield out.append_column("offset", pa.array(offset))

    kind = pieces.schema["key"].dataType.simpleString()
    schema = f"key {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    return _ranked(pieces, rows).mapInArrow(place, schema).withColumnRenamed("key", key)
