"""Near copies by the true similarity of their word shingles.

Two texts are linked when their sets of five-word shingles have a Jaccard similarity of 0.8 or more. Candidates are found as
``simhash`` finds them: SimHash fingerprints of the sets, joined on pigeonhole blocks, that differ in few bits. Such
fingerprints alone cannot find all links: at 0.8 they differ in about ten bits, and blocks that allow so many are not selective. So
texts are candidates as well if MinHash says so: if they share all ``ROWS`` values of one of ``BANDS`` bands. At a similarity
of 0.8 a pair has none in common once in eight million pairs, above it less often still. Candidates are then compared by their
whole sets of shingle hashes; only true links remain.

Equal sets are one before anything is joined. A connected part of many candidates is cut into chunks, and each pair of chunks
is compared by itself; of each comparison only a spanning star of each linked part is kept.

Null and empty texts, and texts of blanks only, have the empty set. Texts with fewer words than a shingle have one shingle.
Null keys come last. No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .batches import slices, texts
from .components import components
from .simhash import fingerprint_links, majority
from .words import U, finish

SHINGLE_WORDS = 5
SIMILARITY = (4, 5)  # as a fraction, so that it is compared exactly
BANDS, ROWS = 40, 5
CHUNK = 512
CHUNK_SHINGLES = 1 << 19
SEED = 42
_BLOCK = 1 << 10
_RANDOM = np.random.default_rng(8).integers(0, 2**64, (2, BANDS * ROWS, 1), np.uint64)
_FLIP, _FACTOR = _RANDOM[0], _RANDOM[1] | U(1)


def shingles(text: bytes, words: int = SHINGLE_WORDS) -> np.ndarray:
    """The different shingle hashes of one text, ascending."""
    tokens = text.lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    joined = b" ".join(tokens)
    ends = np.fromiter(accumulate(map(len, tokens)), np.int64, len(tokens)) + np.arange(len(tokens))
    starts = np.concatenate(([0], ends[:-1] + 1))
    begin = starts[: max(0, len(tokens) - words) + 1].tolist()
    end = ends[min(words, len(tokens)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(begin, end, strict=True)], np.uint64))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One key for each band of MinHash values; no keys of the empty set."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for i in range(0, len(hashes), _BLOCK):
        np.minimum(least, ((hashes[i : i + _BLOCK] ^ _FLIP) * _FACTOR).min(axis=1), out=least)
    keys = np.arange(BANDS).astype(np.uint64)
    for values in least.reshape(BANDS, ROWS).T:
        keys = finish(keys * U(0x9E3779B97F4A7C15) + values)
    return keys.view(np.int64)


def _sketches(rows: DataFrame) -> DataFrame:
    """``own, digest, print, size, simhash, bands`` of every row of ``rows`` (``own, digest, text``); equal sets have one print."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = [shingles(value) for value in texts(batch, "text")]
            prints = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64)
            arrays = [
                batch.column("own"),
                batch.column("digest"),
                pa.array(prints.view(np.int64)),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array(np.array([majority(s) if len(s) else 0 for s in sets], np.uint64).view(np.int64)),
                pa.array([band_keys(s) for s in sets], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["own", "digest", "print", "size", "simhash", "bands"])

    kind = rows.schema["own"].dataType.simpleString()
    return rows.mapInArrow(add, f"own {kind}, digest bigint, print bigint, size bigint, simhash bigint, bands array<bigint>")


def _close_fingerprints(sets: DataFrame) -> DataFrame:
    """``hub, print``: links that connect the prints, but that of the empty set, whose SimHash chains of close pairs connect."""
    full = sets.where("size > 0").select("print", "simhash")
    full = full.withColumn("hub", F.min("print").over(Window.partitionBy("simhash")))
    equal, hubs = full.where("print != hub").select("hub", "print"), full.where("print = hub")
    a, b = (hubs.select(F.col("simhash").alias(f"simhash_{x}"), F.col("hub").alias(f"hub_{x}")) for x in "ab")
    near = fingerprint_links(hubs.select("simhash"))
    near = near.join(a, F.col("a") == F.col("simhash_a")).join(b, F.col("b") == F.col("simhash_b"))
    return equal.unionByName(near.select(F.col("hub_a").alias("hub"), F.col("hub_b").alias("print")))


def _candidates(sets: DataFrame) -> DataFrame:
    """``print, group``: the connected parts, of two prints or more, of prints whose SimHash is close or that share a band."""
    rows = sets.select("print", F.explode("bands").alias("band"))
    band = Window.partitionBy("band")
    links = rows.select("print", F.min("print").over(band).alias("hub")).where("print != hub").select("hub", "print")
    links = links.unionByName(_close_fingerprints(sets))
    roots = materialize(components(links).select(F.col("node").alias("print"), F.col("root").alias("group")))
    return roots.unionByName(roots.select(F.col("group").alias("print"), "group").distinct())


def linked_stars(prints: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links from the least print of each part that true similarity connects to its other members."""
    sizes = np.array([len(s) for s in sets])
    first = np.cumsum(sizes) - sizes
    different, rank = np.unique(np.concatenate(sets), return_inverse=True)
    open_, stars = np.ones(len(sets), bool), []
    over, under = SIMILARITY
    while open_.any():
        part = [int(np.flatnonzero(open_)[0])]
        open_[part] = False
        for member in part:  # grows
            if not open_.any():
                break
            own = np.zeros(len(different), np.int64)
            own[rank[first[member] : first[member] + sizes[member]]] = 1
            shared = np.add.reduceat(own[rank], first)
            near = open_ & (under * shared >= over * (sizes + sizes[member] - shared))
            part += np.flatnonzero(near).tolist()
            open_ &= ~near
        members = prints[part].tolist()
        stars += [(min(members), m) for m in members if m != min(members)]
    return stars


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each cell; the rows of a cell follow each other."""
    cell, prints, sets = None, [], []

    def found() -> pa.RecordBatch:
        pairs = linked_stars(np.array(prints, np.int64), sets) if prints else []
        a, b = ([p[i] for p in pairs] for i in (0, 1))
        return pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    for batch in batches:
        names = zip(*(batch.column(c).to_pylist() for c in ("group", "x", "y", "print")), strict=True)
        for i, (*at, value) in enumerate(names):
            if at != cell:
                yield found()
                cell, prints, sets = at, [], []
            prints.append(value)
            sets.append(np.frombuffer(batch.column("hashes")[i].as_py(), np.uint64))
    yield found()


def _links(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """``a, b``: links that connect exactly the prints that chains of similar candidates connect."""
    groups = _candidates(sets).withColumnRenamed("print", "print2")
    members = sets.join(groups, F.col("print") == F.col("print2"))
    group = Window.partitionBy("group")
    parts = F.greatest(F.ceil(F.count("*").over(group) / CHUNK), F.ceil(F.sum("size").over(group) / CHUNK_SHINGLES))
    placed = members.select(
        "print", "group", F.col("least.own").alias("own2"), F.col("least.digest").alias("digest2"), parts.alias("parts")
    ).withColumn("c", F.pmod(F.xxhash64("print"), "parts"))
    # one row of each print has its set; all its repetitions are in one partition
    placed = _matched(rows, placed).drop("own2", "digest2")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            hashes = pa.array([shingles(value).tobytes() for value in texts(batch, "text")], pa.binary())
            names = ["print", "group", "parts", "c"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), hashes], [*names, "hashes"])

    chunks = placed.mapInArrow(add, "print bigint, group bigint, parts bigint, c bigint, hashes binary")
    # chunk c meets chunk j in the cell (least, greatest)
    chunks = chunks.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).where("parts = 1 or c != j")
    cells = chunks.select("group", F.least("c", "j").alias("x"), F.greatest("c", "j").alias("y"), "print", "hashes")
    cells = cells.repartition("group", "x", "y").sortWithinPartitions("group", "x", "y")
    return cells.mapInArrow(_compare, "a bigint, b bigint")


def _matched(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """Rows of ``rows`` (``own, digest``) that are in ``chosen`` (``own2, digest2``), each once, by one shuffle of ``rows``."""
    same = (F.col("own") == F.col("own2")) & (F.col("digest") == F.col("digest2"))
    return rows.join(chosen, same).dropDuplicates(["own", "digest"])


def drop_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of each linked part the one with the least key, once if it is repeated."""
    own_text = F.col(text).cast("string")
    # the key in a struct: never null itself, so that plain equality joins null keys too and repetitions need no other shuffle
    own = F.struct(F.col(key).alias("key")).alias("own"), F.xxhash64(own_text).alias("digest")
    rows = docs.select(*own, own_text.alias("text"))
    least = F.min(F.struct(F.col("own.key").isNull().alias("no_key"), "own", "digest")).alias("least")
    sets = materialize(
        _sketches(rows).groupBy("print").agg(least, *(F.first(c).alias(c) for c in ("size", "simhash", "bands")))
    )
    roots = components(_links(rows, sets))
    placed = sets.join(roots, F.col("print") == F.col("node"), "left")
    best = placed.groupBy(F.coalesce("root", "print").alias("part")).agg(F.min("least").alias("best"))
    keep = best.select(F.col("best.own").alias("own2"), F.col("best.digest").alias("digest2"))
    return _matched(docs.select(F.struct("*").alias("row"), *own), keep).select("row.*")
