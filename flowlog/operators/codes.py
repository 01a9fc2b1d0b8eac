"""An index of short codes beside stored vectors, for approximate nearest neighbours.

A vector is the pivot of its cell plus a residual, and the residual is cut into parts that are each replaced by the nearest of 256
known ones: a byte a part. Pivots and parts are fitted once, on a bounded sample; files that come later are encoded with
them. A search scans the codes only, an eighth of the bytes of 32-bit vectors or less, keeps the best candidates of every query and ranks those by
their true distances.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import BinaryType, DoubleType, ShortType, StructField, StructType

from ..functions import similarity_pct
from ..schema import SEARCH_K
from .knn import _TILE, PIVOT_SAMPLE, SCAN_SHARE, _asked, _at_most, _matrix, _means, _type_of, _usable

PARTS, CELLS, KNOWN = 16, 64, 256
CANDIDATES = 20  # per neighbour asked for
MAX_QUERIES = 131_072
_STEP = 16_384
_CELLS = 1 << 20  # of a matrix of distances
_FOUND = 1 << 18  # rows of a batch of candidates


@dataclass(frozen=True)
class CodeModel:
    """Pivots and, for each part of a residual, the known ones; and the sample's vectors as their codes say."""

    pivots: np.ndarray  # cells, dimensions
    known: list[np.ndarray]  # per part: up to 256, width
    sample: np.ndarray

    def encode(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell and code of each vector."""
        cell = _nearest_row(vectors, self.pivots)
        residual = vectors - self.pivots[cell]
        code = np.empty((len(vectors), len(self.known)), np.uint8)
        for j, (part, known) in enumerate(zip(np.array_split(residual, len(self.known), axis=1), self.known, strict=True)):
            code[:, j] = _nearest_row(part, known)
        return cell.astype(np.int16), code

    def decode(self, cell: np.ndarray, code: np.ndarray) -> np.ndarray:
        parts = [known[code[:, j]] for j, known in enumerate(self.known)]
        return (self.pivots[cell] + np.concatenate(parts, axis=1)).astype(np.float32)


def _nearest_row(rows: np.ndarray, of: np.ndarray) -> np.ndarray:
    squares, twice = (of**2).sum(axis=1), -2.0 * of.T
    out = np.empty(len(rows), np.int64)
    for at in range(0, len(rows), _TILE):
        gaps = rows[at : at + _TILE] @ twice
        gaps += squares
        out[at : at + _TILE] = gaps.argmin(axis=1)
    return out


def fit_codes(vectors: DataFrame, parts: int = PARTS, cells: int = CELLS) -> CodeModel:
    """Fit pivots and parts on at most ``PIVOT_SAMPLE`` vectors, those with the least hash of their id."""
    picked = _usable(vectors).orderBy(F.xxhash64("id"), "id").limit(PIVOT_SAMPLE).collect()
    if not picked:
        raise ValueError("no vectors to fit codes on")
    points = np.array([row.embedding for row in picked], dtype=np.float64)
    pivots = _means(points, np.unique(points[:cells], axis=0))
    residual = points - pivots[_nearest_row(points, pivots)]
    known = [_means(part, np.unique(part[:KNOWN], axis=0)) for part in np.array_split(residual, min(parts, points.shape[1]), axis=1)]
    model = CodeModel(pivots, known, np.zeros((0, points.shape[1]), np.float32))
    return CodeModel(pivots, known, model.decode(*model.encode(points)))


def encode_vectors(vectors: DataFrame, model: CodeModel) -> DataFrame:
    """``vectors`` with ``cell`` and ``code``; those without an id or an embedding go. Store it by source file."""
    rows = vectors.where(F.col("embedding").isNotNull() & F.col("id").isNotNull())
    sent = vectors.sparkSession.sparkContext.broadcast(model)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell, code = sent.value.encode(_matrix(batch.column("embedding")))
                codes = pa.array([row.tobytes() for row in code], pa.binary())
                yield batch.append_column("cell", pa.array(cell)).append_column("code", codes)

    schema = StructType([*rows.schema.fields, StructField("cell", ShortType()), StructField("code", BinaryType())])
    return rows.mapInArrow(encode, schema)


def _bounds(sample: np.ndarray, q: np.ndarray, share: float, most: int) -> np.ndarray:
    """How far a candidate may be, by codes: about twice as many as wanted are nearer in all vectors, judged by the sample."""
    wanted = int(2 * most * share) + 8
    if wanted >= len(sample):
        return np.full(len(q), np.inf, np.float32)
    squares = (sample**2).sum(axis=1)
    out = np.empty(len(q), np.float32)
    step = max(1, _CELLS // len(sample))
    for at in range(0, len(q), step):
        part = slice(at, at + step)
        out[part] = np.partition(squares - 2 * (q[part] @ sample.T), wanted, axis=1)[:, wanted]
    return out


def knn_codes(coded: DataFrame, queries: DataFrame, model: CodeModel, k: int = SEARCH_K, candidates: int = CANDIDATES) -> DataFrame:
    """Approximate ``knn_search`` over vectors of :func:`encode_vectors`: the same columns, true distances.

    At most ``MAX_QUERIES`` queries are asked in one scan; a larger table is asked in as many scans as it takes.
    """
    asked = _asked(queries).select("query_id", "embedding")
    # Queries are asked in hashed groups of about half the bound, so that none exceeds it by chance
    groups = -(-2 * asked.count() // MAX_QUERIES) if asked.count() > MAX_QUERIES else 1
    found, stored = None, coded.count()
    for group in range(groups):
        some = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(groups)) == group)
        near = _with_distances(coded, some, _candidates(coded, some, model, k * candidates, stored))
        found = near if found is None else found.unionByName(near)
    extra = [c for c in coded.columns if c not in ("id", "embedding", "cell", "code")]
    nearest = Window.partitionBy("query_id").orderBy("distance", "id")
    ranked = found.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "id", "distance", similarity_pct(F.col("distance")).alias("similarity"), *extra)


def _with_distances(coded: DataFrame, asked: DataFrame, near: DataFrame) -> DataFrame:
    """``near`` pairs with their true distances and the further columns of ``coded``; queries do not travel with their pairs."""
    head = asked.toArrow()
    names, q = head.column("query_id").combine_chunks(), _matrix(head.column("embedding"))
    sent = coded.sparkSession.sparkContext.broadcast((names, q))
    pairs = coded.drop("cell", "code").join(near, "id")
    kept = [f for f in pairs.schema.fields if f.name != "embedding"]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q = sent.value
        for batch in batches:
            if batch.num_rows:
                at = pc.index_in(batch.column("query_id"), value_set=names).to_numpy(zero_copy_only=False)
                gap = _matrix(batch.column("embedding")) - q[at]
                distance = pa.array(np.einsum("ij,ij->i", gap, gap))
                yield batch.select([f.name for f in kept]).append_column("distance", distance)

    return pairs.mapInArrow(measure, StructType([*kept, StructField("distance", DoubleType())]))


def _candidates(coded: DataFrame, asked: DataFrame, model: CodeModel, most: int, count: int | None = None) -> DataFrame:
    """``query_id, id``: the ``most`` vectors that are nearest to each query by their codes.

    One in ``SCAN_SHARE`` vectors is scanned first, if these are more than the model's sample: the more of all vectors give
    the bounds, the fewer beyond ``most`` are found, written and sorted.
    """
    head = asked.toArrow()
    if not head.num_rows:
        return coded.where(F.lit(False)).select(F.lit(None).cast(_type_of(asked, "query_id")).alias("query_id"), "id")
    names, q = head.column("query_id").combine_chunks(), _matrix(head.column("embedding")).astype(np.float32)
    count = coded.count() if count is None else count
    bounds = _bounds(model.sample, q, min(1.0, len(model.sample) / max(1, count)), most)
    sent = coded.sparkSession.sparkContext.broadcast((model, q, names))
    query_id, some = _type_of(asked, "query_id"), count // SCAN_SHARE
    if some > len(model.sample):
        wanted = 2 * most // SCAN_SHARE + 8
        loose = _bounds(model.sample, q, len(model.sample) / some, wanted)
        seen = _scan(coded.where(F.pmod(F.xxhash64("id"), F.lit(SCAN_SHARE)) == 0), sent, loose, wanted, query_id)
        best = Window.partitionBy("q").orderBy("near")
        last = seen.withColumn("r", F.row_number().over(best)).where(F.col("r") <= wanted).where(F.col("r") == wanted)
        last = last.select("q", "near").toArrow()
        at = last.column("q").to_numpy()
        bounds[at] = np.minimum(bounds[at], last.column("near").to_numpy())
    best = Window.partitionBy("query_id").orderBy("near", "id")
    found = _scan(coded, sent, bounds, most, query_id).drop("q")
    return found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= most).select("query_id", "id")


def _scan(coded: DataFrame, asked, bounds: np.ndarray, most: int, query_id: str) -> DataFrame:  # noqa: ANN001
    """``q, query_id, id, near``: what each task finds within the bounds of the queries; ``asked`` is broadcast."""
    id_type = to_arrow_type(coded.schema["id"].dataType)
    reach = coded.sparkSession.sparkContext.broadcast(bounds)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, q, names = asked.value
        left = np.concatenate((q, np.ones((len(q), 1), np.float32)), axis=1)
        limit = reach.value.copy()  # of what this task has seen
        kept, room = _Kept(most), _FOUND
        for batch in batches:
            for at in range(0, batch.num_rows, _STEP):
                some = batch.slice(at, _STEP)
                code = np.frombuffer(b"".join(some.column("code").to_pylist()), np.uint8).reshape(some.num_rows, -1)
                vectors = model.decode(some.column("cell").to_numpy(), code)
                right = np.concatenate((-2 * vectors, (vectors**2).sum(axis=1)[:, None]), axis=1)
                first = kept.ids_from(some.column("id"))
                for start in range(0, len(right), _TILE):
                    tile = right[start : start + _TILE].T
                    step = max(1, _CELLS // tile.shape[1])
                    out = np.empty((min(step, len(q)), tile.shape[1]), np.float32)
                    for lo in range(0, len(q), step):
                        gaps = np.matmul(left[lo : lo + step], tile, out=out[: len(q[lo : lo + step])])
                        bound = limit[lo : lo + step]
                        i, j = _at_most(gaps, bound)
                        if len(i) > most * len(gaps) and gaps.shape[1] > most:
                            i, j = _at_most(gaps, np.minimum(bound, np.partition(gaps, most - 1, axis=1)[:, most - 1]))
                        kept.add(i + lo, j + start + first, gaps[i, j])
                if kept.size > room:
                    kept.reduce(limit)
                    room = max(_FOUND, 2 * kept.size)
        kept.reduce(limit)
        for rows, ids, near in kept.parts():
            arrays = [pa.array(rows), names.take(pa.array(rows)), ids.cast(id_type), pa.array(near)]
            yield pa.RecordBatch.from_arrays(arrays, ["q", "query_id", "id", "near"])

    out = f"q int, query_id {query_id}, id {_type_of(coded, 'id')}, near float"
    return coded.select("id", "cell", "code").mapInArrow(scan, out)


class _Kept:
    """What a task has found: the ``most`` nearest of every query, and those as near as the last of them."""

    def __init__(self, most: int):
        self.most, self.size, self.ids = most, 0, []
        self.seen, self.found = 0, []

    def ids_from(self, ids: pa.Array) -> int:
        """Note the ids of some vectors; the place of the first."""
        self.ids.append(ids)
        self.seen += len(ids)
        return self.seen - len(ids)

    def add(self, rows: np.ndarray, places: np.ndarray, near: np.ndarray) -> None:
        if len(rows):
            self.found.append((rows.astype(np.int32), places, near))
            self.size += len(rows)

    def reduce(self, limit: np.ndarray) -> None:
        """Drop what cannot be among the nearest; lower ``limit`` to what is left."""
        if not self.found:
            return
        rows, places, near = (np.concatenate(x) for x in zip(*self.found, strict=True))
        order = np.lexsort((near, rows))
        rows, places, near = rows[order], places[order], near[order]
        start = np.searchsorted(rows, rows)
        last = start + self.most - 1
        full = (last < len(rows)) & (rows[np.minimum(last, len(rows) - 1)] == rows)
        limit[rows[full]] = np.minimum(limit[rows[full]], near[last[full]])
        stay = near <= limit[rows]
        self.found = [(rows[stay], places[stay], near[stay])]
        self.size = int(stay.sum())
        # ids of dropped vectors are not kept
        used, places = np.unique(self.found[0][1], return_inverse=True)
        self.ids, self.seen = [pa.chunked_array(self.ids).take(pa.array(used)).combine_chunks()], len(used)
        self.found = [(self.found[0][0], places, self.found[0][2])]

    def parts(self) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray]]:
        for rows, places, near in self.found:
            for at in range(0, len(rows), _FOUND):
                part = slice(at, at + _FOUND)
                yield rows[part], self.ids[0].take(pa.array(places[part])), near[part]
