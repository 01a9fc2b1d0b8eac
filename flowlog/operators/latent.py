"""Text vectors in which words that occur together are near: term weights reduced by a distributed randomised SVD.

Terms are hashed to ``size`` columns and weighted by their rarity, as for ``embed_messages``. The reduction needs the leading
right singular vectors of the table of all texts, which no task and not the driver could hold. A random basis of a few columns is multiplied by the
table and by its transpose, text by text inside the tasks; the products, ``size`` rows of a few numbers per task, are added up by
row, and the driver makes the sum orthogonal. After a few rounds the basis spans the leading vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

SIZE, RANK, EXTRA, ROUNDS = 4096, 64, 16, 4
_STEP = 4096


@dataclass(frozen=True)
class LatentModel:
    """Rarity weights of the hashed terms, and the basis that their vectors are projected on."""

    weights: np.ndarray  # size
    basis: np.ndarray  # size, rank

    def save(self, path: str) -> None:
        with open(path, "wb") as out:
            np.savez(out, weights=self.weights, basis=self.basis)

    @classmethod
    def load(cls, path: str) -> LatentModel:
        with np.load(path) as stored:
            return cls(stored["weights"], stored["basis"])


def term_columns(text: str, size: int) -> Column:
    """The hashed column of every term of a text."""
    terms = F.filter(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}.]+"), lambda t: t != "")
    return F.transform(terms, lambda t: F.pmod(F.xxhash64(t), F.lit(size)).cast("int"))


class _Rows:
    """Unit rows of weighted term counts of some texts, as parallel arrays of row, column and value."""

    def __init__(self, column: pa.ListArray, weights: np.ndarray):
        n, size = len(column), len(weights)
        offsets = column.offsets.to_numpy()
        columns = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(n), np.diff(offsets))
        cell, times = np.unique(row * size + columns, return_counts=True)
        self.n, self.size = n, size
        self.row, self.column = cell // size, cell % size
        value = times * weights[self.column]
        norm = np.sqrt(np.bincount(self.row, value * value, minlength=n))
        self.value = value / np.maximum(norm, 1e-300)[self.row]

    def times(self, basis: np.ndarray) -> np.ndarray:
        out = np.zeros((self.n, basis.shape[1]))
        if len(self.row):
            first = np.flatnonzero(np.append(True, np.diff(self.row) != 0))
            out[self.row[first]] = np.add.reduceat(self.value[:, None] * basis[self.column], first, axis=0)
        return out

    def transposed_times(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The columns that occur, and their rows of the product."""
        order = np.argsort(self.column, kind="stable")
        columns = self.column[order]
        first = np.flatnonzero(np.append(True, np.diff(columns) != 0)[: len(columns)])
        product = self.value[order, None] * rows[self.row[order]]
        return columns[first], np.add.reduceat(product, first, axis=0) if len(first) else product


def _product(texts: DataFrame, weights: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """A'A times ``basis``, A the table of all texts: summed by task, then by column of A."""
    size, width = basis.shape
    schema = "i int, values array<double>"

    def rows_of(table: np.ndarray, used: np.ndarray) -> pa.RecordBatch:
        offsets = pa.array(np.arange(len(used) + 1, dtype=np.int32) * width)
        values = pa.ListArray.from_arrays(offsets, pa.array(table[used].ravel()))
        return pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), values], ["i", "values"])

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, used = np.zeros((size, width)), np.zeros(size, bool)
        for batch in batches:
            for at in range(0, batch.num_rows, _STEP):
                rows = _Rows(_lists(batch, at), weights)
                columns, product = rows.transposed_times(rows.times(basis))
                total[columns] += product
                used[columns] = True
        if used.any():
            yield rows_of(total, np.flatnonzero(used))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, used = np.zeros((size, width)), np.zeros(size, bool)
        for batch in batches:
            i = batch.column("i").to_numpy()
            np.add.at(total, i, batch.column("values").flatten().to_numpy().reshape(-1, width))
            used[i] = True
        if used.any():
            yield rows_of(total, np.flatnonzero(used))

    summed = texts.mapInArrow(multiply, schema).repartition("i").mapInArrow(add, schema).toPandas()  # a row per column of A
    out = np.zeros((size, width))
    if len(summed):
        out[summed["i"].to_numpy()] = np.stack(summed["values"].to_list())
    return out


def _lists(batch: pa.RecordBatch, at: int) -> pa.ListArray:
    """A step of term lists with offsets from 0."""
    part = batch.column(batch.num_columns - 1).slice(at, _STEP)
    return pa.concat_arrays([part])


def fit_latent(
    texts: DataFrame, column: str = "document", rank: int = RANK, size: int = SIZE, rounds: int = ROUNDS, seed: int = 7
) -> LatentModel:
    """Learn weights and basis from a column of texts; one pass for the weights and one per round. Nulls are left out."""
    terms = texts.where(F.col(column).isNotNull()).select(term_columns(column, size).alias("terms"))
    seen = terms.select(F.explode(F.array_distinct("terms")).alias("i")).groupBy("i").count().toPandas()  # at most ``size`` rows
    n = terms.count()
    frequency = np.zeros(size)
    frequency[seen["i"].to_numpy(int)] = seen["count"].to_numpy()
    weights = np.log((n + 1) / (frequency + 1))
    width = min(size, rank + EXTRA)
    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(size, width)))[0]
    for _ in range(rounds):
        product = _product(terms, weights, basis)
        basis = np.linalg.qr(product)[0]
    product = _product(terms, weights, basis)
    values, vectors = np.linalg.eigh(basis.T @ product)
    return LatentModel(weights, basis @ vectors[:, np.argsort(-values)[:rank]])


def embed_latent(df: DataFrame, model: LatentModel, column: str = "document") -> DataFrame:
    """Add ``embedding``: the unit vector of a text in the model's space, zero if none of its terms was seen. Null texts go."""
    size = len(model.weights)
    rows = df.where(F.col(column).isNotNull())
    sent = df.sparkSession.sparkContext.broadcast(model)
    rank = model.basis.shape[1]
    kept = df.columns

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [np.zeros((0, rank))]
            for at in range(0, batch.num_rows, _STEP):
                vectors = _Rows(_lists(batch, at), sent.value.weights).times(sent.value.basis)
                norm = np.linalg.norm(vectors, axis=1, keepdims=True)
                parts.append(vectors / np.where(norm > 1e-12, norm, 1))
            offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * rank)
            values = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(parts).ravel().astype(np.float32)))
            yield batch.select(kept).append_column("embedding", values)

    schema = StructType([*df.schema.fields, StructField("embedding", ArrayType(FloatType()))])
    return rows.withColumn("_terms", term_columns(column, size)).mapInArrow(embed, schema)
