"""A quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE_WORDS`` words. Every passage is encoded: measures of its bytes and words and
hashed word counts go through one tanh layer. Gated attention weighs the passages, softmax(w . (tanh(V h) * sigmoid(U h))),
and the document's score is a logistic function of the weighted sum. Encoder, attention and output are learned together from
document labels only.

The model is fitted by the driver on at most ``TRAIN_DOCS`` labelled documents, those with the least hash, and at most
``TRAIN_PASSAGES`` passages: a document that is too long for what is left of these is passed over, all others are learned from
whole. Only their passages' features are gathered. Scoring takes every passage of every document in tasks, a long text block by
block.

Null and empty texts are a bag of one passage without words. If no labels, or only one class, can be learned from, the
score is the share of label 1 among them (0.5 without any). Repeated labels of a document count once, as the higher one.
Repeated rows get the same score; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .batches import slices, texts
from .columns import held_out, word_count

PASSAGE_WORDS = 64
TRAIN_DOCS = 6000
TRAIN_PASSAGES = 100_000  # of all these together
HASHED = 64
BLOCK_BYTES = 2 << 20
HIDDEN = 24
ATTENTION = 12
EPOCHS = 40
FOLDS, FOLD = 3, 1

_SPACE, _LOWER, _UPPER, _DIGIT, _END, _SYMBOL, _OTHER, _HIGH = range(8)


def _classes() -> np.ndarray:
    table = np.full(256, _OTHER, np.uint8)
    table[128:] = _HIGH
    for chars, kind in (
        (b" \t\r\x0b\f\n", _SPACE),
        (b"abcdefghijklmnopqrstuvwxyz", _LOWER),
        (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", _UPPER),
        (b"0123456789", _DIGIT),
        (b".,;:?!'\"()-", _END),
        (b"#*$%&|<>", _SYMBOL),
    ):
        table[list(chars)] = kind
    return table


_CLASS = _classes()
_MIX = np.random.default_rng(7).integers(1, 2**63, 256, np.uint64) | np.uint64(1)
_STEP = np.random.default_rng(8).integers(1, 2**63, 64, np.uint64) | np.uint64(1)
MEASURES = 18


def _blocks(text: bytes) -> Iterator[bytes]:
    """A long text in parts of about ``BLOCK_BYTES``, of whole passages each but the last."""
    at, size = 0, BLOCK_BYTES
    while len(text) - at > size:
        space = _CLASS[np.frombuffer(text, np.uint8, size, at)] == _SPACE
        begin = np.flatnonzero(~space & np.append(True, space[:-1]))
        whole = (len(begin) - 1) // PASSAGE_WORDS * PASSAGE_WORDS
        if whole <= 0:
            size *= 2  # very long words
            continue
        yield text[at : at + begin[whole]]
        at, size = at + int(begin[whole]), BLOCK_BYTES
    yield text[at:]


def passage_features(values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of all texts, and the index of each text's first passage."""
    if all(len(value) <= BLOCK_BYTES for value in values):
        return _features(values)
    parts, first, n = [], [], 0
    for value in values:
        first.append(n)
        for block in _blocks(value):
            parts.append(_features([block])[0])
            n += len(parts[-1])
    return np.concatenate(parts), np.array(first, np.int64)


def _features(values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b"\n" + b"\n".join(values) + b"\n", np.uint8)
    kinds = _CLASS[data]
    space = kinds == _SPACE
    begin = np.flatnonzero(~space[1:] & space[:-1]) + 1
    end = np.flatnonzero(space[1:] & ~space[:-1]) + 1
    text_start = np.cumsum([1, *(len(v) + 1 for v in values)])[:-1]
    first_word = np.searchsorted(begin, text_start)
    n_words = np.diff(np.append(first_word, len(begin)))
    n_passages = np.maximum(1, -(-n_words // PASSAGE_WORDS))
    first_passage = np.concatenate(([0], np.cumsum(n_passages)[:-1]))
    total = int(n_passages.sum())
    if not len(begin):
        out = np.zeros((total, MEASURES + HASHED), np.float32)
        out[:, 0] = 1
        return out, first_passage
    doc = np.repeat(np.arange(len(values)), n_words)
    passage = first_passage[doc] + (np.arange(len(begin)) - first_word[doc]) // PASSAGE_WORDS
    length = end - begin
    per = lambda x: np.bincount(passage, x, minlength=total)
    counts = {}
    for kind in (_LOWER, _UPPER, _DIGIT, _END, _SYMBOL, _OTHER, _HIGH):
        run = np.cumsum(kinds == kind)
        counts[kind] = per(run[end - 1] - run[begin - 1])
    lines = np.cumsum(data == 10)
    newline = per((lines[begin] - lines[np.append(begin[0] - 1, begin[:-1])]).clip(0, 3))
    words = per(np.ones(len(begin)))
    chars = np.maximum(1, per(length))
    some = np.maximum(1, words)
    # a word's hash: a sum of its bytes' values, each by its place
    inside = np.flatnonzero(~space)
    place = inside - np.repeat(begin, length)
    mixed = _MIX[data[inside]] * _STEP[place & 63]
    offsets = np.concatenate(([0], np.cumsum(length)[:-1]))
    hashes = np.add.reduceat(mixed, offsets)
    hashes ^= hashes >> np.uint64(29)
    hashes *= np.uint64(0x9E3779B97F4A7C15)
    order = np.lexsort((hashes, passage))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (passage[order][1:] != passage[order][:-1])
    distinct = np.bincount(passage[order][fresh], minlength=total)
    again = np.zeros(len(begin))
    again[1:] = (hashes[1:] == hashes[:-1]) & (passage[1:] == passage[:-1])
    edge = kinds[end - 1]
    measures = [
        (words == 0) * 1.0,
        np.log1p(words) / 4,
        chars / some / 8,
        *(counts[kind] / chars for kind in (_LOWER, _UPPER, _DIGIT, _END, _SYMBOL, _OTHER, _HIGH)),
        newline / some * 4,
        distinct / some,
        per(again) / some,
        per(length <= 3) / some,
        per(length >= 14) / some * 4,
        per((edge == _SYMBOL) * 1.0) / some,
        per((data[end - 1] == ord("!")) * 1.0) / some,
        per((length == 1) & (edge == _SYMBOL)) / some,
    ]
    bucket = (hashes >> np.uint64(58)).astype(np.int64)
    hashed = np.bincount(passage * HASHED + bucket, minlength=total * HASHED).reshape(total, HASHED)
    hashed = np.sqrt(hashed / some[:, None])
    return np.concatenate([np.stack(measures, axis=1), hashed], axis=1).astype(np.float32), first_passage


def _segments(first: np.ndarray, total: int) -> np.ndarray:
    return np.repeat(np.arange(len(first)), np.diff(np.append(first, total)))


class AttentionModel:
    """Weights of encoder, gated attention and output; plain numpy, small enough to travel with a task."""

    def __init__(self, features: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        scale = lambda *shape: rng.normal(0, shape[0] ** -0.5, shape)
        self.mean, self.std = np.zeros(features), np.ones(features)
        self.w = {
            "E": scale(features, HIDDEN),
            "e": np.zeros(HIDDEN),
            "V": scale(HIDDEN, ATTENTION),
            "U": scale(HIDDEN, ATTENTION),
            "a": scale(ATTENTION, 1)[:, 0],
            "o": scale(HIDDEN, 1)[:, 0],
            "b": np.zeros(1),
        }

    def forward(self, x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, tuple]:
        w, doc = self.w, _segments(first, len(x))
        x = np.clip((x - self.mean) / self.std, -8, 8)
        h = np.tanh(x @ w["E"] + w["e"])
        t, g = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
        logit = (t * g) @ w["a"]
        weight = np.exp(logit - np.maximum.reduceat(logit, first)[doc])
        weight /= np.add.reduceat(weight, first)[doc]
        z = np.add.reduceat(weight[:, None] * h, first)
        score = 1 / (1 + np.exp(-np.clip(z @ w["o"] + w["b"], -30, 30)))
        return score, (x, h, t, g, weight, z, doc)

    def gradient(self, kept: tuple, error: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        x, h, t, g, weight, z, doc = kept
        w = self.w
        dz = error[:, None] * w["o"]
        dh = weight[:, None] * dz[doc]
        dweight = (h * dz[doc]).sum(axis=1)
        dlogit = weight * (dweight - np.add.reduceat(weight * dweight, first)[doc])
        dt = dlogit[:, None] * w["a"] * g * (1 - t * t)
        dg = dlogit[:, None] * w["a"] * t * g * (1 - g)
        dh = dh + dt @ w["V"].T + dg @ w["U"].T
        dx = dh * (1 - h * h)
        return {
            "E": x.T @ dx,
            "e": dx.sum(axis=0),
            "V": h.T @ dt,
            "U": h.T @ dg,
            "a": (t * g).T @ dlogit,
            "o": z.T @ error,
            "b": np.array([error.sum()]),
        }

    def fit(self, bags: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, size: int = 128) -> AttentionModel:
        """Adam on the logistic loss with a little weight decay."""
        everything = np.concatenate(bags).astype(np.float64)
        self.mean, self.std = everything.mean(axis=0), everything.std(axis=0) + 1e-3
        rng = np.random.default_rng(2)
        first_moment = {k: np.zeros_like(v) for k, v in self.w.items()}
        second_moment = {k: np.zeros_like(v) for k, v in self.w.items()}
        step = 0
        for epoch in range(epochs):
            rate = 0.01 * (1 - epoch / epochs) + 1e-4
            order = rng.permutation(len(bags))
            for i in range(0, len(order), size):
                chosen = order[i : i + size]
                lengths = [len(bags[j]) for j in chosen]
                first = np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64)
                score, kept = self.forward(np.concatenate([bags[j] for j in chosen]), first)
                slope = self.gradient(kept, (score - labels[chosen]) / len(chosen), first)
                step += 1
                for k in self.w:
                    d = slope[k] + 1e-4 * self.w[k]
                    first_moment[k] = 0.9 * first_moment[k] + 0.1 * d
                    second_moment[k] = 0.999 * second_moment[k] + 0.001 * d * d
                    rise = first_moment[k] / (1 - 0.9**step)
                    self.w[k] -= rate * rise / (np.sqrt(second_moment[k] / (1 - 0.999**step)) + 1e-8)
        return self


def _bags(rows: DataFrame) -> DataFrame:
    """``hash, label, features`` (float32 bytes) of ``hash, label, text``."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            x, first = passage_features(texts(batch, "text"))
            bags = [x[a:b].tobytes() for a, b in zip(first, np.append(first[1:], len(x)), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("hash"), batch.column("label"), pa.array(bags, pa.binary())],
                ["hash", "label", "features"],
            )

    return rows.mapInArrow(encode, "hash bigint, label int, features binary")


def _sample(rows: DataFrame, most_docs: int, most_passages: int) -> DataFrame:
    """``hash, label, text`` of whole documents: the first ones by hash, as many as the bounds allow; equal rows once."""
    passages = F.greatest(F.lit(1), F.ceil(word_count("text") / PASSAGE_WORDS))
    own = F.xxhash64("text")
    sizes = rows.select("hash", own.alias("own"), passages.alias("n")).distinct().orderBy("hash", "own", "n").limit(most_docs)
    chosen, left = [], most_passages
    for row in sizes.collect():  # most_docs at most
        if row.n <= left:  # a document too long for the rest of the sample is passed over
            left -= row.n
            chosen.append((row.hash, row.own))
    table = rows.sparkSession.createDataFrame(chosen, "hash2 bigint, own2 bigint")
    same = (F.col("hash") == F.col("hash2")) & (own == F.col("own2"))
    return rows.join(F.broadcast(table), same).groupBy("hash", "label", own.alias("own")).agg(F.first("text").alias("text"))


def learn_quality(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    most_docs: int = TRAIN_DOCS,
    most_passages: int = TRAIN_PASSAGES,
) -> AttentionModel | float:
    """The model, or the share of label 1 when there are not two classes to tell apart."""
    known = labels.select(F.col(key).alias("key2"), F.col(label).cast("int").alias("label")).dropna()
    known = known.groupBy("key2").agg(F.max("label").alias("label"))
    rank = F.xxhash64(F.col("key2").cast("string"))
    known = known.select("*", rank.alias("hash")).orderBy("hash", "key2").limit(most_docs)
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    rows = rows.join(F.broadcast(known), F.col("key") == F.col("key2")).select("hash", "label", "text")
    gathered = _bags(_sample(rows, most_docs, most_passages).select("hash", "label", "text")).toPandas()
    if not len(gathered):
        return 0.5
    # the order of rows must not depend on how tasks end
    gathered = gathered.sort_values(["hash", "features"], ignore_index=True)
    y = gathered.label.to_numpy(float)
    if y.min() == y.max():
        return float(y.mean())
    bags = [np.frombuffer(f, np.float32).reshape(-1, MEASURES + HASHED) for f in gathered.features]
    return AttentionModel(MEASURES + HASHED).fit(bags, y)


def score_quality(docs: DataFrame, model: AttentionModel | float, text: str, column: str = "score") -> DataFrame:
    """``docs`` and the score of each row."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            if isinstance(model, float):
                values = np.full(batch.num_rows, model)
            else:
                values = model.forward(*passage_features(texts(batch, text)))[0]
            yield batch.append_column(column, pa.array(values, pa.float64()))

    return docs.mapInArrow(score, StructType([*docs.schema, StructField(column, DoubleType())]))


def quality_scores(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality"
) -> DataFrame:
    """``<key>, held_out, score, predicted`` of every row; held out rows are not learned from."""
    kept = labels.where(~held_out(key, FOLDS, FOLD))
    model = learn_quality(docs, kept, key, text, label)
    out: Column = held_out("key", FOLDS, FOLD)
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    rows = score_quality(rows, model, "text").select(
        F.col("key").alias(key), out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
    return rows


def keep_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject."""
    model = learn_quality(docs, labels.where(~held_out(key, FOLDS, FOLD)), key, text)
    marked = docs.select(F.struct("*").alias("row"), F.col(text).cast("string").alias("text"))
    return score_quality(marked, model, "text").where("score >= 0.5").select("row.*")
