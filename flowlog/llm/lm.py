"""Language-model scores from a bigram trie in Elias-Fano levels.

The model has add-one unigrams and, after every word, bigrams with Dirichlet smoothing:
P(w | u) = (c(u, w) + M P(w)) / (c(u) + M). With a ``context_share``, words below that share of all tokens share one follower
class, within which the unigrams decide, and after them the unigrams decide alone; by default there is no such share. So the
probabilities of all tokens sum to one. All counts are exact, over all documents to learn from; words are told apart by hashes of 63
bits, and inside a shard by 47, pairs by 40 and 38 bits of theirs.

A token's probability is looked up in tries (:mod:`.trie`) whose levels tasks map from a file: contexts, under each its followers
with what the pair adds. Words with at least ``FREQUENT_SHARE`` of all tokens and pairs with at least ``PAIR_SHARE``, 1 / share of each at most, are in tries
that are sent to all tasks. All other tokens go, once, to shards of about ``SHARD`` tokens: a rare word by its hash, and with it the pairs
that it ends, other pairs by the hash of both words. There they are counted, if their text is one to learn from, and then
scored: one partitioning serves counts and look-ups. A task packs what a slice of texts sends to a shard into one row, 13
bytes a token, and the shard answers with one row, the sums of the slice's texts; these come together by slice. Frequent words and pairs, which could overload a shard, are never sent to one.

Null and empty texts are the end token alone. Without documents to learn from every token has probability 1. Repeated rows
are scored each, and counted each. Null keys are in the fold of the empty text. No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .batches import slices, texts
from .columns import held_out
from .trie import NgramTrie
from .words import U, WordHasher, finish

FOLDS, FOLD = 7, 2
FREQUENT_SHARE, PAIR_SHARE = 1e-6, 1e-5
CONTEXT_SHARE = 0.0  # every word is a context, however rare
SMOOTHING = 500.0
SHARD = 1_000_000
_END = 1  # the end token's word key
_OTHER = 0  # the class of followers outside the contexts
_CONTEXT_BITS, _WORD_BITS, _FOLLOW_BITS = 40, 47, 38  # of a shard's contexts, its words and its followers
_FREQUENT_WORD = 1 << _WORD_BITS  # marks a follower that is known by its place among the frequent words
_SLICE, _ROWS = 1 << 20, 1 << 14
_TALLY = 1 << 20


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class _Tokens:
    """Word keys of a slice with an end token after each text."""

    def __init__(self, hasher: WordHasher, batch: pa.RecordBatch):
        words = hasher([value.lower() for value in texts(batch, "text")])
        self.keys = np.insert(words.hashes >> U(1), words.first[1:], U(_END))
        self.sizes = np.diff(words.first) + 1
        self.doc = np.repeat(np.arange(len(self.sizes)), self.sizes)

    def pairs(self, contexts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of tokens that follow a context, the contexts and the followers, by key or class."""
        follows, w = self.doc[:-1] == self.doc[1:], self.keys[1:]
        if contexts is not None:
            known = _among(self.keys, contexts)
            follows, w = follows & known[:-1], np.where(known[1:], w, U(_OTHER))
        place = np.flatnonzero(follows)
        return place + 1, self.keys[place], w[place]


def _among(keys: np.ndarray, ascending: np.ndarray) -> np.ndarray:
    if not len(ascending):
        return np.zeros(len(keys), bool)
    return ascending[np.minimum(np.searchsorted(ascending, keys), len(ascending) - 1)] == keys


def _summed(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Items once, with the sum of their numbers, which come last."""
    *items, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort(items[::-1])
    items = [x[order] for x in items]
    changes = np.logical_or.reduce([x[1:] != x[:-1] for x in items])
    new = np.flatnonzero(np.append(True, changes)[: len(n)])
    return *(x[new] for x in items), np.add.reduceat(n[order], new) if len(new) else n


def _counts(docs: DataFrame, take: Callable[[_Tokens], tuple[np.ndarray, ...]], columns: list[str]) -> DataFrame:
    """``columns, n`` over all rows; a task sums what fits a bounded tally before it is shuffled."""
    names = [*columns, "n"]

    def out(parts: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in parts], names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, parts = WordHasher(), [(np.zeros(0, np.int64),) * len(names)]
        for batch in slices(batches, "text", _SLICE):
            new = [x.astype(np.int64) for x in take(_Tokens(hasher, batch))]
            parts.append((*new, np.ones(len(new[0]), np.int64)))
            if sum(len(part[0]) for part in parts) > _TALLY:
                parts = [_summed(parts)]
                if len(parts[0][0]) > _TALLY // 2:
                    yield out(parts[0])
                    parts = [tuple(x[:0] for x in parts[0])]
        yield out(_summed(parts))

    counted = docs.mapInArrow(count, ", ".join(f"{n} bigint" for n in names))
    return counted.groupBy(*columns).agg(F.sum("n").alias("n"))


@dataclass
class Unigrams:
    """What all tasks know: totals, the frequent words, and the contexts if a share limits them."""

    tokens: int
    words: int
    smoothing: float
    frequent: np.ndarray
    context_count: float
    contexts: np.ndarray | None
    other: float  # the share of the follower class of words outside the contexts

    def share(self, count: np.ndarray) -> np.ndarray:
        return (count + 1) / (self.tokens + self.words + 1)

    def log_share(self, count: np.ndarray) -> np.ndarray:
        return np.log10(self.share(count))

    def backoff(self, keys: np.ndarray, count: np.ndarray) -> np.ndarray:
        """What a token that follows a word gets for a pair that is not stored; nothing follows the end token."""
        context = (count >= self.context_count) & (keys != _END)
        return np.where(context, np.log10(self.smoothing / (count + self.smoothing)), 0.0)

    def gain(self, times: np.ndarray, share: np.ndarray) -> np.ndarray:
        """What a pair seen ``times`` adds to unigram and backoff."""
        return np.log10(1 + times / (self.smoothing * share))


class _Frequent:
    """The tries that every task has."""

    def __init__(self, model: Unigrams, counts: np.ndarray, pairs: list[np.ndarray]):
        self.model, self.counts = model, counts
        u, w, n = pairs
        follow = self.follower(self.place(w.astype(np.uint64)))
        order = np.lexsort((follow, u.astype(np.uint64)))
        u, follow, n, w = u[order].astype(np.uint64), follow[order], n[order], w[order].astype(np.uint64)
        gain = model.gain(n, self.share(self.place(w)))
        keys = np.union1d(model.frequent, u)
        of = np.zeros(len(keys), np.int64)
        of[np.searchsorted(keys, model.frequent)] = counts
        self.packed = NgramTrie.build(keys, of, u, follow, -gain).packed()
        self.hot = np.zeros(len(model.frequent) + 1, bool)  # frequent words that begin a stored pair
        self.hot[self.place(np.unique(u))] = True

    def place(self, keys: np.ndarray) -> np.ndarray:
        """Places among the frequent words, -1 for others; the class of other followers is behind the last."""
        words = self.model.frequent
        if not len(words):
            return np.where(keys == U(_OTHER), 0, -1)
        at = np.minimum(np.searchsorted(words, keys), len(words) - 1)
        return np.where(words[at] == keys, at, np.where(keys == U(_OTHER), len(words), -1))

    @staticmethod
    def follower(place: np.ndarray) -> np.ndarray:
        return place.astype(np.uint64) | U(1 << _FOLLOW_BITS)

    def share(self, place: np.ndarray) -> np.ndarray:
        """The probability of frequent words, and of the class of other followers."""
        return np.append(self.model.share(self.counts), self.model.other)[place]


def _ascending(df: DataFrame) -> list[np.ndarray]:
    rows = df.toPandas().sort_values("item")
    return [rows[name].to_numpy(np.int64) for name in df.columns]


def score_documents(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    frequent_share: float = FREQUENT_SHARE,
    context_share: float = CONTEXT_SHARE,
    smoothing: float = SMOOTHING,
    pair_share: float = PAIR_SHARE,
    shard: int = SHARD,
) -> DataFrame:
    """``<key>, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    The scores are log10 probabilities of the lower-cased text and its end: by the unigrams alone, and by the model.
    """
    rows = docs.select(
        F.monotonically_increasing_id().alias("id"), F.col(key).alias("key"), F.col(text).cast("string").alias("text")
    )
    learn = docs.where(~held_out(key, FOLDS, FOLD)).select(F.col(text).cast("string").alias("text"))
    word_counts = _stored(_counts(learn, lambda tokens: (tokens.keys,), ["item"]), "words")
    total = word_counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    common = lambda share: F.col("n") >= F.lit(share * total[0])
    words, n = _ascending(word_counts.where(common(frequent_share)))
    contexts, other = None, 1.0
    if context_share > 0:
        contexts, often = _ascending(word_counts.where(common(context_share)))
        contexts, least = contexts.astype(np.uint64), 1 / (total[0] + total[1] + 1)
        other = max(1 - ((often + 1) * least).sum(), least)
    frequent = words.astype(np.uint64)
    model = Unigrams(total[0], total[1], smoothing, frequent, context_share * total[0], contexts, other)

    # a pair is as frequent as this only if both of its words are
    hot = np.union1d(frequent[n >= pair_share * total[0]], np.array([] if contexts is None else [_OTHER], np.uint64))

    def hot_pairs(tokens: _Tokens) -> tuple[np.ndarray, np.ndarray]:
        _, u, w = tokens.pairs(contexts)
        both = _among(u, hot) & _among(w, hot)
        return u[both], w[both]

    pairs = _ascending(_counts(learn, hot_pairs, ["item", "follower"]).where(common(pair_share)))
    sent = docs.sparkSession.sparkContext.broadcast(_Frequent(model, n, pairs))

    shards = 1 + total[0] * FOLDS // (FOLDS - 1) // shard
    rows = rows.withColumn("learn", ~held_out("key", FOLDS, FOLD))
    kind = rows.schema["key"].dataType.simpleString()
    sums = f"id bigint, key {kind}, n_tokens bigint, known bigint, base double, gain double"
    dealt = rows.mapInArrow(lambda batches: _deal(batches, sent, shards), f"shard int, slice bigint, {sums}, packed binary")
    dealt = dealt.repartition("shard").sortWithinPartitions("shard")
    answered = dealt.mapInArrow(lambda batches: _answer_shards(batches, sent), f"slice bigint, {sums}, packed binary")
    out = answered.repartition("slice").sortWithinPartitions("slice").mapInArrow(_assemble, sums)
    return out.select(
        F.col("key").alias(key),
        held_out("key", FOLDS, FOLD).alias("held_out"),
        "n_tokens",
        F.col("known").alias("n_known"),
        F.lit(total[0]).cast("bigint").alias("train_tokens"),
        F.col("base").alias("base_score"),
        (F.col("base") + F.col("gain")).alias("score"),
    )


def _deal(batches: Iterator[pa.RecordBatch], sent, shards: int) -> Iterator[pa.RecordBatch]:
    """A row per text with the sums over its frequent words and pairs, and one per slice and shard with all others."""
    frequent: _Frequent = sent.value
    model = frequent.model
    trie, hasher = NgramTrie.mapped(*frequent.packed), WordHasher()
    for whole in slices(batches, "text", _SLICE):
        for at in range(0, whole.num_rows, _ROWS):
            batch = whole.slice(at, _ROWS)
            tokens = _Tokens(hasher, batch)
            size = len(tokens.sizes)
            sums = lambda doc, x: np.bincount(doc, x, minlength=size)  # noqa: B023, E731
            place = frequent.place(tokens.keys)
            common = place >= 0
            count = np.where(common, frequent.counts[place], 0) if len(frequent.counts) else np.zeros(len(place), np.int64)
            base = sums(tokens.doc, np.where(common, model.log_share(count), 0.0))
            gain = sums(tokens.doc, np.where(common, model.backoff(tokens.keys, count), 0.0))

            which, u, w = tokens.pairs(model.contexts)
            doc, follower = tokens.doc[which], place[which] if model.contexts is None else frequent.place(w)
            maybe = np.flatnonzero((follower >= 0) & frequent.hot[place[which - 1]] & (place[which - 1] >= 0))
            added = -trie.log_probability(u[maybe], frequent.follower(follower[maybe]))
            stored = ~np.isnan(added)
            gain = gain + sums(doc[maybe[stored]], added[stored])
            left = np.ones(len(which), bool)
            left[maybe[stored]] = False
            u, w, doc, follower = u[left], w[left], doc[left], follower[left]

            ids = batch.column("id").to_numpy()
            if len(ids) and ids[-1] - ids[0] != len(ids) - 1:
                raise ValueError("texts of a task are numbered one after the other")
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array((ids % shards).astype(np.int32)),
                    pa.array(np.full(size, ids[0])),
                    batch.column("id"),
                    batch.column("key"),
                    pa.array(tokens.sizes.astype(np.int64)),
                    pa.array(sums(tokens.doc, common).astype(np.int64)),
                    pa.array(base.astype(float)),
                    pa.array(gain.astype(float)),
                    pa.nulls(size, pa.binary()),
                ],
                _DEALT,
            )
            learn = batch.column("learn").to_numpy(zero_copy_only=False).astype(np.uint16) << 15
            rare = ~common
            yield from _packed_rows(tokens.keys[rare], tokens.doc[rare], u, w, doc, follower, learn, int(ids[0]), shards, batch)


_SUMS = ["id", "key", "n_tokens", "known", "base", "gain"]
_DEALT = ["shard", "slice", *_SUMS, "packed"]


def _packed_rows(words, word_doc, u, w, doc, follower, learn, first: int, shards: int, batch) -> Iterator[pa.RecordBatch]:
    """What a slice sends to each shard: rare words with their texts, then pairs."""
    word_shard = finish(words) % U(shards)
    # a pair that a rare word ends goes to the word's shard
    pair_shard = np.where(follower < 0, finish(w), finish(finish(w) * U(0x9E3779B97F4A7C15) + u)) % U(shards)
    word = words & U(_FREQUENT_WORD - 1)
    ends = np.where(follower < 0, w & U(_FREQUENT_WORD - 1), follower.astype(np.uint64) | U(_FREQUENT_WORD))
    starts = u & U((1 << _CONTEXT_BITS) - 1)
    word_order, pair_order = np.argsort(word_shard, kind="stable"), np.argsort(pair_shard, kind="stable")
    word_at = np.searchsorted(word_shard[word_order], np.arange(shards + 1))
    pair_at = np.searchsorted(pair_shard[pair_order], np.arange(shards + 1))
    sent_to, blobs = [], []
    for shard in np.flatnonzero((np.diff(word_at) > 0) | (np.diff(pair_at) > 0)).tolist():
        a, b = word_order[word_at[shard] : word_at[shard + 1]], pair_order[pair_at[shard] : pair_at[shard + 1]]
        parts = [
            np.array([len(a), len(b)], "<u4"),
            *_split(word[a], 2),
            (word_doc[a].astype(np.uint16) | learn[word_doc[a]]).astype("<u2"),
            *_split(starts[b], 1),
            *_split(ends[b], 2),
            (doc[b].astype(np.uint16) | learn[doc[b]]).astype("<u2"),
        ]
        sent_to.append(shard)
        blobs.append(b"".join(part.tobytes() for part in parts))
    if blobs:
        yield _packed(blobs, first, batch.column("key").type, pa.array(sent_to, pa.int32()))


def _packed(blobs: list[bytes], first, kind: pa.DataType, shard: pa.Array | None = None) -> pa.RecordBatch:
    """Rows of packed numbers of a slice, or of several, without sums of their own."""
    n = len(blobs)
    place = pa.array(np.broadcast_to(np.asarray(first, np.int64), n).copy())
    none = [pa.nulls(n, t) for t in (pa.int64(), kind, pa.int64(), pa.int64(), pa.float64(), pa.float64())]
    columns = [place, *none, pa.array(blobs, pa.binary())]
    return pa.RecordBatch.from_arrays(columns if shard is None else [shard, *columns], _DEALT[shard is None :])


def _split(x: np.ndarray, upper: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers as their lower four bytes and ``upper`` bytes above."""
    return (x & U(0xFFFFFFFF)).astype("<u4"), (x >> U(32)).astype(f"<u{upper}")


def _unpacked(blob: bytes, first: int) -> tuple[np.ndarray, ...]:
    """Words, their texts and whether these are learned from; contexts, followers, and the same."""
    n, m = np.frombuffer(blob, "<u4", 2)
    at, out = 8, []
    for kinds, size in ((("<u4", "<u2", "<u2"), n), (("<u4", "<u1", "<u4", "<u2", "<u2"), m)):
        columns = []
        for kind in kinds:
            columns.append(np.frombuffer(blob, kind, size, at))
            at += columns[-1].nbytes
        for low, high in zip(columns[:-1:2], columns[1::2], strict=True):
            out.append(low.astype(np.uint64) | high.astype(np.uint64) << U(32))
        out += [(columns[-1] & 0x7FFF).astype(np.int64) + first, columns[-1] >> 15 == 1]
    return tuple(out)


def _answer_shards(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    """The texts' rows as they are, and a row for each slice that a shard has tokens of. A shard's rows come together."""
    shard, gathered, firsts, kind = -1, [], [], None
    for batch in batches:
        kind = batch.column("key").type
        plain = batch.filter(batch.column("packed").is_null())
        if plain.num_rows:
            yield plain.select(_DEALT[1:])
        packed = batch.filter(batch.column("packed").is_valid())
        for at, first, blob in zip(*(packed.column(c).to_pylist() for c in ("shard", "slice", "packed")), strict=True):
            if at != shard:
                if gathered:
                    yield _packed(*_answer(gathered, firsts, sent.value), kind)
                shard, gathered, firsts = at, [], []
            gathered.append(_unpacked(blob, first))
            firsts.append(first)
    if gathered:
        yield _packed(*_answer(gathered, firsts, sent.value), kind)


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts with all their sums. A slice's rows come together: its texts, and what each shard answers."""
    place, held = None, []
    for batch in batches:
        at = batch.column("slice").to_numpy()
        edges = np.flatnonzero(np.append(True, at[1:] != at[:-1])[: len(at)])
        for a, b in zip(edges, np.append(edges[1:], len(at)), strict=True):
            if at[a] != place and held:
                yield _slice_sums(held)
                held = []
            place = at[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield _slice_sums(held)


def _slice_sums(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    rows = pa.Table.from_batches(held)
    plain = rows.filter(rows.column("packed").is_null()).sort_by("id").combine_chunks()
    first = rows.column("slice")[0].as_py()
    sums = [plain.column(c).to_numpy().copy() for c in ("known", "base", "gain")]
    at = plain.column("id").to_numpy() - first  # 0, 1, ...
    known, base, gain = sums
    for blob in rows.column("packed").drop_null().to_pylist():
        place = 0
        # what a text's words give, then its pairs
        for into, kinds in (((known, base, gain), ("<u4", "<f8", "<f8")), ((gain,), ("<f4",))):
            (n,) = np.frombuffer(blob, "<u4", 1, place)
            doc = np.frombuffer(blob, "<u2", n, place + 4)
            place += 4 + doc.nbytes
            where = np.searchsorted(at, doc)
            for total, kind in zip(into, kinds, strict=True):
                total[where] += np.frombuffer(blob, kind, n, place)
                place += n * np.dtype(kind).itemsize
    columns = [plain.column(c).combine_chunks() for c in ("id", "key", "n_tokens")]
    return pa.RecordBatch.from_arrays([*columns, *(pa.array(x) for x in sums)], _SUMS)


def _answer(gathered: list[tuple[np.ndarray, ...]], firsts: list[int], frequent: _Frequent) -> tuple[list[bytes], list[int]]:
    """Count a shard's words and pairs over the texts to learn from, put them into tries and score all its tokens by these.

    Packed sums of each slice's texts, and the first text of each slice.
    """
    model = frequent.model
    words, word_doc, word_learn, u, w, doc, learn = (np.concatenate(x) for x in zip(*gathered, strict=True))
    gathered.clear()
    different, inverse = np.unique(words, return_inverse=True)
    n = np.bincount(inverse, word_learn, minlength=len(different)).astype(np.int64)
    none = np.zeros(0, np.uint64)
    seen = n > 0
    known_words = NgramTrie.mapped(*NgramTrie.build(different[seen], n[seen], none, none, np.zeros(0)).packed())
    count = known_words.count(different)
    each = np.stack([count > 0, model.log_share(count), model.backoff(different, count)]) if len(different) else np.zeros((3, 0))
    known, base, gain = each[:, inverse]

    marked = w >= U(_FREQUENT_WORD)
    follow = np.where(marked, w & U(_FREQUENT_WORD - 1) | U(1 << _FOLLOW_BITS), w & U((1 << _FOLLOW_BITS) - 1))
    order = np.lexsort((follow, u))
    new = np.flatnonzero(np.append(True, (np.diff(u[order]) != 0) | (np.diff(follow[order]) != 0))[: len(order)])
    times = np.add.reduceat(learn[order].astype(np.int64), new) if len(new) else np.zeros(0, np.int64)
    first = order[new]
    place = np.where(marked[first], w[first] & U(_FREQUENT_WORD - 1), U(0)).astype(np.int64)
    share = np.where(marked[first], frequent.share(place), model.share(known_words.count(w[first])))
    seen = times > 0
    contexts = u[first[seen]]
    trie = NgramTrie.build(
        np.unique(contexts), np.zeros(len(np.unique(contexts)), np.int64), contexts, follow[first[seen]], -model.gain(times, share)[seen]
    )
    added = np.nan_to_num(-NgramTrie.mapped(*trie.packed()).log_probability(u[first], follow[first]))
    added = np.repeat(added, np.diff(np.append(new, len(order))))

    # a text's sums over its words, where it has any here, and over its pairs
    firsts = sorted(firsts)
    with_words, inverse = np.unique(word_doc, return_inverse=True)
    total = lambda x: np.bincount(inverse, x, minlength=len(with_words))
    word_sums = total(known).astype("<u4"), total(base), total(gain)
    doc = doc[order]
    del u, w, order, follow
    with_pairs, inverse = np.unique(doc, return_inverse=True)
    pair_sums = (np.bincount(inverse, added, minlength=len(with_pairs)).astype("<f4"),)
    edges = [np.append(np.searchsorted(x, firsts), len(x)) for x in (with_words, with_pairs)]
    blobs = []
    for i, first in enumerate(firsts):
        parts = []
        for texts_, sums, edge in ((with_words, word_sums, edges[0]), (with_pairs, pair_sums, edges[1])):
            own = slice(edge[i], edge[i + 1])
            own_texts = texts_[own]
            parts += [np.array([len(own_texts)], "<u4"), (own_texts - first).astype("<u2"), *(x[own] for x in sums)]
        blobs.append(b"".join(part.tobytes() for part in parts))
    return blobs, firsts
