"""Substring dedup: recurring passages, confirmed by counting and located with Aho-Corasick automata.

A window is ``WINDOW`` consecutive words of one document; it recurs if its words also start anywhere else. Every word that a
recurring window covers is removed. Counting all windows of a corpus would shuffle a hash per word, so windows are
represented by anchors:

1. The anchor of a window is its ``GRAM``-word phrase with the least hash, the first of equal ones. It depends on the
   window's words alone, so that a recurring window has a recurring anchor at the same place. The consecutive windows with
   one anchor form a span, one row for about fourteen words. Anchors that occur once are dropped.
2. Spans that recur as a whole are confirmed by their counts. Where only a part of a span can recur, at the ends of copied
   passages, the windows of the span are counted one by one; of equal spans one gives its windows.
3. Confirmed windows that follow each other are a passage. Each task compiles the passages of its shard of documents into
   an automaton over word numbers and streams the shard's documents through it; the hits are what is removed. As a
   document's own passages are in its shard's automaton, nothing that recurs is missed, and automata stay as small as
   the texts of a shard, however many passages the corpus has.

Hashes that decide are pairs of independent 64-bit hashes. Hot anchors (a passage in a third of all documents) are
aggregated before they are shuffled, and joined with a table that has one row for each.

Null and empty texts have no words; their kept text is empty. Repeated rows are copies of each other, so all their
windows recur. A null key is joined like any other. No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .batches import slices, texts
from .words import Powers, U, WordHasher, Words, finish

WINDOW = 35
GRAM = 8
_SLICE = 1 << 20
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def _stored(df: DataFrame, name: str) -> DataFrame:
    """A written table: survives lost executors, and its size is known to the joins that read it."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@dataclass
class Passages:
    """Words and their running hash sums."""

    words: Words
    sums: list[np.ndarray]  # of word hashes times powers, for either base


class PassageScanner:
    """What tasks compute of texts; keeps its tables from slice to slice."""

    def __init__(self, window: int = WINDOW, gram: int = GRAM):
        self.window, self.gram = window, gram
        self.powers = [Powers(base) for base in _BASES]
        self.hasher = WordHasher()

    def read(self, values: list[bytes]) -> Passages:
        words, sums = self.hasher(values), []
        for which, power in enumerate(self.powers):
            x = words.hashes if which == 0 else finish(words.hashes + U(1))
            up = power.upto(len(x) + 1)[0]
            sums.append(np.concatenate((np.zeros(1, np.uint64), np.cumsum(x * up[: len(x)], dtype=np.uint64))))
        return Passages(words, sums)

    def _hashes(self, read: Passages, start: np.ndarray, size: np.ndarray | int, which: int) -> np.ndarray:
        """Hash of the ``size`` words from ``start`` on."""
        down = self.powers[which].upto(len(read.words.begin) + 1)[1]
        return finish((read.sums[which][start + size] - read.sums[which][start]) * down[start])

    def spans(self, read: Passages) -> tuple[np.ndarray, ...]:
        """Text number, first and last window, anchor hash and span hash of every span."""
        n, size, gram = len(read.words.begin), self.window, self.gram
        none = np.zeros(0, np.int64)
        if n < size:
            return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
        grams = self._hashes(read, np.arange(n - gram + 1), gram, 0)
        least, where = grams, np.arange(len(grams))
        reach, width = size - gram + 1, 1
        while width < reach:
            step = min(width, reach - width)
            left, right = least[: len(least) - step], least[step:]
            where = np.where(left <= right, where[: len(where) - step], where[step:])
            least = np.minimum(left, right)
            width += step
        text = read.words.text
        start = np.arange(n - size + 1)
        start = start[text[start] == text[start + size - 1]]
        if not len(start):
            return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
        anchor, owner = where[start], text[start]
        new = np.ones(len(start), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
        edges = np.flatnonzero(new)
        lo, hi = start[edges], start[np.append(edges[1:], len(start)) - 1]
        shape = ((anchor[edges] - lo) * 1024 + (hi - lo)).astype(np.uint64)
        span = self._hashes(read, lo, hi - lo + size, 1)
        return owner[edges], lo, hi, grams[anchor[edges]], finish(span + shape * U(_BASES[0]))

    def windows(self, read: Passages, start: np.ndarray) -> np.ndarray:
        return self._hashes(read, start, self.window, 1)


def _sequence(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges ``lo`` to ``hi``, and which range each is of."""
    size = hi - lo + 1
    which = np.repeat(np.arange(len(lo)), size)
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + lo[which], which


def _in_lists(owner: np.ndarray, values: np.ndarray, lists: pa.Array) -> np.ndarray:
    """Whether each value is in the list of its row."""
    found = np.zeros(len(values), bool)
    edges = np.searchsorted(owner, np.arange(len(lists) + 1))
    for row, wanted in enumerate(lists):
        a, b = edges[row], edges[row + 1]
        if a < b and wanted.is_valid and len(wanted):
            found[a:b] = np.isin(values[a:b], np.asarray(wanted.values).view(np.uint64))
    return found


def _span_rows(rows: DataFrame, window: int, gram: int) -> DataFrame:
    """``key, anchor, span, n``: the spans of each row and how often it has them."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = PassageScanner(window, gram)
        for batch in slices(batches, "text", _SLICE):
            owner, _, _, anchor, span = scanner.spans(scanner.read(texts(batch, "text")))
            if not len(owner):
                continue
            table, n = np.unique(np.stack([owner.astype(np.uint64), anchor, span]), axis=1, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key").take(pa.array(table[0].astype(np.int64))),
                    pa.array(table[1].view(np.int64)),
                    pa.array(table[2].view(np.int64)),
                    pa.array(n.astype(np.int64)),
                ],
                ["key", "anchor", "span", "n"],
            )

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(scan, f"key {kind}, anchor bigint, span bigint, n bigint")


def _window_rows(rows: DataFrame, window: int, gram: int) -> DataFrame:
    """``key, anchor, span_window, n`` of the spans that ``once`` and ``often`` ask for: n is 1 and 2."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = PassageScanner(window, gram)
        for batch in slices(batches, "text", _SLICE):
            read = scanner.read(texts(batch, "text"))
            owner, lo, hi, anchor, span = scanner.spans(read)
            for name, n in (("once", 1), ("often", 2)):
                chosen = np.flatnonzero(_in_lists(owner, span, batch.column(name)))
                # one of equal spans of a row is enough
                _, one = np.unique(np.stack([owner[chosen].astype(np.uint64), span[chosen]]), axis=1, return_index=True)
                chosen = chosen[one]
                start, which = _sequence(lo[chosen], hi[chosen])
                hashed = scanner.windows(read, start)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("key").take(pa.array(owner[chosen][which])),
                        pa.array(anchor[chosen][which].view(np.int64)),
                        pa.array(hashed.view(np.int64)),
                        pa.array(np.full(len(start), n, np.int64)),
                    ],
                    ["key", "anchor", "hash", "n"],
                )

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(scan, f"key {kind}, anchor bigint, hash bigint, n bigint")


def confirmed_windows(rows: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``key, spans, windows``: hashes of each key's wholly recurring spans, and of the recurring windows of its others."""
    found = _stored(_span_rows(rows, window, gram), "spans")
    twice = found.groupBy("anchor").agg(F.sum("n").alias("total")).where("total > 1").select(F.col("anchor").alias("a"))
    twice = _stored(twice, "anchors")
    found = _stored(found.join(twice, F.col("anchor") == F.col("a")).drop("a"), "recurring")

    spans = found.groupBy("anchor", "span").agg(
        F.sum("n").alias("total"), F.min(F.struct(F.col("key").isNull().alias("no"), "key")).alias("one")
    )
    spans = _stored(spans.select("anchor", "span", (F.col("total") > 1).alias("often"), "one.key"), "span-counts")
    mixed = spans.groupBy("anchor").agg(F.min("often").alias("whole")).where("not whole")
    mixed = _stored(mixed.select(F.col("anchor").alias("a")), "mixed")
    asked = spans.join(mixed, F.col("anchor") == F.col("a")).groupBy(F.col("key").alias("key2"))
    asked = asked.agg(
        F.collect_list(F.when(~F.col("often"), F.col("span"))).alias("once"),
        F.collect_list(F.when(F.col("often"), F.col("span"))).alias("often"),
    )
    texts_asked = rows.join(asked, F.col("key").eqNullSafe(F.col("key2"))).drop("key2")
    single = _stored(_window_rows(texts_asked, window, gram), "windows")
    again = single.groupBy("anchor", "hash").agg(F.sum("n").alias("total")).where("total > 1")
    again = _stored(again.select(F.col("anchor").alias("a"), F.col("hash").alias("h")), "recurring-windows")

    same_window = (F.col("anchor") == F.col("a")) & (F.col("hash") == F.col("h"))
    parts = single.where("n = 1").join(again, same_window).select("key", F.lit(False).alias("whole"), "hash")
    often = spans.where("often").select(F.col("anchor").alias("a"), F.col("span").alias("s"))
    same_span = (F.col("anchor") == F.col("a")) & (F.col("span") == F.col("s"))
    whole = found.join(often, same_span).select("key", F.lit(True).alias("whole"), F.col("span").alias("hash"))
    return (
        whole.unionByName(parts)
        .groupBy("key")
        .agg(
            F.collect_set(F.when(F.col("whole"), F.col("hash"))).alias("spans"),
            F.collect_set(F.when(~F.col("whole"), F.col("hash"))).alias("windows"),
        )
    )


def _recurring(scanner: PassageScanner, read: Passages, batch: pa.RecordBatch) -> np.ndarray:
    """Starts of all confirmed windows of a slice."""
    owner, lo, hi, _, span = scanner.spans(read)
    whole = _in_lists(owner, span, batch.column("spans"))
    start, which = _sequence(lo, hi)
    good = whole[which]
    rest = np.flatnonzero(~good)
    good[rest] = _in_lists(owner[which[rest]], scanner.windows(read, start[rest]), batch.column("windows"))
    return start[good]


def locate(words: Words, start: np.ndarray, window: int) -> np.ndarray:
    """Marks of the words that passages cover: runs of windows from ``start`` are compiled, all words are streamed."""
    n, marks = len(words.begin), np.zeros(len(words.begin) + 1, np.int64)
    if not len(start):
        return marks[:n] > 0
    text = words.text
    fresh = np.ones(len(start), bool)
    fresh[1:] = (start[1:] != start[:-1] + 1) | (text[start[1:]] != text[start[:-1]])
    edges = np.flatnonzero(fresh)
    lo, hi = start[edges], start[np.append(edges[1:], len(start)) - 1] + window
    # numbers of the words; 0 stands between texts
    raw = words.data.tobytes()
    numbers: dict[bytes, int] = {}
    ids = [numbers.setdefault(raw[a:b], len(numbers) + 1) for a, b in zip(words.begin.tolist(), words.end.tolist(), strict=True)]
    automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH, ahocorasick.KEY_SEQUENCE)
    for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
        automaton.add_word(tuple(ids[a:b]))
    automaton.make_automaton()
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= window:
            for last, size in automaton.iter(tuple(ids[a:b])):
                marks[a + last + 1 - size] += 1
                marks[a + last + 1] -= 1
    return np.cumsum(marks)[:n] > 0


def remove_passages(
    docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM
) -> DataFrame:
    """``<key>, n_words, n_removed, kept_text`` of every row; kept words are joined by one space."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    known = confirmed_windows(rows, window, gram).withColumnRenamed("key", "key2")
    joined = rows.join(known, F.col("key").eqNullSafe(F.col("key2")), "left").drop("key2")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = PassageScanner(window, gram)
        for batch in slices(batches, "text", _SLICE):
            read = scanner.read(texts(batch, "text"))
            words = read.words
            gone = locate(words, _recurring(scanner, read, batch), window)
            raw = words.data.tobytes()
            kept, counts = [], []
            for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
                stay = np.flatnonzero(~gone[a:b]) + a
                spots = zip(words.begin[stay].tolist(), words.end[stay].tolist(), strict=True)
                kept.append(b" ".join([raw[x:y] for x, y in spots]).decode())
                counts.append((b - a, b - a - len(stay)))
            numbers = [pa.array(column, pa.int64()) for column in zip(*counts, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), *numbers, pa.array(kept, pa.string())],
                ["key", "n_words", "n_removed", "kept_text"],
            )

    kind = rows.schema["key"].dataType.simpleString()
    out = joined.mapInArrow(cut, f"key {kind}, n_words bigint, n_removed bigint, kept_text string")
    return out.withColumnRenamed("key", key)
