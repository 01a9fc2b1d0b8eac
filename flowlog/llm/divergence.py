"""How the sources of a language differ in vocabulary, counted by transducers.

1. Each language keeps the terms that enough of its documents have; they are numbered in UTF-8 order.
2. The kept terms become minimal acyclic transducers, whose outputs are the ordinals, and all texts stream through them to be
   counted by source. Every task has the transducers of up to ``FREQUENT`` terms of up to ``FREQUENT_BYTES``; if more are kept, these
   are the terms with at least 1 / ``FREQUENT`` of all (document, term) pairs. What these do not know, and a Bloom filter of fixed size
   lets through, goes to shards of the other kept terms, by hash, of about ``SHARD`` of them and ``ASKS`` rows; a task builds a
   shard's transducers, recounts and forgets them.
3. Counts become probabilities in exact integers, by long division. Pairs of sources are compared by blocks of terms and of
   sources as whole arrays; all that leaves a block are its sums. Ordinals break ties.

A group of a language and a source is known by a 64-bit hash, and different groups with one hash are an error.

Null text, language and source are the empty text. Repeated rows are documents of their own. A language without kept terms has
pairs of value 0 and no terms; a source alone in its language has no pairs. No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .batches import slices, texts
from .columns import text_or_empty
from .transducer import Transducer

MIN_DOCS = 10
TOP = 10
FREQUENT = 250_000
FREQUENT_BYTES = 64
SHARD, ASKS = 100_000, 1_000_000
TERMS, SOURCES = 4096, 256  # of a block
FILTER_BITS, FILTER_HASHES = 1 << 24, 3  # 2 MB, however many terms there are
_SLICE = 4 << 20
_TALLY = 1 << 20
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_IN_TERM = np.array([65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class _Terms:
    """The terms of some texts as a dictionary, with a code and a text number for each occurrence."""

    def __init__(self, values: list[bytes]):
        data = np.frombuffer(b"\n".join([b"", *values, b""]).translate(_LOWER), np.uint8)
        inside = _IN_TERM[data]
        begin = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
        end = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
        edges = np.concatenate(([0], np.cumsum(end - begin)))
        coded = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(begin), [None, pa.py_buffer(edges.tobytes()), pa.py_buffer(data[inside].tobytes())]
        ).dictionary_encode()
        self.code = coded.indices.to_numpy().astype(np.int64)
        self.known: pa.LargeBinaryArray = coded.dictionary
        self.owner = np.searchsorted(np.cumsum([1, *(len(v) + 1 for v in values)]), begin, side="right") - 1

    def ordinals(self, transducer: Transducer, codes: np.ndarray) -> np.ndarray:
        chosen = self.known.take(pa.array(codes))
        return _walk(transducer, chosen)


def _walk(transducer: Transducer, terms: pa.LargeBinaryArray) -> np.ndarray:
    edges = np.frombuffer(terms.buffers()[1], np.int64, len(terms) + 1, 8 * terms.offset)
    data = np.frombuffer(terms.buffers()[2] or b"", np.uint8)
    return transducer.ordinals(data, edges[:-1], edges[1:])


def _parts(text: bytes) -> list[bytes]:
    """A long text in parts of about a slice, cut where no term is."""
    if len(text) <= _SLICE:
        return [text]
    cuts = np.flatnonzero(~_IN_TERM[np.frombuffer(text, np.uint8)])
    parts, at = [], 0
    while at < len(text):
        i = np.searchsorted(cuts, at + _SLICE)
        end = int(cuts[i]) if i < len(cuts) and len(text) - at > _SLICE else len(text)
        parts.append(text[at:end])
        at = max(end, at + 1)
    return parts


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes], bool]]:
    """Rows with their texts; a long text comes alone, part by part, and the last part is marked."""
    for batch in slices(batches, "text", _SLICE):
        values = texts(batch, "text")
        if len(values) > 1:
            yield batch, values, True
            continue
        parts = _parts(values[0])
        for i, part in enumerate(parts or [b""]):
            yield batch, [part], i + 1 >= len(parts)


def _codes(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    coded = column.dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary


def _term_documents(docs: DataFrame) -> DataFrame:
    """``lang, term, n_docs``: in how many documents of its language each term occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: list[pa.Array] = []  # different terms of a long text so far
        for batch, values, ended in _pieces(batches):
            terms = _Terms(values)
            if before or not ended:
                before = [pa.concat_arrays([*before, terms.known]).unique()]
                if not ended:
                    continue
                known, before = before[0], []
                lang, number = np.zeros(len(known), np.int64), np.ones(len(known), np.int64)
                code, langs = np.arange(len(known)), batch.column("lang")
            else:
                known, size = terms.known, max(1, len(terms.known))
                pairs = np.unique(terms.owner * size + terms.code)
                of_row, langs = _codes(batch.column("lang"))
                pairs, number = np.unique(of_row[pairs // size] * size + pairs % size, return_counts=True)
                lang, code = pairs // size, pairs % size
            yield pa.RecordBatch.from_arrays(
                [langs.take(pa.array(lang)), known.take(pa.array(code)), pa.array(number.astype(np.int64))],
                ["lang", "term", "n_docs"],
            )

    counted = docs.select("lang", "text").mapInArrow(count, "lang string, term binary, n_docs bigint")
    return counted.groupBy("lang", "term").agg(F.sum("n_docs").alias("n_docs"))


def _numbered(kept: DataFrame) -> DataFrame:
    """``kept`` with ``ordinal`` 0, 1, ... by language and, in UTF-8 order, term, from ranks inside sorted ranges."""
    ranges = kept.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term")
    ranges = _stored(ranges.withColumn("part", F.spark_partition_id()), "vocabulary")
    # a row per range
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranges.groupBy("part").agg(F.count("*").alias("n"))
    offsets = sizes.select(F.col("part").alias("part2"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("b"))
    out = ranges.withColumn("r", F.row_number().over(Window.partitionBy("part").orderBy("lang", "term")) - 1)
    out = out.join(offsets, F.col("part") == F.col("part2"))
    return _stored(out.select("lang", "term", "n_docs", (F.col("b") + F.col("r")).alias("ordinal")), "ordinals")


def _transducers(rows: list[tuple[str, bytes, int]]) -> dict[str, tuple[Transducer, np.ndarray]]:
    """Per language, from rows in ascending order: the transducer of its terms, and their ordinals among all kept terms."""
    out: dict[str, tuple[Transducer, np.ndarray]] = {}
    first = 0
    for i in range(1, len(rows) + 1):
        if i == len(rows) or rows[i][0] != rows[first][0]:
            part = rows[first:i]
            out[part[0][0]] = Transducer.build([term for _, term, _ in part]), np.array([n for *_, n in part], np.int64)
            first = i
    return out


class _Tally:
    """Counts of (group, ordinal), summed while they fit."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, group: np.ndarray, ordinal: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append((group, ordinal, n))
        self.size += len(n)
        if self.size > _TALLY:
            self._sum()
            if self.size > _TALLY // 2:
                yield self.out()

    def _sum(self) -> None:
        group, ordinal, n = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((ordinal, group))
        group, ordinal = group[order], ordinal[order]
        new = np.flatnonzero(np.append(True, (group[1:] != group[:-1]) | (ordinal[1:] != ordinal[:-1]))[: len(group)])
        sums = np.add.reduceat(n[order], new) if len(new) else n
        self.parts, self.size = [(group[new], ordinal[new], sums)], len(new)

    def out(self) -> pa.RecordBatch:
        columns = [pa.array(x) for x in self.parts[0]]
        self.parts, self.size = [], 0
        return pa.RecordBatch.from_arrays([*columns, pa.nulls(len(columns[0]), pa.string()), pa.nulls(len(columns[0]), pa.binary())], _COUNTED)

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            self._sum()
            yield self.out()


_COUNTED = ["grp", "ordinal", "n", "lang", "term"]


def _term_filter(terms: DataFrame) -> np.ndarray:
    """A Bloom filter of ``lang, term`` rows as 64-bit words; tasks make the words, a row per word reaches the driver."""
    h = F.xxhash64("lang", "term")
    low, high = h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32).bitwiseOR(F.lit(1))
    places = F.array(*[(low + F.lit(i) * high) % F.lit(FILTER_BITS) for i in range(FILTER_HASHES)])
    bits = terms.select(F.explode(places).alias("at"))
    bits = bits.select(F.floor(F.col("at") / 64).alias("word"), F.expr("shiftleft(1L, cast(at % 64 AS int))").alias("bit"))
    words = np.zeros(FILTER_BITS // 64, np.uint64)
    for word, bit in bits.groupBy("word").agg(F.bit_or("bit")).collect():
        words[word] = np.uint64(bit & (2**64 - 1))
    return words


def _may_be_in(words: np.ndarray, lang: str, terms: list[bytes]) -> np.ndarray:
    """Whether the filter lets each term of a language through."""
    seed = xxhash.xxh64_intdigest(lang.encode(), seed=42)
    h = np.fromiter((xxhash.xxh64_intdigest(term, seed=seed) for term in terms), np.uint64, len(terms))
    low, high = h & np.uint64(0xFFFFFFFF), h >> np.uint64(32) | np.uint64(1)
    out = np.ones(len(terms), bool)
    for i in range(FILTER_HASHES):
        at = (low + np.uint64(i) * high) % np.uint64(FILTER_BITS)
        out &= (words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
    return out


def group_hash() -> Column:
    return F.xxhash64("lang", "source")


def source_counts(docs: DataFrame, kept: DataFrame, frequent: int = FREQUENT, shard: int = SHARD, asks: int = ASKS) -> DataFrame:
    """``grp, ordinal, n``: how often each group has each of its language's kept terms, by transducers.

    ``docs`` has ``lang``, ``source`` and ``text`` without null languages and sources, ``kept`` is ``lang, term, n_docs, ordinal``.
    """
    known = kept.agg(F.count("*"), F.coalesce(F.sum("n_docs"), F.lit(0))).first()
    least = 0 if known[0] <= frequent else known[1] / frequent
    often = (F.col("n_docs") >= F.lit(least)) & (F.octet_length("term") <= FREQUENT_BYTES)
    rows = kept.where(often).select("lang", "term", "ordinal").collect()  # bounded in number and length
    rows = sorted((lang, bytes(term), ordinal) for lang, term, ordinal in rows)
    others = known[0] - len(rows)
    context = docs.sparkSession.sparkContext
    sent = context.broadcast(_transducers(rows))
    rest = kept.where(~often).select("lang", "term", "ordinal")
    passing = context.broadcast(_term_filter(rest) if others else None)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = _Tally()
        for batch, values, _ in _pieces(batches):
            terms = _Terms(values)
            size = max(1, len(terms.known))
            names, of_row = np.unique(batch.column("grp").to_numpy(), return_inverse=True)
            found, number = np.unique(of_row[terms.owner] * size + terms.code, return_counts=True)
            code, group = found % size, names[found // size]
            lang, langs = _codes(batch.column("lang"))
            lang_of = np.zeros(len(names), np.int64)
            lang_of[of_row] = lang
            lang = lang_of[found // size]
            ordinal = np.full(len(found), -1, np.int64)
            for i, name in enumerate(langs.to_pylist()):
                if name in sent.value:
                    transducer, numbers = sent.value[name]
                    own = np.flatnonzero(lang == i)
                    each, back = np.unique(code[own], return_inverse=True)  # a term of many groups is walked once
                    at = terms.ordinals(transducer, each)[back]
                    ordinal[own[at >= 0]] = numbers[at[at >= 0]]
            good = ordinal >= 0
            yield from tally.add(group[good], ordinal[good], number[good].astype(np.int64))
            if others and not good.all():
                asked = ~good
                for i, name in enumerate(langs.to_pylist()):
                    own = np.flatnonzero(asked & (lang == i))
                    each, back = np.unique(code[own], return_inverse=True)
                    asked[own] = _may_be_in(passing.value, name, terms.known.take(pa.array(each)).to_pylist())[back]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(group[asked]),
                        pa.nulls(int(asked.sum()), pa.int64()),
                        pa.array(number[asked].astype(np.int64)),
                        langs.take(pa.array(lang[asked])),
                        terms.known.take(pa.array(code[asked])).cast(pa.binary()),
                    ],
                    _COUNTED,
                )
        yield from tally.rest()

    schema = "grp bigint, ordinal bigint, n bigint, lang string, term binary"
    streamed = docs.select("lang", group_hash().alias("grp"), "text").mapInArrow(stream, schema)
    if not others:
        return streamed.groupBy("grp", "ordinal").agg(F.sum("n").alias("n"))
    streamed = _stored(streamed, "streamed")
    asked = streamed.where("term is not null")
    shards = max(-(-others // shard), -(-asked.count() // asks))
    number = F.pmod(F.xxhash64("lang", "term"), F.lit(shards)).cast("int").alias("shard")
    entries = rest.select(number, "lang", "term", F.lit(None).cast("bigint").alias("grp"), F.col("ordinal").alias("n"))
    both = entries.unionByName(asked.select(number, "lang", "term", "grp", "n")).repartition("shard")
    entry = F.col("grp").isNull()
    both = both.sortWithinPartitions("shard", F.desc(entry), F.when(entry, F.col("lang")), F.when(entry, F.col("term")))
    answered = both.mapInArrow(_recount, "grp bigint, ordinal bigint, n bigint")
    known_ = streamed.where("ordinal is not null").select("grp", "ordinal", "n")
    return known_.unionByName(answered).groupBy("grp", "ordinal").agg(F.sum("n").alias("n"))


def _recount(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences of a shard's terms. Its entries, without a group, come first and in order, then what was not known."""
    shard, entries, transducers = -1, [], None
    for batch in batches:
        at = batch.column("shard").to_numpy()
        edges = np.flatnonzero(np.append(True, at[1:] != at[:-1])[: len(at)])
        for a, b in zip(edges, np.append(edges[1:], len(at)), strict=True):
            if at[a] != shard:
                shard, entries, transducers = at[a], [], None
            part = batch.slice(a, b - a)
            asks = part.filter(part.column("grp").is_valid())
            if asks.num_rows < part.num_rows:
                own = part.slice(0, part.num_rows - asks.num_rows)
                entries += zip(*(own.column(c).to_pylist() for c in ("lang", "term", "n")), strict=True)
            if not asks.num_rows:
                continue
            if transducers is None:
                transducers, entries = _transducers(entries), []
            lang, langs = _codes(asks.column("lang"))
            terms = asks.column("term").cast(pa.large_binary())
            ordinal = np.full(asks.num_rows, -1, np.int64)
            for i, name in enumerate(langs.to_pylist()):
                if name in transducers:
                    transducer, numbers = transducers[name]
                    own = np.flatnonzero(lang == i)
                    found = _walk(transducer, terms.take(pa.array(own)))
                    ordinal[own[found >= 0]] = numbers[found[found >= 0]]
            if (ordinal >= 0).any():
                kept = asks.filter(pa.array(ordinal >= 0))
                yield pa.RecordBatch.from_arrays(
                    [kept.column("grp"), pa.array(ordinal[ordinal >= 0]), kept.column("n")], ["grp", "ordinal", "n"]
                )


def _share(count: Column, total: Column) -> Column:
    """1 + floor(10**9 * count / total) for count <= total, digit group by digit group so that nothing overflows."""
    quotient, rest = F.lit(0).cast("bigint"), count
    for _ in range(3):
        scaled = rest * F.lit(1000)
        quotient, rest = quotient * F.lit(1000) + F.call_function("div", scaled, total), scaled % total
    return quotient + F.lit(1)


def _gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _pair_values(cells: DataFrame, groups: DataFrame, terms: int, sources: int) -> DataFrame:
    """``lang, i, j, value`` for i < j: the sums over all kept terms, from blocks of terms and sources.

    ``cells`` is ``lang, i, s, v, ordinal, p`` for terms that a source has, ``groups`` ``lang, i, p0, v, s``: the probability of
    the terms that it has not, the number of kept terms and of sources. Ordinals are those inside the language.
    """
    block = F.floor(F.col("ordinal") / terms).cast("int")
    last = F.greatest(F.lit(0), F.floor((F.col("v") - 1) / terms).cast("int"))
    heads = groups.select(
        "lang",
        "i",
        "s",
        F.explode(F.sequence(F.lit(0), last)).alias("block"),
        F.lit(-1).cast("bigint").alias("ordinal"),
        F.col("p0").alias("p"),
        "v",
    )
    rows = cells.select("lang", "i", "s", block.alias("block"), "ordinal", "p", "v").unionByName(heads)
    own = F.floor(F.col("i") / sources).cast("int")
    last = F.floor((F.col("s") - 1) / sources).cast("int")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    rows = rows.select(
        "lang", "block", F.least(own, F.col("other")).alias("a"), F.greatest(own, F.col("other")).alias("b"), "i", "ordinal", "p", "v"
    )
    order = ["lang", "block", "a", "b"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts = None, []
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in order), strict=True))
            start = 0
            for end in range(1, len(keys) + 1):
                if end < len(keys) and keys[end] == keys[start]:
                    continue
                if keys[start] != key and parts:
                    yield from _block_sums(key, parts, terms, sources)
                    parts = []
                key = keys[start]
                parts.append([batch.column(c).to_numpy()[start:end] for c in ("i", "ordinal", "p", "v")])
                start = end
        if parts:
            yield from _block_sums(key, parts, terms, sources)

    dealt = rows.repartition(*order).sortWithinPartitions(*order)
    sums = dealt.mapInArrow(compare, "lang string, i int, j int, value bigint")
    return sums.groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))


def _block_sums(key: tuple, parts: list, terms: int, sources: int) -> Iterator[pa.RecordBatch]:
    lang, block, a, b = key
    i, ordinal, p, v = (np.concatenate(x) for x in zip(*parts, strict=True))
    head = ordinal < 0
    names, at = np.unique(i[head], return_index=True)
    width = min(terms, max(0, int(v[0]) - block * terms))
    table = np.repeat(p[head][at][:, None], max(1, width), axis=1).astype(np.int64)
    cell = ~head
    table[np.searchsorted(names, i[cell]), ordinal[cell] - block * terms] = p[cell]
    for row, name in enumerate(names):
        if name // sources != a:
            continue
        others = np.flatnonzero((names // sources == b) & (names > name))
        if not len(others):
            continue
        gap = table[others] - table[row]
        value = (gap * gap // (table[others] + table[row])).sum(axis=1) if width else np.zeros(len(others), np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([lang] * len(others), pa.string()),
                pa.array(np.full(len(others), name, np.int32)),
                pa.array(names[others].astype(np.int32)),
                pa.array(value.astype(np.int64)),
            ],
            ["lang", "i", "j", "value"],
        )


def source_divergence(
    docs: DataFrame,
    lang: str = "lang",
    source: str = "source",
    text: str = "text",
    min_docs: int = MIN_DOCS,
    top: int = TOP,
    frequent: int = FREQUENT,
    shard: int = SHARD,
    terms: int = TERMS,
    sources: int = SOURCES,
) -> DataFrame:
    """``lang, source, part, item, value, rank``: how far each source is from the others, and its most overused terms."""
    rows = docs.select(
        text_or_empty(lang).alias("lang"), text_or_empty(source).alias("source"), F.col(text).cast("string").alias("text")
    )
    kept = _numbered(_term_documents(rows).where(F.col("n_docs") >= min_docs))
    counts = _stored(source_counts(rows, kept, frequent, shard), "source-counts")

    by_lang = Window.partitionBy("lang")
    sizes = kept.groupBy("lang").agg(F.count("*").alias("v"), F.min("ordinal").alias("base")).withColumnRenamed("lang", "lang2")
    sums = counts.groupBy("grp").agg(F.sum("n").alias("n")).withColumnRenamed("grp", "grp2")
    groups = rows.groupBy("lang", "source").agg(F.lit(0).alias("zero")).withColumn("grp", group_hash())
    groups = groups.join(sizes, F.col("lang") == F.col("lang2"), "left")
    groups = groups.join(sums, F.col("grp") == F.col("grp2"), "left")
    zero = lambda name: F.coalesce(F.col(name), F.lit(0)).alias(name)
    groups = groups.select("grp", "lang", "source", zero("v"), zero("base"), zero("n"))
    total = lambda n: F.when(F.col("v") > 0, F.col(n) + 2 * F.col("v")).otherwise(2)
    groups = groups.select(
        "grp",
        "lang",
        "source",
        "v",
        "base",
        total("n").alias("d"),
        F.sum("n").over(by_lang).alias("lang_n"),
        (F.row_number().over(by_lang.orderBy("source")) - 1).alias("i"),
        F.count("*").over(by_lang).alias("s"),
    )
    groups = _stored(groups.withColumn("lang_d", total("lang_n")).drop("lang_n"), "groups")
    clash = groups.agg(F.count("*"), F.count_distinct("grp")).first()
    if clash[0] != clash[1]:
        raise ValueError("two groups of a language and a source have one hash; audit them apart")

    # a kept term belongs to one language
    in_lang = F.sum("n").over(Window.partitionBy("ordinal"))
    of_group = groups.select(F.col("grp").alias("grp2"), "lang", "i", "s", "v", "base", "d", "lang_d")
    two = lambda n: n + F.lit(2)
    cells = counts.withColumn("lang_n", in_lang).join(of_group, F.col("grp") == F.col("grp2"))
    cells = cells.select(
        "grp",
        "lang",
        "i",
        "s",
        "v",
        (F.col("ordinal") - F.col("base")).alias("ordinal"),
        F.col("ordinal").alias("whole"),
        _share(two(F.col("n")), F.col("d")).alias("p"),
        _share(two(F.col("lang_n")), F.col("lang_d")).alias("q"),
    )
    cells = _stored(cells, "cells")

    p0 = groups.select("lang", "i", _share(F.lit(2).cast("bigint"), F.col("d")).alias("p0"), "v", "s")
    values = _pair_values(cells, p0, terms, sources)
    both = values.unionByName(values.select("lang", F.col("j").alias("i"), F.col("i").alias("j"), "value"))
    name = lambda n: groups.select(F.col("lang").alias(f"lang_{n}"), F.col("i").alias(f"i_{n}"), F.col("source").alias(n))
    both = both.join(name("source"), (F.col("lang") == F.col("lang_source")) & (F.col("i") == F.col("i_source")))
    both = both.join(name("item"), (F.col("lang") == F.col("lang_item")) & (F.col("j") == F.col("i_item")))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = both.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(by_value).alias("rank"))

    more = cells.where(F.col("p") > F.col("q")).select("grp", "whole", _gap(F.col("p"), F.col("q")).alias("value"))
    # ordinals stand for the terms' order
    place = F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("value"), "whole"))
    more = more.withColumn("rank", place).where(F.col("rank") <= top)
    more = more.join(groups.select(F.col("grp").alias("grp2"), "lang", "source"), F.col("grp") == F.col("grp2"))
    text_of = kept.select(F.col("ordinal").alias("ordinal2"), F.col("term").cast("string").alias("item"))
    more = more.join(text_of, F.col("whole") == F.col("ordinal2"))
    more = more.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    return pairs.unionByName(more)
