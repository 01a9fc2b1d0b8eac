"""Language identification with language-bitmask n-gram filters.

The n-grams are three code points around each letter of the lower-cased text, with 0 for anything that is no letter. Spark
counts them by language over all documents to learn from. A language contains an n-gram whose share of the language's
n-grams is at least ``MIN_SHARE`` and at least ``MIN_RATIO`` of its largest share in any language, so a language contains
1 / ``MIN_SHARE`` n-grams at most and the model stays small however large the corpus.

The Bloom filters of all languages are stored bit-sliced: one mask of languages per position, so that one look-up per
hash function returns all languages that contain an n-gram. A language's hits are its popcount over the text, corrected
for the share of false positives that the fill of its slice implies; the most hits win, equal ones go to the first
language by code point.

Null texts and texts without a letter are ``und`` with score 0, as is everything if nothing could be learned. Null
languages are not learned from. Repeated rows get the same answer; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .batches import slices
from .columns import held_out

UNKNOWN = "und"
MIN_SHARE = 1e-5
MIN_RATIO = 0.2
BITS_PER_GRAM = 16
HASHES = 3
FOLDS, FOLD = 3, 1
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the n-grams of joined texts, their places, and where each text begins."""
    lowered = [text.lower() for text in texts]
    codes = np.frombuffer(("\n" + "\n".join(lowered) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = _letters()[codes]
    codes = np.where(is_letter, codes, 0).astype(np.uint64)
    place = np.flatnonzero(is_letter)
    keys = codes[place - 1] << np.uint64(42) | codes[place] << np.uint64(21) | codes[place + 1]
    starts = np.cumsum([1, *(len(text) + 1 for text in lowered)])[:-1]
    return keys, place, starts


def _positions(keys: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """One position per hash function; ``size`` is a power of two."""
    shift = np.uint64(64 - (size.bit_length() - 1))
    mixed = keys ^ keys >> np.uint64(31)
    for multiplier in _MULTIPLIERS:
        mixed = mixed * np.uint64(multiplier)
        mixed ^= mixed >> np.uint64(29)
        yield (mixed * np.uint64(multiplier) >> shift).astype(np.int64)


@dataclass
class LanguageFilter:
    """Bit-sliced Bloom filters: ``masks[position, word]`` holds the bits of 64 languages a word."""

    languages: list[str]
    masks: np.ndarray
    false_rates: np.ndarray

    @classmethod
    def build(cls, languages: list[str], keys: np.ndarray, members: np.ndarray) -> LanguageFilter:
        """``members[i]`` are the indices into ``languages`` for gram ``keys[i]``, one pair per containment."""
        size = 1 << max(10, int(BITS_PER_GRAM * max(1, len(np.unique(keys)))).bit_length())
        masks = np.zeros((size, (len(languages) + 63) // 64 or 1), np.uint64)
        word, bit = members // 64, np.uint64(1) << (members % 64).astype(np.uint64)
        for position in _positions(keys, size):
            np.bitwise_or.at(masks, (position, word), bit)
        fill = [(masks[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)).mean() for i in range(len(languages))]
        return cls(languages, masks, np.array(fill) ** HASHES)

    def hits(self, keys: np.ndarray) -> np.ndarray:
        """Per n-gram, the mask of languages that contain it, false positives included."""
        found = None
        for position in _positions(keys, len(self.masks)):
            found = self.masks[position] if found is None else found & self.masks[position]
        return found

    def identify(self, texts: list[str]) -> tuple[list[str], list[float]]:
        keys, place, starts = _grams(texts)
        doc = np.searchsorted(starts, place, side="right") - 1
        grams = np.bincount(doc, minlength=len(texts)).astype(float)
        found = self.hits(keys)
        shares = np.zeros((len(texts), len(self.languages)))
        for i, rate in enumerate(self.false_rates):
            bits = (found[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)).astype(float)
            count = np.bincount(doc, bits, minlength=len(texts))
            shares[:, i] = np.maximum(0, (count - grams * rate) / max(1e-9, 1 - rate))
        total = shares.sum(axis=1)
        best = shares.argmax(axis=1)
        score = np.where(total > 0, shares[np.arange(len(texts)), best] / np.maximum(total, 1e-12), 0.0)
        known = [self.languages[i] if n else UNKNOWN for i, n in zip(best, grams, strict=True)]
        return known, [float(s) if n else 0.0 for s, n in zip(score, grams, strict=True)]


def count_grams(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """``lang, gram, n`` over all rows with a text and a language; tasks sum their slices before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            langs, values = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
            for name in sorted(set(langs)):
                keys, _, _ = _grams([v for v, other in zip(values, langs, strict=True) if other == name])
                gram, n = np.unique(keys, return_counts=True)
                yield pa.RecordBatch.from_pydict(
                    {"lang": pa.array([name] * len(gram)), "gram": pa.array(gram.view(np.int64)), "n": pa.array(n)}
                )

    rows = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    counted = rows.dropna().mapInArrow(count, "lang string, gram bigint, n bigint")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def learn_filter(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    min_share: float = MIN_SHARE,
    min_ratio: float = MIN_RATIO,
) -> LanguageFilter:
    """The filter of the languages in ``docs``. What reaches the driver has 1 / ``min_share`` rows per language at most."""
    counts = count_grams(docs, text, lang)
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total")).withColumnRenamed("lang", "lang2")
    shares = counts.join(F.broadcast(totals), F.col("lang") == F.col("lang2")).select(
        "lang", "gram", (F.col("n") / F.col("total")).alias("share")
    )
    shares = shares.where(F.col("share") >= min_share)
    rows = shares.toPandas()
    if not len(rows):
        return LanguageFilter([], np.zeros((2, 1), np.uint64), np.zeros(0))
    rows = rows[rows.share >= min_ratio * rows.groupby("gram").share.transform("max")].sort_values(["lang", "gram"])
    languages = sorted(rows.lang.unique())
    index = {name: i for i, name in enumerate(languages)}
    return LanguageFilter.build(
        languages, rows.gram.to_numpy(np.int64).view(np.uint64), rows.lang.map(index).to_numpy(np.int64)
    )


def identify(docs: DataFrame, model: LanguageFilter, key: str, text: str, *keep: Column) -> DataFrame:
    """``<key>``, the ``keep`` columns, ``lang_pred`` and ``score`` of every row."""

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            values = [value or "" for value in batch.column("text").to_pylist()]
            found, score = model.identify(values) if model.languages else ([UNKNOWN] * len(values), [0.0] * len(values))
            rest = batch.drop_columns(["text"])
            rest = rest.append_column("lang_pred", pa.array(found, pa.string()))
            yield rest.append_column("score", pa.array(score, pa.float64()))

    rows = docs.select(F.col(key).alias("key"), *keep, F.col(text).cast("string").alias("text"))
    own = [field for field in rows.schema if field.name != "text"]
    schema = StructType([*own, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return rows.mapInArrow(predict, schema).withColumnRenamed("key", key)


def language_id(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``<key>, held_out, lang_pred, score``; the filter is learned from the rows that are not held out."""
    model = learn_filter(docs.where(~held_out(key, FOLDS, FOLD)), text, lang)
    return identify(docs, model, key, text, held_out(key, FOLDS, FOLD).alias("held_out"))
