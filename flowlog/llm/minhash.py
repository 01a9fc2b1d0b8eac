"""Document fingerprints by one-permutation MinHash, in built-in expressions only.

The word shingles of a text are hashed once; the low bits of a hash choose one of ``BINS`` bins and the rest competes for
the bin's minimum. An empty bin takes the value of the non-empty bin that comes first under the empty bin's own linear
hash of bin numbers (optimal densification: every text with the same non-empty bins borrows alike, and different empty
bins borrow independently). The lowest ``BITS`` bits of each minimum are packed as hex digits. Two fingerprints agree by
chance in 2**-BITS of the bins, which :func:`likeness` corrects.

Null and empty texts and texts of blanks only have an empty fingerprint: likeness 1 to each other, 0 to any other text.
Texts with fewer words than a shingle have one shingle. Equal texts have equal fingerprints. Texts are used whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .columns import text_or_empty

SHINGLE_WORDS = 5
BINS = 128
BITS = 8
_BIN_SHIFT = 57  # 64 bits less those of a bin number
_SIGNED = 1 << (BITS - 1)  # a byte is stored less this, to fit a signed one
_PRIME = 8191
_BLANKS = " \t\n\x0b\f\r"


def _hashes(words: Column, size: int) -> Column:
    """One hash per shingle, from the words' hashes."""
    last = F.greatest(F.size(words) - size, F.lit(0))
    return F.transform(
        F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(size)])
    )


def add_fingerprint(docs: DataFrame, text: str, column: str, size: int = SHINGLE_WORDS) -> DataFrame:
    """``docs`` and the fingerprint of column ``text``, an array with a byte per bin, empty for texts without words.

    Each step is a column of its own, so that no step is evaluated once per use.
    """
    own = [F.col(f"`{name}`") for name in docs.columns]
    trimmed = F.btrim(text_or_empty(text), F.lit(_BLANKS))
    words = F.split(trimmed, r"[\x20\x09-\x0D]+", -1)
    df = docs.select(*own, F.transform(words, lambda w: F.xxhash64(w)).alias("__w"), (trimmed == "").alias("__none"))
    # the bin in the top bits, the rest of the hash below: the least of a bin come first in each bin's run
    keyed = F.transform(
        _hashes(F.col("__w"), size),
        lambda h: F.shiftleft(h, _BIN_SHIFT).bitwiseOR(F.shiftrightunsigned(h, 64 - _BIN_SHIFT)),
    )
    df = df.select(*own, "__none", F.sort_array(keyed).alias("__s"))
    number = lambda x: F.shiftrightunsigned(x, _BIN_SHIFT).cast("int")
    least = F.filter(
        F.col("__s"), lambda x, i: (i == 0) | (number(F.get(F.col("__s"), i - 1)) != number(x))
    )
    df = df.select(*own, "__none", least.alias("__m"))
    value = lambda x: x.bitwiseAND((1 << BITS) - 1).cast("int")
    filled = F.transform(
        F.col("__m"), lambda x: F.struct(number(x).alias("bin"), value(x).alias("value"))
    )
    df = df.select(*own, "__none", filled.alias("__f"))
    places = F.transform(F.col("__f"), lambda f: f["bin"])
    empty = F.transform(
        F.array_except(F.sequence(F.lit(0), F.lit(BINS - 1)), places),
        lambda j: F.struct(
            j.alias("bin"),
            (F.pmod(F.xxhash64(j), F.lit(_PRIME - 1)) + 1).cast("int").alias("a"),
            F.pmod(F.xxhash64(j, F.lit(1)), F.lit(_PRIME)).cast("int").alias("b"),
        ),
    )
    df = df.select(*own, "__none", "__f", empty.alias("__e"))
    borrowed = F.transform(
        F.col("__e"),
        lambda e: F.struct(
            e["bin"].alias("bin"),
            F.array_min(
                F.transform(
                    F.col("__f"),
                    lambda f: ((f["bin"] * e["a"] + e["b"]) % _PRIME) * (1 << BITS) + f["value"],
                )
            )
            .bitwiseAND((1 << BITS) - 1)
            .alias("value"),
        ),
    )
    packed = F.transform(F.array_sort(F.concat("__f", borrowed)), lambda f: (f["value"] - _SIGNED).cast("tinyint"))
    none = F.array().cast("array<tinyint>")
    return df.select(*own, F.when(F.col("__none"), none).otherwise(packed).alias(column))


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of common shingles, 0 to 1: agreeing bins less those that agree by chance."""
    chance = 2.0**-BITS
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    share = (same / F.lit(float(BINS)) - chance) / (1 - chance)
    empty = (F.size(a) == 0) | (F.size(b) == 0)
    both = (F.size(a) == 0) & (F.size(b) == 0)
    return F.when(both, 1.0).when(empty, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), share)))


def packed_hex(bins: Column) -> Column:
    """The bins as hex digits, two each."""
    return F.lower(F.array_join(F.transform(bins, lambda x: F.lpad(F.hex(x.cast("int") + _SIGNED), 2, "0")), ""))


def next_keys(docs: DataFrame, key: str) -> DataFrame:
    """``key, next_key`` for all different keys, ascending, nulls first; the first follows the last.

    Keys are dealt out by ranges and compared with their neighbour inside a range; only the first key of each range is
    looked at across ranges.
    """
    keys = docs.select(F.col(key).alias("key")).distinct().repartitionByRange("key")
    keys = materialize(keys.withColumn("part", F.spark_partition_id()))
    inside = Window.partitionBy("part").orderBy(F.col("key").asc_nulls_first())
    # a null key is a key too: what follows is wrapped, so that null says "no next row"
    rows = keys.select("key", "part", F.lead(F.struct("key")).over(inside).alias("after"))
    firsts = keys.groupBy("part").agg(F.min(F.struct(F.col("key").isNotNull().alias("some"), "key")).alias("least"))
    order = Window.orderBy("part")  # a row per range
    firsts = firsts.select(
        F.col("part").alias("part2"),
        F.coalesce(
            F.lead("least").over(order), F.first("least").over(order.rowsBetween(Window.unboundedPreceding, 0))
        ).alias("first"),
    )
    joined = rows.join(F.broadcast(firsts), F.col("part") == F.col("part2"))
    return joined.select(
        "key", F.when(F.col("after").isNotNull(), F.col("after.key")).otherwise(F.col("first.key")).alias("next_key")
    )


def fingerprint_edits(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness.

    The edited text keeps the first half and goes on with as much of the next document's beginning. Returns ``<key>,
    n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` for every row. Where different texts
    share a key, the one with the least hash stands for the key as a next document.

    Texts are shuffled once by key, and their beginnings once to the document before.
    """
    # the key in a struct: never null itself, so that plain equality joins null keys too and all joins share one exchange
    own = F.struct(F.col(key).alias("key")).alias("own")
    rows = docs.select(own, text_or_empty(text).alias("text")).repartition("own")
    sizes = docs.select(own, F.char_length(text_or_empty(text)).alias("n_chars"))
    links = next_keys(docs, key).select(F.struct("key").alias("asking"), F.struct(F.col("next_key").alias("key")).alias("following"))
    need = sizes.groupBy("own").agg(F.max("n_chars").alias("most"))
    asked = links.join(need, F.col("asking") == F.col("own")).select(
        "asking", "following", F.floor(F.col("most") / 2).cast("int").alias("most")
    )
    asked = materialize(asked)
    first = rows.groupBy("own").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("least"))
    begins = first.join(asked, F.col("own") == F.col("following")).select(
        "asking", "following", F.expr("left(least.text, most)").alias("begin")
    )
    joined = rows.join(begins, F.col("own") == F.col("asking"))
    size = F.char_length("text")
    half = F.floor(size / 2).cast("int")
    edited = F.concat(F.left(F.col("text"), size - half), F.left(F.col("begin"), half))
    joined = joined.select("own", "following", "text", size.cast("bigint").alias("n_chars"), edited.alias("edited"))
    marked = add_fingerprint(joined, "text", "print")
    marked = marked.select(
        "own", "following", "n_chars", "print", F.xxhash64("text").alias("h"), "edited",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
    )
    marked = materialize(add_fingerprint(marked, "edited", "edited_print").drop("edited"))
    prints = marked.groupBy("own").agg(F.min(F.struct("h", "print")).alias("least"))
    prints = prints.select(F.col("own").alias("other"), F.col("least.print").alias("next_print"))
    out = marked.join(prints, F.col("following") == F.col("other"))
    return out.select(
        F.col("own.key").alias(key),
        "n_chars",
        "edited_sha256",
        packed_hex(F.col("print")).alias("fingerprint"),
        packed_hex(F.col("edited_print")).alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
        likeness(F.col("print"), F.col("next_print")).alias("near_next"),
    )
