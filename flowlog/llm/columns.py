"""Column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed value: a word is a run of anything but ASCII blanks
WORD = r"[^\x20\x09-\x0D]+"


def text_or_empty(text: str) -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def word_count(text: str) -> Column:
    """Number of words; null counts as empty."""
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("bigint")


def held_out(key: str, folds: int, fold: int) -> Column:
    """Rows kept from learning: crc32 of the key as text, modulo ``folds``. A null key counts as empty text."""
    digits = F.coalesce(F.col(key).cast("string"), F.lit(""))
    return F.crc32(digits.cast("binary")) % F.lit(folds) == F.lit(fold)
