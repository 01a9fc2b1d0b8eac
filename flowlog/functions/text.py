"""Text predicates and cleaning."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space plus the four ASCII separators that str.strip also drops.
_SPACE = r"[\s\x1c-\x1f]"
_FIELD_BREAK = "\n"


def python_strip(col: Column) -> Column:
    """Remove all leading and trailing white space (SQL ``trim`` drops only blanks)."""
    return F.regexp_replace(col, f"(?U)^{_SPACE}+|{_SPACE}+$", "")


def search_terms(text: str | None) -> list[str]:
    """White-space separated terms of a keyword query."""
    return (text or "").split()


def _has_wildcard(text: str) -> bool:
    return "%" in text or "_" in text


def contains_text(col: Column, text: str) -> Column:
    """``col LIKE '%text%'`` ignoring case; ``%`` and ``_`` inside ``text`` are wildcards.

    A text without wildcards is a plain substring test, and one without letters
    (an IPv4 address) needs no case folding, so the parquet scan can use it.
    """
    if _has_wildcard(text):
        escaped = text.replace("\\", "\\\\")
        return col.ilike(f"%{escaped}%")
    if text.lower() == text.upper():
        return col.contains(text)
    return F.contains(F.lower(col), F.lower(F.lit(text)))


def haystack(columns: Sequence[str]) -> Column:
    """Lower-cased search text of a record; fields are kept apart by line breaks."""
    return F.lower(F.concat_ws(_FIELD_BREAK, *columns))


def term_found(term: str, columns: Sequence[str], joined: Column) -> Column:
    """``term`` occurs in at least one of ``columns``.

    ``joined`` is :func:`haystack` of the same columns. A term holds no white
    space, so a substring hit there cannot span two fields; only a term with
    wildcards has to be tried field by field.
    """
    if _has_wildcard(term):
        hits = [F.coalesce(contains_text(F.col(c), term), F.lit(False)) for c in columns]
        return reduce(or_, hits)
    return F.contains(joined, F.lower(F.lit(term)))


def matches_all(terms: Sequence[str], columns: Sequence[str]) -> Column:
    """Every term occurs in at least one of ``columns``."""
    # long terms match least often, so they are tested first
    by_length = sorted(terms, key=len, reverse=True)
    return reduce(and_, [term_found(t, columns, haystack(columns)) for t in by_length])


def record_message() -> Column:
    """One-line description of a record, the text that searches run over."""

    def shown(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit("None"))

    return F.concat(
        F.col("protocol"),
        F.lit(" "),
        F.col("action"),
        F.lit(" from "),
        shown("src_ip"),
        F.lit(":"),
        shown("src_port"),
        F.lit(" to "),
        shown("dst_ip"),
        F.lit(":"),
        shown("dst_port"),
        F.lit(", bytes="),
        shown("bytes"),
    )
