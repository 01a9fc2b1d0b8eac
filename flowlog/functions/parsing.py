"""Cell parsing: missing values, tolerant numbers, protocol names, time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import MISSING_TEXTS, PROTOCOL_NAMES, UNKNOWN
from .text import python_strip

# Decimal or scientific notation. Java's own parser would also take 12d or 0x1p3.
_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"

_DMY = r"^\s*(\d{1,2})/(\d{1,2})/(\d{4})"
_CLOCK = r"(\d{1,2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?)"


_MISSING = ", ".join(f"'{text}'" for text in MISSING_TEXTS)


def nullify_missing(column: str) -> Column:
    return F.expr(f"CASE WHEN {column} NOT IN ({_MISSING}) THEN {column} END")


def tolerant_long(col: Column) -> Column:
    """Number text truncated toward zero; anything else is null."""
    text = F.when(col.rlike(_NUMBER), F.trim(col))
    return text.try_cast("double").try_cast("bigint")


def port_number(col: Column) -> Column:
    return tolerant_long(col).try_cast("int")


def protocol_name(col: Column) -> Column:
    """Protocol number to name; other codes stay as digits, names are upper-cased."""
    code = tolerant_long(col)
    names = F.create_map(*[F.lit(x) for kv in PROTOCOL_NAMES.items() for x in kv])
    return F.coalesce(
        F.try_element_at(names, code.try_cast("int")),
        code.cast("string"),
        F.upper(python_strip(col)),
        F.lit(UNKNOWN),
    )


def event_time(col: Column, month_first: bool = False) -> Column:
    """Timestamp text to wall-clock time; unreadable text is null.

    Reads ISO text (blank or ``T`` between date and time) and slashed dates,
    day first unless ``month_first``. No session time zone is involved.
    """
    order = "$3-$1-$2" if month_first else "$3-$2-$1"
    timed = F.regexp_replace(col, f"{_DMY}[ T]+{_CLOCK}\\s*$", f"{order} $4")
    slashed = F.regexp_replace(timed, f"{_DMY}\\s*$", order)
    iso = F.when(col.contains("/"), slashed).otherwise(col)
    return F.when(iso.contains("-"), iso.try_cast("timestamp_ntz"))
