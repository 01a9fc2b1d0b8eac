"""Column expressions shared by the operators; all JVM-side."""

from .parsing import (
    event_time,
    nullify_missing,
    port_number,
    protocol_name,
    tolerant_long,
)
from .scalars import (
    action_class,
    percent_of,
    port_service,
    readable_bytes,
    risk_class,
    row_severity,
    similarity_pct,
)
from .text import (
    contains_text,
    haystack,
    matches_all,
    python_strip,
    record_message,
    search_terms,
    term_found,
)

__all__ = [
    "action_class",
    "contains_text",
    "event_time",
    "haystack",
    "matches_all",
    "nullify_missing",
    "percent_of",
    "port_number",
    "port_service",
    "protocol_name",
    "python_strip",
    "readable_bytes",
    "record_message",
    "risk_class",
    "row_severity",
    "search_terms",
    "similarity_pct",
    "term_found",
    "tolerant_long",
]
