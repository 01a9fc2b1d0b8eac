"""Display columns: shares, sizes, similarity and row classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import PORT_SERVICES


def percent_of(count: Column, largest: Column) -> Column:
    """Whole percent of ``count`` relative to ``largest``, halves rounded up."""
    share = count / F.greatest(largest, F.lit(1)) * 100
    return F.floor(share + 0.5)


def similarity_pct(distance: Column) -> Column:
    """Squared distance of unit vectors as a similarity of 0 to 100."""
    return F.greatest(F.lit(0), F.floor((1 - distance / 2) * 100 + 0.5))


def readable_bytes(size: Column) -> Column:
    def scaled(unit_size: int, unit: str) -> Column:
        value = F.round(size / unit_size, 1).cast("decimal(20,1)")
        return F.concat(value.cast("string"), F.lit(unit))

    return (
        F.when(size.isNull() | (size == 0), "0 B")
        .when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
        .when(size < 1024 * 1024, scaled(1024, " KB"))
        .otherwise(scaled(1024 * 1024, " MB"))
    )


def port_service(port: Column) -> Column:
    """Service usually found behind a port, empty when there is none."""
    hints = F.create_map(*[F.lit(x) for kv in PORT_SERVICES.items() for x in kv])
    return F.coalesce(F.try_element_at(hints, port), F.lit(""))


def row_severity(action: Column, dst_port: Column) -> Column:
    return (
        F.when(action == "PSH", "warn").when(dst_port.isin(22, 23), "danger").otherwise("")
    )


def action_class(action: Column) -> Column:
    return (
        F.when(action == "PSH", "warn")
        .when(action == "SYN", "info")
        .when(action == "ACK", "ok")
        .otherwise("")
    )


def risk_class(level: Column, other: str = "") -> Column:
    return F.when(level.isin("HIGH", "MEDIUM", "LOW"), F.lower(level)).otherwise(other)


def iso_time(time: Column) -> Column:
    """ISO text of a time; fractions of a second only where there are any."""
    plain = F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(F.date_format(time, "SSSSSS") == "000000", plain).otherwise(F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def stamped_name(name: Column, time: Column) -> Column:
    """A file name behind the second of its upload, blanks as underscores."""
    return F.concat(F.date_format(time, "yyyyMMdd_HHmmss"), F.lit("_"), F.replace(name, F.lit(" "), F.lit("_")))
