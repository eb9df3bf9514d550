"""Scalar column helpers: bytes, identifiers, durations and captions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UUID_PATTERN = r"^[0-9A-Fa-f]{1,8}-[0-9A-Fa-f]{1,4}-[0-9A-Fa-f]{1,4}-[0-9A-Fa-f]{1,4}-[0-9A-Fa-f]{1,12}$"


def _hex_digits(value: Column, digits: int) -> Column:
    return F.right(F.lpad(F.hex(value.cast("bigint")), 16, "0"), F.lit(digits))


def be_int32(value: Column) -> Column:
    """Four big-endian bytes of an int."""
    return F.unhex(_hex_digits(value, 8))


def read_be_int32(data: Column, position: int) -> Column:
    """Signed big-endian int at a 1-based byte position; null when fewer than 4 bytes are left."""
    raw = F.conv(F.hex(F.substring(data, position, 4)), 16, 10).cast("bigint")
    # flipping the sign bit and taking it off again extends the sign with one use of ``raw``
    signed = (raw.bitwiseXOR(F.lit(1 << 31)) - (1 << 31)).cast("int")
    return F.when(F.octet_length(data) >= position + 3, signed)


def uuid_text(hex32: Column) -> Column:
    """32 hex digits as dashed lower-case text."""
    text = F.lower(hex32)
    return F.concat_ws(
        "-",
        F.substring(text, 1, 8),
        F.substring(text, 9, 4),
        F.substring(text, 13, 4),
        F.substring(text, 17, 4),
        F.substring(text, 21, 12),
    )


def uuid_from_longs(high: Column, low: Column) -> Column:
    """UUID text of its two 64-bit halves."""
    return uuid_text(F.concat(_hex_digits(high, 16), _hex_digits(low, 16)))


def parse_uuid(text: Column) -> Column:
    """A well-formed UUID with each part padded to its full length, else null."""
    parts = F.split(F.lower(text), "-")
    padded = [F.lpad(F.get(parts, F.lit(i)), n, "0") for i, n in enumerate((8, 4, 4, 4, 12))]
    return F.when(text.rlike(UUID_PATTERN), F.concat_ws("-", *padded))


def longs_from_uuid(text: Column) -> tuple[Column, Column]:
    """The two signed 64-bit halves of a UUID; null when it is not well-formed."""
    digits = F.replace(parse_uuid(text), F.lit("-"), F.lit(""))

    def half(position: int) -> Column:
        high = F.conv(F.substring(digits, position, 8), 16, 10).cast("bigint")
        low = F.conv(F.substring(digits, position + 8, 8), 16, 10).cast("bigint")
        return F.shiftleft(high, 32).bitwiseOR(low)

    return half(1), half(17)


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 code units (a character outside the BMP counts twice)."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def file_safe(text: Column) -> Column:
    return F.regexp_replace(text, "[/]", "_")


def caption(label: Column, score: Column) -> Column:
    """``label (0.87)``."""
    return F.format_string("%s (%1.2f)", label, score)


def truncate_product(fraction: Column, extent: int) -> Column:
    """Relative coordinate times an extent, truncated toward zero."""
    return (fraction * F.lit(extent)).cast("int")


def _epoch() -> Column:
    return F.lit("1970-01-01").cast("timestamp_ntz")


def micros(ts: Column) -> Column:
    """Microseconds since the epoch of a zoneless timestamp, whatever the session's zone."""
    since = ts.cast("timestamp_ntz") - _epoch()
    days, hours, minutes = (F.extract(F.lit(unit), since).cast("bigint") for unit in ("DAY", "HOUR", "MINUTE"))
    seconds = (F.extract(F.lit("SECOND"), since) * 1_000_000).cast("bigint")
    return ((days * 24 + hours) * 60 + minutes) * 60_000_000 + seconds


def from_micros(value: Column) -> Column:
    """Inverse of :func:`micros`."""
    none, seconds = F.lit(0), (value / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(18,6)")
    return _epoch() + F.make_dt_interval(none, none, none, seconds)


def seconds_interval(seconds: float) -> Column:
    """A fixed duration to add to a timestamp."""
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds).cast("decimal(18,6)"))
