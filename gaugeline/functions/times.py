"""Timestamps: time-ordered identifiers and calendar days."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: 100-nanosecond ticks from the epoch of version-6 identifiers (1582) to 1970.
_GREGORIAN_OFFSET_100NS = 0x01B21DD213814000
_UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def uuid6_timestamp(identifier: Column) -> Column:
    """Creation time inside a version-6 UUID; null for anything else."""
    valid = identifier.rlike(_UUID) & (F.substring(identifier, 15, 1) == "6")
    digits = F.concat(F.substring(identifier, 1, 8), F.substring(identifier, 10, 4), F.substring(identifier, 16, 3))
    ticks = F.conv(F.when(valid, digits), 16, 10).cast("bigint")
    return F.timestamp_micros(F.floor((ticks - F.lit(_GREGORIAN_OFFSET_100NS)) / 10).cast("bigint"))


def uuid6_from_timestamp(at: Column, tail: Column) -> Column:
    """A version-6 UUID for a timestamp; ``tail`` fills the node digits."""
    ticks = F.lpad(F.lower(F.hex(F.unix_micros(at) * 10 + F.lit(_GREGORIAN_OFFSET_100NS))), 15, "0")
    return F.concat(F.substring(ticks, 1, 8), F.lit("-"), F.substring(ticks, 9, 4), F.lit("-6"), F.substring(ticks, 13, 3),
                    F.lit("-8000-"), F.lpad(F.lower(F.hex(tail)), 12, "0"))


def utc_day(at: Column) -> Column:
    return F.to_date(at)
