"""Scalar functions of the command layer, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def padded(c: Column, width: int = 32) -> Column:
    """Text of a non-negative number, zeros in front, so that byte order is numeric order."""
    return F.lpad(c.cast("string"), width, "0")


def strict_int(c: Column) -> Column:
    """The 32-bit integer that the whole text is, else null; white space or a plus sign make it null."""
    number = F.when(c.rlike("^-?[0-9]{1,18}$"), c.try_cast("bigint"))
    return F.when(number.between(-(1 << 31), (1 << 31) - 1), number)


def lenient_int(c: Column) -> Column:
    """The integer that text begins with, after white space, else null."""
    return F.regexp_extract(c, r"^\s*([+-]?\d{1,18})", 1).try_cast("bigint")


def expired(expire_at: Column, now: int) -> Column:
    """Strictly before now, in whole seconds; null never expires."""
    return F.coalesce(expire_at < now, F.lit(False))


def after_marker(c: Column, marker: str) -> Column:
    """Text after the first marker, or null without one."""
    place = F.instr(c, marker)
    return F.when(place > 0, F.substr(c, place + len(marker)))


def checksum(c: Column) -> Column:
    """CRC-32 of text."""
    return F.crc32(c.cast("binary"))
