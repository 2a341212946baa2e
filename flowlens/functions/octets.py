"""Big-endian integers in binary columns (network byte order)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# hex digits per integer width
_INT32_HEX = 8
_INT64_HEX = 16


def _pos(offset: int | Column) -> Column:
    """``substring`` counts from 1; packet offsets count from 0."""
    return F.lit(offset + 1) if isinstance(offset, int) else offset + F.lit(1)


def slice_at(raw: Column, offset: int | Column, length: int) -> Column:
    return F.substring(raw, _pos(offset), F.lit(length))


def digits_at(raw: Column, offset: int | Column, length: int, base: int = 10) -> Column:
    """Text of the unsigned integer in ``length`` bytes that are known to be there (null if none is)."""
    return F.conv(F.hex(slice_at(raw, offset, length)), 16, base)


def uint_in(raw: Column, offset: int | Column, length: int) -> Column:
    """Unsigned integer of at most 3 bytes that are known to be there (null if none is)."""
    return digits_at(raw, offset, length).cast("int")


def read_int32(raw: Column, offset: int) -> Column:
    """Signed 32-bit integer from bytes that are known to be there."""
    unsigned = digits_at(raw, offset, 4).cast("bigint")
    # up to the top of 64 bits and back down: the second shift carries the sign
    return F.shiftright(F.shiftleft(unsigned, 32), 32).cast("int")


def read_int64(raw: Column, offset: int) -> Column:
    """Signed 64-bit integer from bytes that are known to be there."""
    return digits_at(raw, offset, 8, base=-10).cast("bigint")  # a negative base reads as signed


def write_int32(value: Column) -> Column:
    digits = F.hex(value.cast("bigint"))
    # a negative bigint prints as 16 digits; its low 8 are the 32-bit pattern
    return F.unhex(F.right(F.lpad(digits, _INT64_HEX, "0"), F.lit(_INT32_HEX)))


def write_int64(value: Column) -> Column:
    return F.unhex(F.lpad(F.hex(value.cast("bigint")), _INT64_HEX, "0"))
