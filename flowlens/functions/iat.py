"""Inter-arrival times (IAT) and their symbol code."""

from __future__ import annotations

import math
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# The letter for n leading zeros after the decimal point, and the overflow symbol
ZERO_LETTERS = "XABCDEFGHIJKLMNOPQRSTUVWYZ"
OVERFLOW_SYMBOL = "Z"
MAX_PRECISION = 9  # 10**9 is the largest power of ten in 32 bits

# A whole number of milliseconds is at least 0.001 s: two shifts bring it to 0.1 or more.
MILLISECOND_SHIFTS = 2


def iat_seconds(delta_ms: Column) -> Column:
    return delta_ms / F.lit(1000.0)


def valid_iat(delta_ms: Column, threshold_ms: float) -> Column:
    """Positive and not longer than the idle threshold."""
    seconds = iat_seconds(delta_ms)
    return (seconds > 0) & (seconds <= F.lit(threshold_ms / 1000.0))


def iat_code(seconds: Column, precision: int = 2, shifts: int = len(ZERO_LETTERS) - 1) -> Column:
    """Text code of an IAT: a letter for the leading zeros, then the rounded leading digits.

    The value is scaled by ten, in doubles, until it reaches 0.1. ``shifts``
    bounds that scaling; smaller values are written as the overflow symbol.
    """
    if not 0 <= precision <= MAX_PRECISION:
        raise ValueError(f"precision must be between 0 and {MAX_PRECISION}")
    scale = 10**precision

    def symbol(scaled: Column, zeros: int) -> Column:
        exact = F.floor(scaled * F.lit(float(scale)) + F.lit(0.5))
        # the symbol holds a 32-bit integer, which wraps for very long gaps
        digits = F.pmod(exact + F.lit(1 << 31), F.lit(1 << 32)) - F.lit(1 << 31)
        carried = digits >= scale
        plain = F.when(carried, F.floor(digits / 10)).otherwise(digits).cast("string")
        if zeros == 0:
            return plain
        kept = F.concat(F.lit(ZERO_LETTERS[zeros - 1]), plain)
        after_carry = plain if zeros == 1 else F.concat(F.lit(ZERO_LETTERS[zeros - 2]), plain)
        return F.when(carried, after_carry).otherwise(kept)

    scaled = seconds.cast("double")
    code = F.when(scaled <= 0, F.lit(OVERFLOW_SYMBOL))
    for zeros in range(shifts + 1):
        code = code.when(scaled >= F.lit(0.1), symbol(scaled, zeros))
        scaled = scaled * F.lit(10.0)
    return F.when(seconds.isNotNull(), code.otherwise(F.lit(OVERFLOW_SYMBOL)))


@lru_cache(1 << 16)
def code_of(delta_ms: int, precision: int = 2) -> str:
    """As :func:`iat_code_ms`, for one number outside of a plan."""
    scale, scaled = 10**precision, delta_ms / 1000.0
    if scaled <= 0:
        return OVERFLOW_SYMBOL
    for zeros in range(MILLISECOND_SHIFTS + 1):
        if scaled >= 0.1:
            digits = (math.floor(scaled * float(scale) + 0.5) + (1 << 31)) % (1 << 32) - (1 << 31)
            carried = digits >= scale
            letters = zeros - carried
            return (ZERO_LETTERS[letters - 1] if zeros and letters > 0 else "") + str(digits // 10 if carried else digits)
        scaled *= 10.0
    return OVERFLOW_SYMBOL


def iat_code_ms(delta_ms: Column, precision: int = 2) -> Column:
    """Code of a gap in whole milliseconds."""
    return iat_code(iat_seconds(delta_ms), precision, MILLISECOND_SHIFTS)
