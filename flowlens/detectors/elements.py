"""Expressions over the packets of one window held as an array (stream windows)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.iat import iat_code_ms, valid_iat
from ..operators.windows import EVENT_TIME, ORDERS


def times_in_order(elements: str, order: str = EVENT_TIME) -> Column:
    """Packet times in event-time or arrival order."""
    keyed = F.transform(elements, lambda e: F.struct(*[e[c].alias(c) for c in ORDERS[order]], e["ts_ms"].alias("t")))
    return F.transform(F.array_sort(keyed), lambda e: e["t"])


def adjacent_differences(times: Column) -> Column:
    """One element fewer than ``times`` (none for fewer than two)."""
    later = F.slice(times, F.lit(2), F.greatest(F.size(times) - 1, F.lit(0)))
    earlier = F.slice(times, F.lit(1), F.greatest(F.size(times) - 1, F.lit(0)))
    return F.zip_with(later, earlier, lambda b, a: b - a)


def ordered_gaps(elements: str, order: str = EVENT_TIME) -> Column:
    return adjacent_differences(times_in_order(elements, order))


def code_list(gaps: str | Column, threshold_ms: float, precision: int) -> Column:
    usable = F.filter(gaps, lambda g: valid_iat(g, threshold_ms))
    return F.transform(usable, lambda g: iat_code_ms(g, precision))
