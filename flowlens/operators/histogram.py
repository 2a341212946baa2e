"""Value histograms per window and their Shannon entropy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import DEFAULT_POLICY, SlicePolicy, with_row_number
from .windows import (
    EVENT_TIME, ORDERS, SESSION, FlowWindow, assign_sessions, assign_time_windows, shares_panes, windowed_counts, windows_of_units, with_unit,
)

ENTROPY_DECIMALS = 12


def entropy_bits(n: Column) -> Column:
    """Aggregate: entropy of a histogram whose bins hold ``n`` (nulls are skipped).

    ``-sum(p log2 p)`` with ``p = n / total`` rearranged to one pass over the bins.
    Rounded to 12 decimals: equal bins then give exact values (0, 3, ...) whatever
    the order of summation, which matters where a threshold is met exactly.
    """
    total = F.sum(n).cast("double")
    return F.round(F.log2(total) - F.sum(n * F.log2(n.cast("double"))) / total, ENTROPY_DECIMALS)


def port_histogram(
    packets: DataFrame, w: FlowWindow, order: str = EVENT_TIME, policy: SlicePolicy = DEFAULT_POLICY
) -> DataFrame:
    """``n`` per flow, window and ``dest_port``; port -1 collects the packets without one.

    At most 65,537 rows per window, counted before they are shuffled.
    """
    return windowed_counts(packets, w, ("dest_port",), order, policy)


def window_entropy(histogram: DataFrame, w: FlowWindow) -> DataFrame:
    """Entropy, distinct ports and packet counts of each window that has fired."""
    with_port = F.col("dest_port") >= 0
    bin_size = F.when(with_port, F.col("n"))
    aggs = [
        F.sum("n").alias("packet_count"),
        F.coalesce(F.sum(F.when(~with_port, F.col("n"))), F.lit(0)).alias("skipped_count"),
        F.count(bin_size).alias("unique_ports"),
        entropy_bits(bin_size).alias("entropy_score"),
    ]
    if "last_rn" not in histogram.columns:
        return histogram.groupBy(*w.group).agg(*aggs)
    merged = histogram.groupBy(*w.group).agg(*aggs, F.max("last_rn").alias("last_rn"))
    return merged.where(w.closed(F.col("last_rn"))).drop("last_rn")


#: Registers of a sketch as a power of two: 4 KB, relative standard error 1.6 %.
SKETCH_BITS = 12


def sketched_ports(
    packets: DataFrame, w: FlowWindow, order: str = EVENT_TIME, policy: SlicePolicy = DEFAULT_POLICY, bits: int = SKETCH_BITS
) -> DataFrame:
    """``packet_count, skipped_count, unique_ports``, the last one estimated.

    The scale option beside :func:`window_entropy`: a pane or block keeps one sketch of bounded size and not
    a row per port, and windows unite the sketches of their units. Any 64-bit column
    named ``dest_port`` will do, where a histogram may have as many rows as packets.
    """
    with_port = F.col("dest_port") >= 0
    counted = [
        F.count(F.lit(1)).alias("packet_count"), F.count(F.when(~with_port, 1)).alias("skipped_count"),
        F.hll_sketch_agg(F.when(with_port, F.col("dest_port")), bits).alias("sketch"),
    ]
    merged = [F.sum("packet_count").alias("packet_count"), F.sum("skipped_count").alias("skipped_count"), F.hll_union_agg("sketch").alias("sketch")]
    rows = packets.select("flow_key", "ts_ms", "seq", "dest_port")
    if w.counted:
        rows = with_row_number(rows, ["flow_key"], ORDERS[order], policy)
        units = with_unit(rows, w).groupBy("flow_key", "_unit").agg(*counted, F.max("rn").alias("last_rn"))
        windows = windows_of_units(units, w).groupBy(*w.group).agg(*merged, F.max("last_rn").alias("last_rn"))
        windows = windows.where(w.closed(F.col("last_rn")))
    elif shares_panes(w, EVENT_TIME):  # counting needs no order
        windows = windows_of_units(with_unit(rows, w).groupBy("flow_key", "_unit").agg(*counted), w).groupBy(*w.group).agg(*merged)
    else:
        placed = assign_sessions(rows, w.size_ms) if w.kind == SESSION else assign_time_windows(rows, w)
        windows = placed.groupBy(*w.group).agg(*counted)
    return windows.select(*w.group, "packet_count", "skipped_count", F.hll_sketch_estimate("sketch").alias("unique_ports"))
