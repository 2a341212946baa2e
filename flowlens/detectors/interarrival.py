"""Variation of inter-arrival times: standard deviation over mean."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import DEFAULT_POLICY, SlicePolicy, with_previous, with_running_sums
from ..operators.windows import EVENT_TIME, ORDERS, FlowWindow, session_bounds, shares_panes, window_gap_sums, window_gaps
from .base import Detector, register
from .elements import ordered_gaps


def variation(sd: Column, mean: Column) -> Column:
    """0 where there is no gap or the mean gap is 0."""
    return F.when(mean.isNull() | (mean == 0), F.lit(0.0)).otherwise(sd / mean)


def exact_variation(gaps: Column, total: Column, squares: Column) -> Column:
    """From the number of gaps, their sum and the sum of their squares, both whole numbers."""
    n, wide = gaps.cast("double"), total.cast("decimal(19,0)")
    mean = F.when(n > 0, total / n)
    spread = squares * gaps.cast("decimal(18,0)") - wide * wide
    return variation(F.when(n > 0, F.sqrt(spread.cast("double")) / n), mean)


@register
class InterArrivalCvDetector(Detector):
    name = "InterArrivalCvDetector"
    feature_based = False  # defined over the packets of a window
    details = ("cv", "packetCount", "detected")

    def __init__(self, settings=None):
        super().__init__(settings)
        self.threshold = self.settings.number("threshold", 0.5)
        self.min_packets = self.settings.integer("minPackets", 10)

    def _finish(self, df: DataFrame) -> DataFrame:
        return df.where(F.col("packetCount") >= self.min_packets).withColumn("detected", F.col("cv") > self.threshold)

    def score(
        self, packets: DataFrame, w: FlowWindow, order: str = EVENT_TIME, policy: SlicePolicy = DEFAULT_POLICY
    ) -> DataFrame:
        if shares_panes(w, order):
            sums = window_gap_sums(packets, w, order, policy).withColumn("packetCount", F.col("n"))
            scored = self._finish(sums.withColumn("cv", exact_variation(F.col("n") - 1, F.col("gap_sum"), F.col("gap_squares"))))
            return scored.select(*w.group, F.col("packetCount").alias("packets_in_window"), *self.details)
        rows, window = window_gaps(packets.select("flow_key", "ts_ms", "seq"), w, order, policy)
        gap = F.col("ts_ms") - F.col("prev_ts")
        aggs = [
            F.count(F.lit(1)).alias("packetCount"),
            variation(F.stddev_pop(gap), F.avg(gap)).alias("cv"),
            F.min("ts_ms").alias("first_ts"), F.max("ts_ms").alias("last_ts"),
        ]
        if w.counted:
            aggs.append(F.max("rn").alias("last_rn"))
        scored = session_bounds(rows.groupBy(*window).agg(*aggs), w)
        if w.counted:
            scored = scored.where(w.closed(F.col("last_rn")))
        scored = self._finish(scored)
        return scored.select(*w.group, F.col("packetCount").alias("packets_in_window"), *self.details)

    def score_elements(self, windows: DataFrame, order: str = EVENT_TIME) -> DataFrame:
        df = windows.withColumn("_gaps", ordered_gaps("elements", order))
        count = F.size("_gaps")
        mean = F.when(count > 0, F.aggregate("_gaps", F.lit(0.0), lambda a, g: a + g) / count)
        df = df.withColumn("_mean", mean)
        squares = F.aggregate("_gaps", F.lit(0.0), lambda a, g: a + (g - F.col("_mean")) * (g - F.col("_mean")))
        df = df.withColumns(
            {
                "packetCount": F.size("elements").cast("bigint"),
                "cv": variation(F.when(count > 0, F.sqrt(squares / count)), F.col("_mean")),
            }
        )
        return self._finish(df).drop("elements", "_gaps", "_mean")

    def score_running(
        self, packets: DataFrame, order: str = EVENT_TIME, policy: SlicePolicy = DEFAULT_POLICY
    ) -> DataFrame:
        """Running variation from running sums of the gaps and of their squares.

        The squares are summed as decimals: they are whole numbers, and the
        variance is a small difference of large sums.
        """
        rows = with_previous(
            packets.select("flow_key", "ts_ms", "seq"), ["flow_key"], ORDERS[order], "ts_ms", policy,
            name="prev_ts", number="rn",
        )
        gap = F.coalesce(F.col("ts_ms") - F.col("prev_ts"), F.lit(0))
        wide = gap.cast("decimal(18,0)")
        rows = with_running_sums(rows, ["flow_key"], ORDERS[order], {"_sum": gap, "_squares": wide * wide}, policy)
        cv = exact_variation(F.col("rn") - 1, F.col("_sum"), F.col("_squares"))
        rows = rows.withColumns({"packetCount": F.col("rn"), "cv": cv})
        return self._finish(rows).select("flow_key", "ts_ms", "seq", *self.details)
