"""Compressibility of coded inter-arrival times.

Regular timing gives repetitive code text, which gzip shortens more: the score
is text length over gzip length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.gzip import gzip_length, running_gzip_lengths, score
from ..operators.ordering import DEFAULT_POLICY, SlicePolicy, with_previous
from ..operators.texts import compressibility, overlapping_lengths, shares_texts, text_pieces, with_codes, with_window_totals
from ..operators.windows import EVENT_TIME, ORDERS, FlowWindow, session_bounds, window_gaps
from .base import Detector, register
from .elements import adjacent_differences, code_list, times_in_order


@register
class CompressibilityDetector(Detector):
    """Works on the sorted packet times of a window, whatever order they arrived in."""

    name = "CompressibilityDetector"
    key = "five_tuple"
    feature_based = False
    skips_negative_times = False
    # fixed values: names of result details, which readers look for
    details = (
        "compressibility_score", "flowIdChanges", "executionMode", "iat_count", "windowType",
        "packet_count", "precision", "iat_threshold_ms", "testlauf", "anomaly",
    )

    def __init__(self, settings=None):
        super().__init__(settings)
        self.iat_threshold_ms = self.settings.number("iatThresholdMs", 1000.0)
        self.precision = self.settings.integer("precision", 2)
        self.anomaly_threshold = self.settings.number("anomalyThreshold", 0.7)
        self.min_iats = self.settings.integer("minIats", 5)

    def _order(self, order: str) -> str:
        return EVENT_TIME

    def _enough(self) -> Column:
        return (F.col("packets") >= 2) & (F.col("codes") >= self.min_iats)

    def _counts(self) -> dict[str, Column]:
        """``iat_count`` is the number of packet times here, not of codes."""
        return {"iat_count": F.col("packets"), "packet_count": F.col("packets")}

    def _finish(self, df: DataFrame) -> DataFrame:
        return df.withColumns(
            {
                **self._counts(),
                # a window belongs to one key, so its packets never change flow
                "flowIdChanges": F.lit(0),
                "precision": F.lit(self.precision),
                "iat_threshold_ms": F.lit(self.iat_threshold_ms),
                "anomaly": F.col("compressibility_score") > self.anomaly_threshold,
                **self.echo(),
            }
        )

    def pieces(
        self, packets: DataFrame, w: FlowWindow, order: str = EVENT_TIME, policy: SlicePolicy = DEFAULT_POLICY
    ) -> tuple[DataFrame, list[str]]:
        """Code texts per window and slice, and the columns that identify a window."""
        order = self._order(order)
        usable = F.col("ts_ms") >= 0 if self.skips_negative_times else None
        rows, window = window_gaps(packets.select("flow_key", "ts_ms", "seq"), w, order, policy, usable)
        if self.skips_negative_times:
            known = usable & (F.col("prev_ts") >= 0)
            rows = rows.withColumn("prev_ts", F.when(known, F.col("prev_ts")))
        return text_pieces(with_codes(rows, self.iat_threshold_ms, self.precision), window, ORDERS[order]), window

    def score(
        self, packets: DataFrame, w: FlowWindow, order: str = EVENT_TIME, policy: SlicePolicy = DEFAULT_POLICY
    ) -> DataFrame:
        if shares_texts(w, self._order(order)):
            usable = F.col("ts_ms") >= 0 if self.skips_negative_times else None
            lengths = overlapping_lengths(packets, w, self._order(order), policy, self.iat_threshold_ms, self.precision, usable)
            scored = lengths.where(self._enough()).withColumn("compressibility_score", score(F.col("text_len"), F.col("gzip_len")))
            return self._finish(scored).select(*w.group, F.col("packets").alias("packets_in_window"), *self.details)
        pieces, window = self.pieces(packets, w, order, policy)
        totals = with_window_totals(pieces, window).where(self._enough())
        if w.counted:
            totals = totals.where(w.closed(F.col("last_rn")))
        scored = self._finish(session_bounds(compressibility(totals, window), w))
        return scored.select(*w.group, F.col("packets").alias("packets_in_window"), *self.details)

    def score_elements(self, windows: DataFrame, order: str = EVENT_TIME) -> DataFrame:
        order = self._order(order)
        timed = F.filter("elements", lambda e: e["ts_ms"] >= 0) if self.skips_negative_times else "elements"
        df = windows.withColumn("_times", times_in_order(timed, order))
        df = df.withColumn("_gaps", adjacent_differences(F.col("_times")))
        df = df.withColumn("_codes", code_list("_gaps", self.iat_threshold_ms, self.precision))
        df = df.withColumns(
            {
                "packets": F.size("elements").cast("bigint"),
                "codes": F.size("_codes").cast("bigint"),
                "_text": F.array_join("_codes", ""),
            }
        ).where(self._enough())
        df = df.withColumn("compressibility_score", score(F.octet_length("_text"), gzip_length("_text")))
        return self._finish(df).drop("elements", "_times", "_gaps", "_codes", "_text", "packets", "codes")

    def score_running(
        self, packets: DataFrame, order: str = EVENT_TIME, policy: SlicePolicy = DEFAULT_POLICY
    ) -> DataFrame:
        rows = with_previous(
            packets.select("flow_key", "ts_ms", "seq"), ["flow_key"], ORDERS[EVENT_TIME], "ts_ms", policy,
            name="prev_ts", number="packets",
        )
        coded = with_codes(rows, self.iat_threshold_ms, self.precision)
        return self.score_lengths(running_gzip_lengths(coded.select("flow_key", "ts_ms", "seq", "packets", "code")))

    def score_lengths(self, lengths: DataFrame) -> DataFrame:
        """Results after each packet from ``packets, codes, text_len, gzip_len`` up to it."""
        scored = lengths.where(self._enough()).withColumn(
            "compressibility_score", score(F.col("text_len"), F.col("gzip_len"))
        )
        return self._finish(scored).select("flow_key", "ts_ms", "seq", *self.details)


@register
class FeatureCompressibilityDetector(CompressibilityDetector):
    """Works on packet times as they arrive; late ones add no code but move the reference time, negative ones are passed over."""

    name = "FeatureCompressibilityDetector"
    feature_based = True
    skips_negative_times = True

    def _order(self, order: str) -> str:
        return order

    def _enough(self) -> Column:
        return F.col("codes") >= self.min_iats

    def _counts(self) -> dict[str, Column]:
        """``packet_count`` stays 0 by definition; the true count is ``packets_in_window``."""
        return {"iat_count": F.col("codes"), "packet_count": F.lit(0).cast("bigint")}

    def score_running(
        self, packets: DataFrame, order: str = EVENT_TIME, policy: SlicePolicy = DEFAULT_POLICY
    ) -> DataFrame:
        return Detector.score_running(self, packets, order, policy)
