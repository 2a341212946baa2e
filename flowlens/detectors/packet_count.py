"""Packets per window against a threshold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import DEFAULT_POLICY, SlicePolicy, with_row_number
from ..operators.windows import EVENT_TIME, ORDERS, FlowWindow, windowed_counts
from .base import Detector, register


@register
class PacketCountDetector(Detector):
    name = "PacketCountDetector"
    feature_based = False
    details = ("packetCount", "anomaly")

    def __init__(self, settings=None):
        super().__init__(settings)
        self.threshold = self.settings.number("threshold", 1.0)

    def _details(self, n: Column) -> dict[str, Column]:
        return {"packetCount": n, "anomaly": n > self.threshold}

    def score(
        self, packets: DataFrame, w: FlowWindow, order: str = EVENT_TIME, policy: SlicePolicy = DEFAULT_POLICY
    ) -> DataFrame:
        counts = windowed_counts(packets, w, order=order, policy=policy)
        return counts.select(*w.group, F.col("n").alias("packets_in_window")).withColumns(
            self._details(F.col("packets_in_window"))
        )

    def score_elements(self, windows: DataFrame, order: str = EVENT_TIME) -> DataFrame:
        return windows.withColumns(self._details(F.size("elements").cast("bigint"))).drop("elements")

    def score_running(
        self, packets: DataFrame, order: str = EVENT_TIME, policy: SlicePolicy = DEFAULT_POLICY
    ) -> DataFrame:
        rows = with_row_number(packets.select("flow_key", "ts_ms", "seq"), ["flow_key"], ORDERS[order], policy)
        return rows.select("flow_key", "ts_ms", "seq", "rn").withColumns(self._details(F.col("rn"))).drop("rn")
