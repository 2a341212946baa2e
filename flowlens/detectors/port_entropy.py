"""Spread of destination ports per host pair: high entropy points to port hopping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.features import dest_port
from ..operators.histogram import ENTROPY_DECIMALS, port_histogram, window_entropy
from ..operators.ordering import DEFAULT_POLICY, SlicePolicy
from ..operators.windows import EVENT_TIME, FlowWindow
from .base import Detector, register


@register
class PortEntropyDetector(Detector):
    name = "PortEntropyDetector"
    # fixed values: names of result details, which readers look for
    details = (
        "entropy_score", "unique_ports", "packet_count", "skipped_count", "entropy_threshold",
        "is_anomaly", "executionMode", "windowType", "testlauf",
    )

    def __init__(self, settings=None):
        super().__init__(settings)
        self.threshold = self.settings.number("entropyThreshold", 3.0)
        self.min_packets = self.settings.integer("minPackets", 10)

    def features(self) -> list[Column]:
        return [dest_port().alias("dest_port")]

    def _finish(self, scored: DataFrame) -> DataFrame:
        enough = (F.col("packet_count") >= self.min_packets) & (F.col("unique_ports") > 0)
        return scored.where(enough).withColumns(
            {
                "entropy_threshold": F.lit(self.threshold),
                "is_anomaly": (F.col("entropy_score") >= self.threshold).cast("double"),
                **self.echo(),
            }
        )

    def score(
        self, packets: DataFrame, w: FlowWindow, order: str = EVENT_TIME, policy: SlicePolicy = DEFAULT_POLICY
    ) -> DataFrame:
        scored = self._finish(window_entropy(port_histogram(packets, w, order, policy), w))
        return scored.select(*w.group, F.col("packet_count").alias("packets_in_window"), *self.details)

    def score_histogram(self, histogram: DataFrame, w: FlowWindow) -> DataFrame:
        """Scores a histogram that was counted elsewhere, such as on a stream."""
        return self._finish(window_entropy(histogram, w)).select(*w.group, *self.details)

    def score_elements(self, windows: DataFrame, order: str = EVENT_TIME) -> DataFrame:
        ports = F.filter(F.transform("elements", lambda e: e["dest_port"]), lambda p: p >= 0)
        distinct = F.array_distinct("_ports")
        # bin sizes without a quadratic scan: positions where the sorted ports change
        runs = F.transform(
            F.sequence(F.lit(0), F.size("_ports")),
            lambda i: F.when(
                (i == 0) | (i == F.size("_ports")) | (F.get(F.col("_ports"), i) != F.get(F.col("_ports"), i - 1)), i
            ),
        )
        sizes = F.transform(
            F.sequence(F.lit(1), F.size("_cuts") - 1),
            lambda i: (F.get(F.col("_cuts"), i) - F.get(F.col("_cuts"), i - 1)).cast("double"),
        )
        total = F.size("_ports").cast("double")
        weighted = F.aggregate("_sizes", F.lit(0.0), lambda acc, n: acc + n * F.log2(n))
        has_ports = F.size("_ports") > 0
        staged = windows.withColumn("_ports", F.array_sort(ports)).withColumn("_cuts", F.array_compact(runs))
        staged = staged.withColumn("_sizes", F.when(has_ports, sizes))
        scored = staged.withColumns(
            {
                "packet_count": F.size("elements").cast("bigint"),
                "skipped_count": (F.size("elements") - F.size("_ports")).cast("bigint"),
                "unique_ports": F.size(distinct).cast("bigint"),
                "entropy_score": F.when(
                    has_ports, F.round(F.log2(total) - weighted / total, ENTROPY_DECIMALS)
                ),
            }
        )
        return self._finish(scored).drop("elements", "_ports", "_cuts", "_sizes")
