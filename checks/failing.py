"""User-written detectors for tests: one counts odd ports and fails on port 13, one counts all it has seen of a flow."""

from __future__ import annotations

from flowlens.detectors import PythonDetector
from flowlens.functions.features import dest_port


class OddPortDetector(PythonDetector):
    name = "OddPortDetector"
    schema = "odd_ports: bigint"

    def __init__(self):
        self.odd = 0

    def features(self):
        return [dest_port().alias("dest_port")]

    def process(self, packets):
        if (packets["dest_port"] == 13).any():
            raise ValueError('port "13" seen')
        self.odd += int(((packets["dest_port"] >= 0) & (packets["dest_port"] % 2 == 1)).sum())

    def detect(self):
        return {"odd_ports": self.odd} if self.odd else None

    def reset(self):
        self.odd = 0


class CountingDetector(PythonDetector):
    """Never reset, so it counts across the windows of its flow."""

    name = "CountingDetector"
    schema = "seen: bigint"

    def __init__(self):
        self.seen = 0

    def process(self, packets):
        self.seen += len(packets)

    def detect(self):
        return {"seen": self.seen}
