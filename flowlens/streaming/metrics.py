"""Progress of running streams: rows in and out, watermark, late drops."""

from __future__ import annotations

from pyspark.sql.streaming import StreamingQueryListener


class StreamMetrics(StreamingQueryListener):
    """Totals per query name; register with ``spark.streams.addListener``."""

    def __init__(self):
        self.totals: dict[str, dict[str, object]] = {}

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        p = event.progress
        t = self.totals.setdefault(p.name or str(p.id), {"rows_in": 0, "rows_out": 0, "late_dropped": 0, "watermark": None})
        t["rows_in"] += p.numInputRows
        t["rows_out"] += max(p.sink.numOutputRows, 0)
        t["late_dropped"] += sum(s.numRowsDroppedByWatermark for s in p.stateOperators)
        t["watermark"] = p.eventTime.get("watermark", t["watermark"]) if p.eventTime else t["watermark"]

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass
