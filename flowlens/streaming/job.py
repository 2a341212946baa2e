"""Streaming run of a job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..detectors import (
    Detector, InterArrivalCvDetector, PacketCountDetector, PortEntropyDetector, PythonDetector,
)
from ..detectors.interarrival import variation
from ..operators.windows import ARRIVAL, NONE, SESSION
from ..plans.job import JobSpec, enriched, keyed_features
from ..sinks.results import result_line, stream_job, stream_lines
from ..sources.wire import partition_of
from .running import running_gaps, running_python
from .stateful import chained_python, compression_lengths, fired_windows
from .time_windows import closed_windows, window_counts, window_histograms, with_event_time
from .time_windows import PARTITION


def score_stream(packets: DataFrame, spec: JobSpec, delay: str | None = None, partitions: Sequence[int] | None = None) -> DataFrame:
    """Scored windows of a streaming job, with the columns of a batch run.

    Time windows need ``delay``, how far behind the newest packet a packet may come:
    of its own topic partition if ``partitions`` names them all, else of the whole topic.
    """
    if delay is None and spec.window.columns and not spec.window.counted:
        raise ValueError("time windows of a stream need a delay; see SINGLE_PARTITION_DELAY for topics of one partition")
    detector, w = spec.detector(), spec.window
    features = keyed_features(packets, detector)
    if partitions:
        features = features.withColumn(PARTITION, partition_of(F.col("seq")))
    columns = [c for c in features.columns if c not in ("flow_key", PARTITION)]
    if w.kind == NONE:
        return _per_packet(features, spec, detector)
    if w.counted:
        windows = fired_windows(features, w, columns)
    else:
        timed = with_event_time(features, delay, partitions)
        if isinstance(detector, PacketCountDetector):
            return window_counts(timed, w).withColumns(
                {"packetCount": F.col("packets_in_window"), "anomaly": F.col("packets_in_window") > detector.threshold}
            )
        if isinstance(detector, PortEntropyDetector) and w.kind != SESSION:
            return detector._finish(window_histograms(timed, w))
        windows = closed_windows(timed, w, columns)
    if isinstance(detector, PythonDetector):
        return chained_python(windows, detector, spec.config, w)
    return detector.score_elements(windows, ARRIVAL)


def _per_packet(features: DataFrame, spec: JobSpec, detector: Detector | PythonDetector) -> DataFrame:
    if isinstance(detector, PacketCountDetector):
        rows = running_gaps(features)
        return rows.select(
            "flow_key", "ts_ms", "seq", F.col("rn").alias("packetCount"), (F.col("rn") > detector.threshold).alias("anomaly")
        )
    if isinstance(detector, InterArrivalCvDetector):
        rows = running_gaps(features).where(F.col("rn") >= detector.min_packets)
        mean = F.when(F.col("rn") > 1, F.col("gap_sum") / (F.col("rn") - 1))
        spread = F.greatest(F.col("gap_squares") / (F.col("rn") - 1) - mean * mean, F.lit(0.0))
        cv = variation(F.when(F.col("rn") > 1, F.sqrt(spread)), mean)
        return rows.select(
            "flow_key", "ts_ms", "seq", cv.alias("cv"), F.col("rn").alias("packetCount"),
            (cv > detector.threshold).alias("detected"),
        )
    if isinstance(detector, PythonDetector):
        return running_python(features, detector, spec.config)
    if detector.feature_based:
        return detector.score_running(features)  # never fed single packets: an empty stream
    return detector.score_lengths(compression_lengths(features, detector.iat_threshold_ms, detector.precision))


def start(
    packets: DataFrame, spec: JobSpec, output: str, checkpoint: str, dead_letter_path: str | None = None,
    delay: str | None = None, interval: str = "30 seconds", partitions: Sequence[int] | None = None,
) -> StreamingQuery:
    """Starts the job: results to ``output/<detector>``, failures to ``dead_letter_path/<detector>``.

    Results of built-in detectors go through the file sink, which commits files
    with the checkpoint. A user-written detector has results and failures; their files are
    written in one pass, bear the micro-batch's number, and a batch that runs again replaces them.
    """
    detector = spec.detector()
    scored = score_stream(packets, spec, delay, partitions)
    if not isinstance(detector, PythonDetector):
        lines = result_line(enriched(scored, spec, detector))
        return stream_lines(lines, output, detector.name, checkpoint, interval).start()
    return stream_job(scored, spec, output, dead_letter_path, checkpoint, interval).start()
