"""Time and session windows of a stream, closed by the watermark.

Late packets are dropped once their window is closed; append mode emits every
window once. The watermark is the highest event time seen in the whole stream
minus the delay, so with several topic partitions the delay has to cover their
skew, unless each partition has a watermark of its own: the lowest then
counts, and a partition that lags or rests holds windows open. A stream that ends leaves its last windows open: read bounded
input as a batch instead (BATCH and REPLAY do).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.histogram import ENTROPY_DECIMALS
from ..operators.windows import SESSION, SLIDING, FlowWindow

SINGLE_PARTITION_DELAY = "10 milliseconds"  # fixed value: out-of-orderness within one partition


PARTITION = "topic_partition"
END_MS = 253_370_764_800_000  # the year 9999: later than any packet


def with_end_marker(packets: DataFrame, folder: str) -> DataFrame:
    """The stream, and what ``mark_end`` will put into ``folder``."""
    spark = packets.sparkSession
    spark.createDataFrame([], packets.schema).write.mode("overwrite").parquet(folder)
    return packets.unionByName(spark.readStream.schema(packets.schema).parquet(folder))


def mark_end(spark: SparkSession, packets: DataFrame, folder: str) -> None:
    """Ends a bounded stream: a packet beyond all others moves the watermark past every open window.

    Its own window stays open, so it is never seen. Call it when the query has used up
    its input, and run the query once more.
    """
    values = {"flow_key": F.lit(""), "ts_ms": F.lit(END_MS), "seq": F.lit(END_MS)}
    row = spark.range(1).select(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in packets.schema])
    row.write.mode("append").parquet(folder)


def with_event_time(packets: DataFrame, delay: str, partitions: Sequence[int] | None = None) -> DataFrame:
    """Adds ``ts`` with a watermark; it keeps that role through later projections.

    With ``partitions``, all numbers that occur in the column ``topic_partition``,
    each partition is a stream with its own watermark; the source is read once for
    each. A packet of any other partition, or of none, fails the query: it would be in
    no stream. Spark combines watermarks by ``spark.sql.streaming.multipleWatermarkPolicy``,
    which has to be ``min``, as it is by default.
    """
    timed = packets.withColumn("ts", F.timestamp_millis("ts_ms"))
    if not partitions:
        return timed.withWatermark("ts", delay)
    if packets.sparkSession.conf.get("spark.sql.streaming.multipleWatermarkPolicy") != "min":
        raise ValueError("watermarks per partition need spark.sql.streaming.multipleWatermarkPolicy=min")
    name = F.coalesce(F.col(PARTITION).cast("string"), F.lit("null"))
    unknown = F.raise_error(F.concat(F.lit("a packet of a topic partition that is not listed: "), name)).cast("boolean")
    listed = F.coalesce(F.col(PARTITION).isin(*partitions), F.lit(False))
    first, *others = partitions  # the first stream looks at all packets
    parts = [timed.where(F.when(listed, F.col(PARTITION) == first).otherwise(unknown)).withWatermark("ts", delay)]
    parts += [timed.where(F.col(PARTITION) == p).withWatermark("ts", delay) for p in others]
    return reduce(DataFrame.unionByName, parts)


def _cut(df: DataFrame, w: FlowWindow) -> tuple[DataFrame, Column]:
    if w.kind == SESSION:
        return df, F.session_window("ts", f"{w.size_ms} milliseconds").alias("window")
    if w.kind == SLIDING and w.slide_ms > w.size_ms:
        hits = df.where(F.pmod(F.col("ts_ms"), F.lit(w.slide_ms)) < w.size_ms)
        return hits, F.window("ts", f"{w.slide_ms} milliseconds").alias("window")
    slide = w.slide_ms if w.kind == SLIDING else w.size_ms
    return df, F.window("ts", f"{w.size_ms} milliseconds", f"{slide} milliseconds").alias("window")


def _bounds(df: DataFrame, w: FlowWindow) -> DataFrame:
    start, end = F.unix_millis("window.start"), F.unix_millis("window.end")
    if w.kind == SLIDING and w.slide_ms > w.size_ms:
        end = start + F.lit(w.size_ms)
    return df.withColumns({"window_start": start, "window_end": end}).drop("window")


def closed_windows(packets: DataFrame, w: FlowWindow, columns: list[str]) -> DataFrame:
    """Closed windows with ``packets_in_window`` and ``elements``, their packets as an array.

    ``packets`` has a watermark on ``ts``. The state of a window is its elements,
    so only the columns a detector reads should be named.
    """
    df, window = _cut(packets, w)
    grouped = df.groupBy("flow_key", window).agg(F.collect_list(F.struct(*columns)).alias("elements"))
    out = _bounds(grouped, w).withColumn("packets_in_window", F.size("elements").cast("bigint"))
    return out.select(*w.group, "packets_in_window", "elements")


def window_counts(packets: DataFrame, w: FlowWindow, times: bool = False) -> DataFrame:
    """Closed windows with just their packet count: constant state per window. ``times`` adds ``first_ts, last_ts``."""
    df, window = _cut(packets, w)
    ends = [F.min("ts_ms").alias("first_ts"), F.max("ts_ms").alias("last_ts")] if times else []
    return _bounds(df.groupBy("flow_key", window).agg(F.count(F.lit(1)).alias("packets_in_window"), *ends), w)


def window_histograms(packets: DataFrame, w: FlowWindow) -> DataFrame:
    """Closed windows (not sessions) with their port statistics by two chained aggregations.

    State is one counter per window and port, not one element per packet.
    """
    if w.kind == SESSION:
        raise ValueError("a session is not the union of its per-port sessions; use closed_windows")
    df, window = _cut(packets, w)
    bins = df.groupBy("flow_key", window, "dest_port").agg(F.count(F.lit(1)).alias("n"))
    with_port = F.col("dest_port") >= 0
    size = F.when(with_port, F.col("n"))
    total = F.sum(size).cast("double")
    entropy = F.log2(total) - F.sum(size * F.log2(size.cast("double"))) / total
    merged = bins.groupBy("flow_key", "window").agg(
        F.sum("n").alias("packet_count"),
        F.coalesce(F.sum(F.when(~with_port, F.col("n"))), F.lit(0)).alias("skipped_count"),
        F.count(size).alias("unique_ports"),
        F.round(entropy, ENTROPY_DECIMALS).alias("entropy_score"),
    )
    return _bounds(merged, w).withColumn("packets_in_window", F.col("packet_count"))
