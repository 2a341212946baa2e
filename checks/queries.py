"""Queries over the ``events`` table, one per operator.

Each reads the whole table: events become packets (``flat_packets``) or topic
records with real header bytes (``topic_records``).
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.detectors import (
    CompressibilityDetector, FeatureCompressibilityDetector, InterArrivalCvDetector, PacketCountDetector,
    PortEntropyDetector,
)
from flowlens.functions.features import dest_port, project_features, typed_value
from flowlens.functions.gzip import LEVEL
from flowlens.functions.headers import HEADER_COLUMNS, with_headers
from flowlens.functions.iat import iat_code_ms, iat_seconds, valid_iat
from flowlens.functions.keys import KEYS, with_flow_key
from flowlens.operators.histogram import port_histogram, sketched_ports
from flowlens.operators.ingest import failure_runs, ingest_statistics, limit_packets
from flowlens.operators.ordering import SlicePolicy
from flowlens.operators.texts import text_pieces, whole_texts, with_codes
from flowlens.operators.windows import (
    ARRIVAL, EVENT_TIME, ORDERS, FlowWindow, accumulated, session_bounds, window_gaps, windowed_counts,
)
from flowlens.operators.windows import flow_changes as count_flow_changes
from flowlens.plans.job import JobSpec, enriched, keyed_features, run_batch
from flowlens.plans.python_windows import placed, score_python
from flowlens.runner import run_job
from flowlens.session import shared_dir
from flowlens.sinks.results import dead_letter_line, result_line
from flowlens.sources import filters, topic
from flowlens.sources.event_packets import flat_packets, load_events, raw_packets, topic_records
from flowlens.sources.results import parse_results
from flowlens.sources.wire import HEADER_BYTES, decodable, decode, encode
from flowlens.streaming.running import running_gaps, running_python
from flowlens.streaming.stateful import chained_python, compression_lengths, fired_windows
from flowlens.streaming.time_windows import closed_windows, mark_end, window_counts, window_histograms, with_end_marker, with_event_time

from .failing import CountingDetector, OddPortDetector

HOUR = 3_600_000
DAY = 24 * HOUR
WEEK = 7 * DAY

# events come hours apart, so a minute of traffic becomes a day here and 100 packets one
TUMBLING = FlowWindow("tumbling", size_ms=WEEK)
SLIDING = FlowWindow("sliding", size_ms=3 * DAY, slide_ms=DAY)
GAPPED = FlowWindow("sliding", size_ms=6 * HOUR, slide_ms=DAY)
SESSION = FlowWindow("session", size_ms=12 * HOUR)
COUNT = FlowWindow("tumbling_count", count=20)
SLIDING_COUNT = FlowWindow("sliding_count", count=10, slide_count=4)
FLUSHED = FlowWindow("tumbling_count", count=20, partial_flush=True)
STREAM_DELAY = "1 hour"
# fixed values here and below: configuration keys and names of result details
IAT_SETTINGS = {"iatThresholdMs": DAY, "precision": 2, "minIats": 5}

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def source_host() -> Column:
    """A key of the user's own: the sending host."""
    return F.coalesce(F.col("src_ip"), F.lit("none"))


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_packets(load_events(spark, sf_dir))


def by_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = with_flow_key(packets(spark, sf_dir), source_host())
    return project_features(keyed, dest_port().alias("dest_port"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topic_records(load_events(spark, sf_dir))


# ------------------------------------------------------------------ bytes


@query
def decode_wire(spark, sf_dir):
    return decode(records(spark, sf_dir)).select(
        "offset", "dlt", "ts_ms", F.hex("raw").alias("raw_hex"), F.length("raw").alias("raw_len")
    )


@query
def encode_wire(spark, sf_dir):
    sent = encode(raw_packets(load_events(spark, sf_dir)))
    return sent.select("event_id", F.col("src_ip").alias("key"), F.hex("value").alias("value_hex"))


@query
def parse_headers(spark, sf_dir):
    return topic.packets(records(spark, sf_dir)).select("offset", "ts_ms", *HEADER_COLUMNS)


def _key_query(name: str) -> Query:
    def run(spark, sf_dir):
        return with_flow_key(topic.packets(records(spark, sf_dir)), KEYS[name]()).select("offset", "flow_key")

    return run


for _name in ("default", "five_tuple", "guide"):
    QUERIES[f"key_{_name}"] = _key_query(_name)


@query
def key_legacy(spark, sf_dir):
    return with_flow_key(packets(spark, sf_dir), "legacy").select("event_id", "flow_key")


@query
def key_custom(spark, sf_dir):
    keyed = with_flow_key(topic.packets(records(spark, sf_dir)), source_host())
    return keyed.groupBy("flow_key").agg(F.count(F.lit(1)).alias("packets"))


@query
def feat_dest_port(spark, sf_dir):
    return topic.packets(records(spark, sf_dir)).select("offset", dest_port().alias("dest_port"))


@query
def feat_ttl_len(spark, sf_dir):
    return topic.packets(records(spark, sf_dir)).select("offset", "ttl", "total_len")


@query
def feat_timestamp_only(spark, sf_dir):
    return project_features(with_flow_key(packets(spark, sf_dir), "five_tuple"))


@query
def feat_typed_default(spark, sf_dir):
    features = F.parse_json("props")
    return load_events(spark, sf_dir).select(
        "event_id",
        typed_value(features, "k", "int", -1).alias("as_int"),
        typed_value(features, "k", "string", "none").alias("as_string"),
        typed_value(features, "missing", "double", 0.5).alias("missing_double"),
    )


# ---------------------------------------------------------------- windows


def _window_query(w: FlowWindow, order: str = EVENT_TIME) -> Query:
    def run(spark, sf_dir):
        counts = windowed_counts(by_host(spark, sf_dir), w, order=order)
        return counts.select(*w.group, "n", "first_ts", "last_ts")

    return run


WINDOW_QUERIES = {
    "win_tumbling": TUMBLING, "win_sliding": SLIDING, "win_sliding_gapped": GAPPED, "win_session": SESSION,
    "win_tumbling_count": COUNT, "win_sliding_count": SLIDING_COUNT, "win_partial_flush": FLUSHED,
}
for _name, _w in WINDOW_QUERIES.items():
    QUERIES[_name] = _window_query(_w)


@query
def win_partial_flush_sliding(spark, sf_dir):
    w = FlowWindow("sliding_count", count=10, slide_count=4, partial_flush=True)
    return _window_query(w)(spark, sf_dir)


@query
def win_none_running(spark, sf_dir):
    return PacketCountDetector({"threshold": 5}).score_running(by_host(spark, sf_dir))


@query
def win_metadata(spark, sf_dir):
    spec = JobSpec.from_config(
        {"algorithmClassName": "PacketCountDetector", "executionMode": "BATCH", "windowType": "tumbling_count",
         "windowCount": 20, "threshold": 1}
    )
    rows = enriched(run_batch(packets(spark, sf_dir), spec), spec)
    return rows.select(
        "flow_id", "details.window_type", "details.aggregation_mode", "details.packets_in_window"
    )


@query
def accumulate_windows(spark, sf_dir):
    counts = windowed_counts(by_host(spark, sf_dir), TUMBLING)
    return accumulated(counts, TUMBLING).select(*TUMBLING.group, "n", "n_so_far")


# -------------------------------------------------------- inter-arrival times


@query
def iat_sorted(spark, sf_dir):
    rows, window = window_gaps(by_host(spark, sf_dir), TUMBLING)
    seconds = iat_seconds(F.col("ts_ms") - F.col("prev_ts"))
    return rows.where(F.col("prev_ts").isNotNull()).select(*window, "seq", seconds.alias("iat"))


@query
def iat_arrival(spark, sf_dir):
    """Packets that arrive out of order: every seventh is an hour late."""
    late = by_host(spark, sf_dir).withColumn("ts_ms", F.col("ts_ms") - F.when(F.col("seq") % 7 == 0, HOUR).otherwise(0))
    rows, window = window_gaps(late, TUMBLING, ARRIVAL)
    return rows.where(F.col("prev_ts").isNotNull()).select(
        *window, "seq", (F.col("ts_ms") - F.col("prev_ts")).alias("delta_ms")
    )


@query
def iat_filter(spark, sf_dir):
    rows, window = window_gaps(by_host(spark, sf_dir), TUMBLING)
    delta = F.col("ts_ms") - F.col("prev_ts")
    return rows.where(valid_iat(delta, DAY)).groupBy(*window).agg(
        F.count(F.lit(1)).alias("valid"), F.max(delta).alias("longest_ms")
    )


@query
def iat_code(spark, sf_dir):
    delta = F.col("event_id") + 1
    return load_events(spark, sf_dir).select(
        "event_id", *[iat_code_ms(delta, p).alias(f"p{p}") for p in (1, 2, 3)]
    )


def _texts(spark, sf_dir, w: FlowWindow) -> DataFrame:
    rows, window = window_gaps(by_host(spark, sf_dir), w)
    texts = whole_texts(text_pieces(with_codes(rows, DAY, 2), window, ORDERS[EVENT_TIME]), window)
    if w.counted:
        texts = texts.where(w.closed(F.col("last_rn")))
    return session_bounds(texts, w).select(*w.group, "packets", "codes", "text", F.octet_length("text").alias("text_len"))


@query
def iat_concat(spark, sf_dir):
    return _texts(spark, sf_dir, TUMBLING)


@query
def iat_concat_session(spark, sf_dir):
    return _texts(spark, sf_dir, SESSION)


@query
def iat_concat_sliding_count(spark, sf_dir):
    return _texts(spark, sf_dir, SLIDING_COUNT)


@query
def flow_changes(spark, sf_dir):
    """Packets whose five-tuple differs from that of their window's first packet, keyed by host."""
    p = with_flow_key(packets(spark, sf_dir), "five_tuple").withColumnRenamed("flow_key", "tuple")
    rows = p.select(
        source_host().alias("flow_key"), "ts_ms", "seq", "tuple",
        (F.col("ts_ms") - F.pmod("ts_ms", F.lit(WEEK))).alias("window_start"),
    )
    return count_flow_changes(rows, ["flow_key", "window_start"], "tuple")


# --------------------------------------------------------------- detectors


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _packed(texts: pd.Series) -> pd.DataFrame:
    """Gzip size of each text, and the MD5 of what unpacks from it."""
    packed = [gzip.compress(t.encode(), LEVEL) for t in texts]
    return pd.DataFrame({"size": [len(b) for b in packed], "md5": [hashlib.md5(gzip.decompress(b)).hexdigest() for b in packed]})


@query
def gzip_score(spark, sf_dir):
    """Scores against whole texts that are packed, measured and unpacked again."""
    scored = CompressibilityDetector(IAT_SETTINGS).score(by_host(spark, sf_dir), TUMBLING)
    packed = F.pandas_udf(_packed, T.StructType().add("size", T.LongType()).add("md5", T.StringType()))
    texts = _texts(spark, sf_dir, TUMBLING).withColumn("packed", packed("text"))
    right = F.abs(F.col("compressibility_score") * F.col("packed.size") - F.col("text_len")) < 1e-6
    return scored.select(*TUMBLING.group, "compressibility_score").join(texts, TUMBLING.group).select(
        *TUMBLING.group, "codes", "text_len", F.col("packed.md5").alias("text_md5"), right.alias("score_is_right")
    )


def _with_right(scored: DataFrame, texts: DataFrame, keys: list[str], threshold: float = 0.7) -> DataFrame:
    """In place of score and anomaly: whether they are those of the whole ``text``, packed, and its digest; null without a text."""
    packed = F.pandas_udf(_packed, T.StructType().add("size", T.LongType()).add("md5", T.StringType()))
    whole = texts.select(*keys, F.octet_length("text").alias("_length"), packed("text").alias("_packed"), F.md5("text").alias("text_md5"))
    joined = scored.join(whole, keys, "left")
    exact = F.col("_length") / F.col("_packed.size")
    right = (F.abs(F.col("compressibility_score") - exact) < 1e-9) & (F.col("anomaly") == (exact > threshold))
    joined = joined.withColumn("score_is_right", F.when(F.col("_length").isNotNull(), F.coalesce(right, F.lit(False))))
    return joined.drop("compressibility_score", "anomaly", "_length", "_packed")


def _texts_of(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Code texts of windows, each packet after the other, without any of the library's steps between them."""
    listed = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, F.col("ts_ms").alias("t")))).alias("e"))
    before = lambda i: F.try_element_at(F.col("e"), F.greatest(i, F.lit(1)))  # noqa: E731 - places count from 1
    gap = lambda e, i: F.when(i > 0, e["t"] - before(i)["t"])
    gaps = F.transform("e", gap)
    kept = F.filter(gaps, lambda g: valid_iat(g, IAT_SETTINGS["iatThresholdMs"]))
    return listed.select(*keys, F.array_join(F.transform(kept, lambda g: iat_code_ms(g, IAT_SETTINGS["precision"])), "").alias("text"))


def _compress(spark, sf_dir, detector, w: FlowWindow, order: str = EVENT_TIME) -> DataFrame:
    packets_in = by_host(spark, sf_dir).select("flow_key", "ts_ms", "seq")
    rows = placed(packets_in, w, order, SlicePolicy(None))
    texts = _texts_of(rows, w.group, ["ts_ms", "seq"] if not detector.feature_based else list(ORDERS[order]))
    return _with_right(detector.score(packets_in, w, order), texts, w.group)


@query
def det_compress_buffered(spark, sf_dir):
    return _compress(spark, sf_dir, CompressibilityDetector(IAT_SETTINGS), SLIDING_COUNT)


@query
def det_compress_feature(spark, sf_dir):
    return _compress(spark, sf_dir, FeatureCompressibilityDetector(IAT_SETTINGS), SLIDING, ARRIVAL)


@query
def det_compress_sliding(spark, sf_dir):
    """Sliding windows in event-time order, which share the texts of their panes."""
    return _compress(spark, sf_dir, CompressibilityDetector(IAT_SETTINGS), SLIDING)


@query
def det_compress_blocks(spark, sf_dir):
    """Sliding count windows that share the texts of blocks of 20 packets."""
    return _compress(spark, sf_dir, CompressibilityDetector(IAT_SETTINGS), FlowWindow("sliding_count", count=40, slide_count=20))


@query
def det_compress_running(spark, sf_dir):
    return _running_score(spark, sf_dir, CompressibilityDetector(IAT_SETTINGS).score_running(by_host(spark, sf_dir)))


#: The operators of two queries alone, for timing: without packing every text again to check the scores.
UNCHECKED: dict[str, Query] = {
    "det_compress_buffered": lambda spark, sf_dir: CompressibilityDetector(IAT_SETTINGS).score(by_host(spark, sf_dir), SLIDING_COUNT),
    "det_compress_feature": lambda spark, sf_dir: FeatureCompressibilityDetector(IAT_SETTINGS).score(by_host(spark, sf_dir), SLIDING, ARRIVAL),
}


def _running_score(spark, sf_dir, scored: DataFrame) -> DataFrame:
    """Scores of a flow's packets 1, 2, 4, 8, ... are compared, so that a packet takes part in few texts."""
    flow = Window.partitionBy("flow_key").orderBy("ts_ms", "seq")
    rows = by_host(spark, sf_dir).select("flow_key", "ts_ms", "seq", F.row_number().over(flow).alias("rn"))
    sizes = rows.groupBy("flow_key").agg(F.max("rn").alias("n"))
    bits = lambda x: F.length(F.bin(x))
    first = F.when(F.col("rn") == 1, 0).otherwise(bits(F.col("rn") - 1))
    powers = F.filter(F.sequence(first, F.greatest(first, bits(F.col("n")) - 1)), lambda k: k < bits(F.col("n")))
    texts = _texts_of(rows.join(sizes, "flow_key").withColumn("k", F.explode(powers)), ["flow_key", "k"], ["ts_ms", "seq"])
    at = rows.where((F.col("rn").bitwiseAND(F.col("rn") - 1)) == 0).withColumn("k", bits(F.col("rn")) - 1)
    named = at.join(texts, ["flow_key", "k"]).select("flow_key", "ts_ms", "seq", "text")
    return _with_right(scored.select("flow_key", "ts_ms", "seq", "iat_count", "compressibility_score", "anomaly"), named, ["flow_key", "ts_ms", "seq"])


@query
def stream_compress_running(spark, sf_dir):
    """The same from a stream."""
    d = CompressibilityDetector(IAT_SETTINGS)
    scored = _streamed(spark, sf_dir, lambda p: d.score_lengths(compression_lengths(p, d.iat_threshold_ms, d.precision)))
    return _running_score(spark, sf_dir, scored)


QUERIES["port_histogram"] = lambda spark, sf_dir: port_histogram(
    with_flow_key(packets(spark, sf_dir)).withColumn("dest_port", dest_port()), TUMBLING
).select(*TUMBLING.group, "dest_port", "n")


QUERIES["ports_sketched"] = lambda spark, sf_dir: sketched_ports(by_host(spark, sf_dir), SLIDING)
QUERIES["ports_sketched_count"] = lambda spark, sf_dir: sketched_ports(by_host(spark, sf_dir), SLIDING_COUNT)


def _entropy_query(w: FlowWindow, minimum: int) -> Query:
    def run(spark, sf_dir):
        d = PortEntropyDetector({"minPackets": minimum, "entropyThreshold": 3.0})
        scored = d.score(by_host(spark, sf_dir), w)
        return _rounded(
            scored.select(*w.group, "packet_count", "skipped_count", "unique_ports", "entropy_score", "is_anomaly"),
            "entropy_score",
        )

    return run


QUERIES["det_port_entropy"] = _entropy_query(TUMBLING, 10)
QUERIES["det_port_entropy_sliding"] = _entropy_query(SLIDING, 5)
QUERIES["det_port_entropy_session"] = _entropy_query(SESSION, 3)
QUERIES["det_port_entropy_count"] = _entropy_query(SLIDING_COUNT, 4)


@query
def det_port_entropy_wire(spark, sf_dir):
    """The whole path: records, headers, default key, features, week windows, entropy."""
    d = PortEntropyDetector({"minPackets": 3, "entropyThreshold": 1.5})
    scored = d.score(keyed_features(topic.packets(records(spark, sf_dir)), d), TUMBLING)
    return _rounded(
        scored.select(*TUMBLING.group, "packet_count", "skipped_count", "unique_ports", "entropy_score", "is_anomaly"),
        "entropy_score",
    )


def _cv_query(w: FlowWindow, minimum: int) -> Query:
    def run(spark, sf_dir):
        d = InterArrivalCvDetector({"minPackets": minimum, "threshold": 0.9})
        return _rounded(d.score(by_host(spark, sf_dir), w).select(*w.group, *d.details), "cv")

    return run


QUERIES["det_iat_cv"] = _cv_query(TUMBLING, 10)
QUERIES["det_iat_cv_sliding"] = _cv_query(SLIDING, 4)
QUERIES["det_iat_cv_session"] = _cv_query(SESSION, 3)


@query
def det_iat_cv_running(spark, sf_dir):
    d = InterArrivalCvDetector({"minPackets": 10, "threshold": 0.9})
    return _rounded(d.score_running(by_host(spark, sf_dir)), "cv")


@query
def det_packet_count(spark, sf_dir):
    d = PacketCountDetector({"threshold": 10})
    return d.score(by_host(spark, sf_dir), SLIDING).select(*SLIDING.group, *d.details)


# ------------------------------------------------------- ingest and results


@query
def limit_packets_first(spark, sf_dir):
    return limit_packets(packets(spark, sf_dir), "partition", "seq", 500).select("partition", "seq", "ts_ms")


@query
def limit_packets_many(spark, sf_dir):
    """A limit applied without gathering its rows in one task."""
    kept = limit_packets(packets(spark, sf_dir), "partition", "seq", 4000)
    return kept.select("partition", "seq", "ts_ms")


@query
def bad_packet_runs(spark, sf_dir):
    """Runs of records shorter than 40 bytes after the record header (no whole IPv4/TCP packet)."""
    r = records(spark, sf_dir)
    ok = F.coalesce(F.length("value") >= 12 + 54, F.lit(False))
    return failure_runs(r, ok, ["partition"], "offset")


@query
def capture_filter(spark, sf_dir):
    wanted = filters.proto("tcp") & (filters.port(80) | filters.dst_host("10.1.0.3")) & ~filters.src_host("10.0.0.1")
    return filters.capture(topic.packets(records(spark, sf_dir)), wanted).select("offset", "src_ip", "dst_ip", "dst_port")


@query
def topic_profile(spark, sf_dir):
    return topic.profile(records(spark, sf_dir))


@query
def ingest_stats(spark, sf_dir):
    r = records(spark, sf_dir)
    packet = F.substring("value", HEADER_BYTES + 1, 1 << 30)  # the packet's own bytes count
    return ingest_statistics(r, decodable(F.col("value")), packet, ["partition"])


def _count_results(spark, sf_dir) -> DataFrame:
    d = PacketCountDetector({"threshold": 10})
    scored = d.score(by_host(spark, sf_dir), TUMBLING)
    return scored.select(
        F.lit(d.name).alias("algorithm"), F.col("flow_key").alias("flow_id"), F.col("window_end").alias("result_ts"),
        F.struct("packetCount", "anomaly", F.col("window_start").cast("string").alias("flink_window_start")).alias("details"),
    )


@query
def result_json(spark, sf_dir):
    return result_line(_count_results(spark, sf_dir))


@query
def result_scan(spark, sf_dir):
    found = parse_results(result_line(_count_results(spark, sf_dir)), "test", "node1")
    return found.groupBy("algorithmName", "source", "host", "pipeline").agg(
        F.count(F.lit(1)).alias("results"),
        F.sum(F.get_json_object("analysisDetails", "$.packetCount").cast("bigint")).alias("packets"),
    )


@query
def dlq_rows(spark, sf_dir):
    """A detector that fails on windows holding port 13: its failures, and only those."""
    scored = score_python(by_host(spark, sf_dir), OddPortDetector(), {}, TUMBLING, EVENT_TIME)
    failed = scored.where(F.col("error").isNotNull()).select("error", "flow_key", "window_start")
    return dead_letter_line(failed)


@query
def python_detector(spark, sf_dir):
    """Results of the same detector: windows without port 13 that have an odd port."""
    scored = score_python(by_host(spark, sf_dir), OddPortDetector(), {}, TUMBLING, EVENT_TIME)
    return scored.where(F.col("error").isNull()).select(*TUMBLING.group, "packets_in_window", "details.odd_ports")


# ---------------------------------------------------------------- streams


def _streamed(spark: SparkSession, sf_dir: str, build: Callable[[DataFrame], DataFrame], timed: bool = False) -> DataFrame:
    """Runs a query over the events as a stream until they are used up, and reads what it wrote.

    Time windows that are then still open are closed by an end marker and a second run.
    """
    schema = load_events(spark, sf_dir).schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    keyed = with_flow_key(flat_packets(events), source_host())
    packets_in = project_features(keyed, dest_port().alias("dest_port"))
    out = f"{shared_dir(spark).rstrip('/')}/flowlens-stream-{uuid.uuid4().hex}"
    scored = build(with_end_marker(packets_in, f"{out}/end") if timed else packets_in)

    def run() -> None:
        writer = scored.writeStream.format("parquet").option("path", f"{out}/rows")
        writer.option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()

    run()
    if timed:
        mark_end(spark, packets_in, f"{out}/end")
        run()
    return spark.read.schema(scored.schema).parquet(f"{out}/rows")


def _counts_of(windows: DataFrame, group: list[str]) -> DataFrame:
    times = F.transform("elements", lambda e: e["ts_ms"])
    return windows.select(
        *group, F.col("packets_in_window").alias("n"),
        F.array_min(times).alias("first_ts"), F.array_max(times).alias("last_ts"),
    )


@query
def stream_tumbling(spark, sf_dir):
    return _streamed(spark, sf_dir, lambda p: window_counts(with_event_time(p, STREAM_DELAY), TUMBLING), timed=True)


@query
def stream_session(spark, sf_dir):
    def build(p: DataFrame) -> DataFrame:
        counts = window_counts(with_event_time(p, STREAM_DELAY), SESSION, times=True)
        return counts.select(*SESSION.group, F.col("packets_in_window").alias("n"), "first_ts", "last_ts")

    return _streamed(spark, sf_dir, build, timed=True)


@query
def stream_sliding_count(spark, sf_dir):
    return _streamed(
        spark, sf_dir,
        lambda p: _counts_of(fired_windows(p, SLIDING_COUNT, ["seq", "ts_ms"]), SLIDING_COUNT.group),
    )


@query
def stream_running(spark, sf_dir):
    return _streamed(spark, sf_dir, lambda p: running_gaps(p).select("flow_key", "ts_ms", "seq", "rn", "gap_ms"))


@query
def python_accumulate(spark, sf_dir):
    scored = score_python(by_host(spark, sf_dir), CountingDetector(), {}, TUMBLING, EVENT_TIME)
    return scored.select("flow_key", "window_start", "packets_in_window", F.col("details.seen").alias("seen"))


@query
def stream_python_running(spark, sf_dir):
    def build(p: DataFrame) -> DataFrame:
        return running_python(p, CountingDetector(), {}).select("flow_key", "ts_ms", "seq", F.col("details.seen").alias("seen"))

    return _streamed(spark, sf_dir, build)


def _job(spark, sf_dir, mode: str) -> DataFrame:
    """Events to a topic, a job over it by its configuration, and its result file read back."""
    out = f"{shared_dir(spark).rstrip('/')}/flowlens-job-{uuid.uuid4().hex}"
    topic.write_topic(with_headers(raw_packets(load_events(spark, sf_dir)).drop("src_ip")), f"{out}/topics/flows", "flows")
    config = {
        "algorithmClassName": "PacketCountDetector", "executionMode": mode, "windowType": "tumbling_count", "windowCount": 10,
        "inputTopic": "flows", "threshold": 3,
    }
    run_job(spark, config, f"{out}/results", topics=f"{out}/topics")
    details = "struct<packetCount:bigint,anomaly:boolean,packets_in_window:string,window_type:string>"
    line = F.from_json("value", f"algorithmName string, flowId string, analysisDetails {details}")
    found = spark.read.text(f"{out}/results/PacketCountDetector").select(line.alias("r"))
    return found.select("r.algorithmName", "r.flowId", "r.analysisDetails.*")


@query
def job_batch(spark, sf_dir):
    return _job(spark, sf_dir, "BATCH")


@query
def job_replay(spark, sf_dir):
    return _job(spark, sf_dir, "REPLAY")


@query
def topic_round_trip(spark, sf_dir):
    out = f"{shared_dir(spark).rstrip('/')}/flowlens-topic-{uuid.uuid4().hex}"
    topic.write_topic(with_headers(raw_packets(load_events(spark, sf_dir)).drop("src_ip")), out, "flows")
    read = topic.packets(topic.read_topic(spark, out))
    homes = F.size(F.collect_set(F.when(F.col("src_ip").isNotNull(), F.col("partition")))).cast("bigint")
    return read.groupBy("src_ip").agg(
        F.count(F.lit(1)).alias("packets"), F.sum("ts_ms").alias("times"), homes.alias("partitions"),
        F.min(F.col("key").eqNullSafe(F.col("src_ip"))).alias("keyed"),
    )


@query
def stream_port_entropy(spark, sf_dir):
    columns = ["packet_count", "skipped_count", "unique_ports"]
    return _streamed(
        spark, sf_dir,
        lambda p: _rounded(
            window_histograms(with_event_time(p, STREAM_DELAY), SLIDING).select(*SLIDING.group, *columns, "entropy_score"),
            "entropy_score",
        ),
        timed=True,
    )


@query
def stream_compress(spark, sf_dir):
    def build(p: DataFrame) -> DataFrame:
        windows = closed_windows(with_event_time(p, STREAM_DELAY), TUMBLING, ["ts_ms", "seq"])
        return CompressibilityDetector(IAT_SETTINGS).score_elements(windows)

    rows = placed(by_host(spark, sf_dir).select("flow_key", "ts_ms", "seq"), TUMBLING, EVENT_TIME, SlicePolicy(None))
    return _with_right(_streamed(spark, sf_dir, build, timed=True), _texts_of(rows, TUMBLING.group, ["ts_ms", "seq"]), TUMBLING.group)


@query
def stream_python_accumulate(spark, sf_dir):
    """A detector whose state spans the windows of its flow, on a stream."""
    def build(p: DataFrame) -> DataFrame:
        windows = closed_windows(with_event_time(p, STREAM_DELAY), TUMBLING, ["ts_ms", "seq"])
        scored = chained_python(windows, CountingDetector(), {}, TUMBLING)
        return scored.select("flow_key", "window_start", "packets_in_window", F.col("details.seen").alias("seen"))

    return _streamed(spark, sf_dir, build, timed=True)
