"""Detectors, job configuration, result files and dead letters."""

import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from checks.failing import OddPortDetector
from checks.queries import DAY, packets
from flowlens.detectors import (
    CompressibilityDetector, FeatureCompressibilityDetector, InterArrivalCvDetector, PacketCountDetector,
    PortEntropyDetector, PythonDetector, Settings, create, register, registered,
)
from flowlens.functions.gzip import gzip_size
from flowlens.operators import texts
from flowlens.operators.ordering import SlicePolicy
from flowlens.operators.windows import ARRIVAL, EVENT_TIME, FlowWindow
from flowlens.plans.job import JobSpec, dead_letters, enriched, parallel, run_batch
from flowlens.plans.python_windows import score_python, score_python_elements
from flowlens.runner import run_job
from flowlens.sinks.results import result_line, write_job, write_lines
from flowlens.sources.results import read_results

register(OddPortDetector)
ALL = FlowWindow("tumbling", size_ms=1_000_000)
HOT = SlicePolicy(hot_rows=10, slice_rows=4)


def flow(spark, times, ports=None, name="f"):
    ports = ports or [80] * len(times)
    rows = [(name, t, i, p) for i, (t, p) in enumerate(zip(times, ports))]
    return spark.createDataFrame(rows, "flow_key string, ts_ms bigint, seq bigint, dest_port int")


def code(ms, precision=2):
    """The code rule in plain Python."""
    x, zeros = ms / 1000.0, 0
    while x < 0.1:
        x, zeros = x * 10.0, zeros + 1
    digits = int(x * 10**precision + 0.5)
    if digits >= 10**precision:
        digits, zeros = digits // 10, zeros - 1
    return ("" if zeros <= 0 else "XAB"[zeros - 1]) + str(digits)


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


@pytest.mark.parametrize("policy", [SlicePolicy(), HOT])
def test_compressibility(spark, policy, monkeypatch):
    monkeypatch.setattr(texts, "PIECE_ROWS", 7)
    rng = random.Random(5)
    times = [rng.randrange(0, 60_000) for _ in range(80)]
    for detector, order, series in (
        (CompressibilityDetector({}), EVENT_TIME, sorted(times)),
        (CompressibilityDetector({}), ARRIVAL, sorted(times)),
        (FeatureCompressibilityDetector({"minIats": 1}), ARRIVAL, times),
    ):
        gaps = [b - a for a, b in zip(series, series[1:])]
        usable = [g for g in gaps if 0 < g <= 1000]
        text = "".join(code(g) for g in usable)
        row = one(detector.score(flow(spark, times), ALL, order, policy))
        assert row.compressibility_score == pytest.approx(len(text) / gzip_size(text))
        assert row.anomaly == (row.compressibility_score > 0.7)
        assert row.packets_in_window == 80
        feature = detector.feature_based
        assert (row.iat_count, row.packet_count) == ((len(usable), 0) if feature else (80, 80))


def test_compressibility_needs_enough(spark):
    assert CompressibilityDetector({}).score(flow(spark, [0, 1, 2, 3, 4]), ALL).count() == 0
    assert CompressibilityDetector({}).score(flow(spark, [0, 1, 2, 3, 4, 5]), ALL).count() == 1
    assert CompressibilityDetector({"minIats": 0}).score(flow(spark, [7]), ALL).count() == 0
    assert FeatureCompressibilityDetector({"minIats": 0}).score(flow(spark, [7]), ALL).count() == 1


def test_running_compressibility(spark):
    times = [0, 100, 250, 300, 2000, 2050, 2075, 3000]
    rows = CompressibilityDetector({"minIats": 2}).score_running(flow(spark, times)).orderBy("seq").collect()
    for r in rows:
        gaps = [b - a for a, b in zip(times[: r.seq + 1], times[1 : r.seq + 1])]
        text = "".join(code(g) for g in gaps if 0 < g <= 1000)
        assert r.compressibility_score == pytest.approx(len(text) / gzip_size(text))
    assert [r.seq for r in rows] == [2, 3, 4, 5, 6, 7]
    assert FeatureCompressibilityDetector({}).score_running(flow(spark, times)).count() == 0


@pytest.mark.parametrize(
    "ports,score,anomaly",
    [([80] * 12, 0.0, 0.0), (list(range(8)) * 3, 3.0, 1.0), (list(range(5)) * 4, 2.321928, 0.0), ([1, 1, 2, -1] * 3, 0.918296, 0.0)],
)
def test_port_entropy(spark, ports, score, anomaly):
    detector = PortEntropyDetector({})
    df = flow(spark, list(range(len(ports))), ports)
    row = one(detector.score(df, ALL))
    assert row.entropy_score == pytest.approx(score, abs=1e-6) and row.is_anomaly == anomaly
    assert row.unique_ports == len(set(ports) - {-1}) and row.skipped_count == ports.count(-1)
    elements = df.groupBy("flow_key").agg(F.collect_list(F.struct("ts_ms", "seq", "dest_port")).alias("elements"))
    again = one(detector.score_elements(elements))
    assert {c: again[c] for c in detector.details} == {c: row[c] for c in detector.details}


def test_port_entropy_without_result(spark):
    assert PortEntropyDetector({}).score(flow(spark, list(range(9))), ALL).count() == 0
    assert PortEntropyDetector({}).score(flow(spark, list(range(20)), [-1] * 20), ALL).count() == 0


@pytest.mark.parametrize("times,cv", [([0, 10, 20, 30], 0.0), ([0, 10, 30], 1 / 3), ([5], 0.0), ([5, 5], 0.0)])
def test_variation(spark, times, cv):
    detector = InterArrivalCvDetector({"minPackets": 1, "threshold": 0.3})
    df = flow(spark, times)
    row = one(detector.score(df, ALL))
    assert row.cv == pytest.approx(cv) and row.detected == (cv > 0.3) and row.packetCount == len(times)
    assert detector.score_running(df).orderBy(F.desc("seq")).first().cv == pytest.approx(cv)
    elements = df.groupBy("flow_key").agg(F.collect_list(F.struct("ts_ms", "seq")).alias("elements"))
    assert one(detector.score_elements(elements)).cv == pytest.approx(cv)


def test_packet_count(spark):
    row = one(PacketCountDetector({"threshold": 2}).score(flow(spark, [1, 2, 3]), ALL))
    assert (row.packetCount, row.anomaly) == (3, True)
    assert not one(PacketCountDetector({"threshold": "3.0"}).score(flow(spark, [1, 2, 3]), ALL)).anomaly


def test_settings_and_registry():
    s = Settings({"n": "7", "x": 2, "flag": "TRUE", "t": 5})
    assert (s.integer("n", 1), s.number("x", 0.0), s.flag("flag", False), s.text("t", "")) == (7, 2.0, True, "5")
    assert (s.integer("m", 1), s.flag("m", True), s.text("m", "d"), s.get("m")) == (1, True, "d", None)
    assert isinstance(create("a.b.PortEntropyDetector", s), PortEntropyDetector)
    assert "CompressibilityDetector" in registered()
    with pytest.raises(ValueError, match="no detector"):
        create("Missing")


def test_job_spec():
    spec = JobSpec.from_json(
        '{"algorithmClassName": "PortEntropyDetector", "executionMode": "replay", "windowType": "Tumbling_Count",'
        ' "windowCount": 2000, "inputTopic": "t", "parallelism": 4, "partialFlush": true}'
    )
    assert (spec.mode, spec.order, spec.window.count, spec.parallelism) == ("REPLAY", ARRIVAL, 2000, 4)
    assert not spec.window.partial_flush  # batch runs only
    batch = JobSpec.from_config({**spec.config, "executionMode": "BATCH"})
    assert batch.window.partial_flush and batch.order == EVENT_TIME
    default = JobSpec.from_config({"algorithmClassName": "X", "executionMode": "whatever"})
    assert (default.mode, default.window) == ("STREAMING", FlowWindow("tumbling", size_ms=5000))
    with pytest.raises(ValueError):
        JobSpec.from_config({"windowType": "none"})


def config(detector, window="tumbling", **more):
    return {
        "algorithmClassName": detector, "executionMode": "BATCH", "windowType": window,
        "windowSizeMs": 9 * DAY, "windowCount": 3, **more,
    }


def test_result_files(spark, data, tmp_path):
    spec = JobSpec.from_config(config("PacketCountDetector", threshold=3))
    scored = run_batch(packets(spark, data), spec)
    write_job(scored, spec, str(tmp_path), single_file=True)
    files = list((tmp_path / "PacketCountDetector").glob("part-*"))
    lines = [json.loads(x) for f in files for x in f.read_text().splitlines()]
    assert len(files) == 1 and len(lines) == scored.count()
    first = lines[0]
    assert list(first) == ["algorithmName", "flowId", "timestamp", "analysisDetails"]
    details = first["analysisDetails"]
    assert details["packets_in_window"] == str(details["packetCount"]) and details["aggregation_mode"] == "buffered"
    assert "window_type" not in details and int(details["flink_window_end"]) - int(details["flink_window_start"]) == 9 * DAY
    back = read_results(spark, str(tmp_path), "lab", "node7")
    row = back.first()
    assert (row.source, row.host, row.pipeline) == ("lab", "node7", "covert-detection") and "part-" in row.file
    assert back.count() == len(lines)
    with pytest.raises(ValueError, match="output path"):
        write_lines(back.select("file"), None, "x")


@pytest.mark.parametrize(
    "window,detector,expected",
    [
        ("tumbling_count", "PortEntropyDetector", {"window_type": "count_based", "aggregation_mode": "incremental"}),
        ("tumbling", "PortEntropyDetector", {"window_type": "time_based", "aggregation_mode": "incremental"}),
        ("session", "CompressibilityDetector", {"aggregation_mode": "buffered"}),
        ("none", "PacketCountDetector", {}),
    ],
)
def test_window_metadata(spark, data, window, detector, expected):
    spec = JobSpec.from_config(config(detector, window, minPackets=1, minIats=1, iatThresholdMs=20 * DAY))
    line = result_line(enriched(run_batch(packets(spark, data), spec, HOT), spec)).first()[0]
    details = json.loads(line)["analysisDetails"]
    assert {k: details.get(k) for k in ("window_type", "aggregation_mode") if k in details} == expected
    assert ("flink_window_start" in details) == (window in ("tumbling", "session"))
    assert ("packets_in_window" in details) == (window != "none")


def test_staged_features_give_the_same(spark, data):
    spec = JobSpec.from_config(config("InterArrivalCvDetector", minPackets=2))
    a, b = (run_batch(packets(spark, data), spec, HOT, stage=s) for s in (False, True))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect())) and a.count() > 50


class LastGap(PythonDetector):
    name = "LastGap"
    schema = "gap: bigint"

    def initialize(self, settings):
        self.least = settings.integer("least", 0)
        self.times = []

    def process(self, packets: pd.DataFrame):
        self.times = (self.times + packets["ts_ms"].tolist())[-2:]

    def detect(self):
        if len(self.times) < 2 or self.times[1] - self.times[0] < self.least:
            return None
        return {"gap": self.times[1] - self.times[0]}

    def reset(self):
        self.times = []


@pytest.mark.parametrize("w", [FlowWindow("tumbling_count", count=3), FlowWindow("tumbling_count", count=3, partial_flush=True)])
def test_python_detector_count_windows(spark, w):
    df = flow(spark, [0, 5, 9, 20, 21, 29, 30, 34]).drop("dest_port")
    got = score_python(df, LastGap(), {"least": 2}, w, EVENT_TIME, HOT).orderBy("window_no").collect()
    expected = [(1, 3, 4), (2, 3, 8)] + ([(3, 2, 4)] if w.partial_flush else [])
    assert [(r.window_no, r.packets_in_window, r.details.gap) for r in got] == expected


def test_python_detector_per_packet(spark):
    df = flow(spark, [0, 5, 9]).union(flow(spark, [1, 2], name="g")).drop("dest_port")
    got = score_python(df, LastGap(), {}, FlowWindow("none"), EVENT_TIME).collect()
    assert sorted((r.flow_key, r.ts_ms, r.details.gap) for r in got) == [("f", 5, 5), ("f", 9, 4), ("g", 2, 1)]


def test_dead_letters(spark, tmp_path):
    df = flow(spark, [0, 1, 2], [13, 5, 7], "bad").union(flow(spark, [0, 1], [5, 8], "good")).union(flow(spark, [3], [8], "none"))
    for w, place in ((ALL, ["window_start"]), (FlowWindow("tumbling_count", count=1, partial_flush=True), ["window_type"])):
        scored = score_python(df, OddPortDetector(), {}, w, EVENT_TIME)
        letters = dead_letters(scored, w).collect()
        assert [(r.error, r.flow_key) for r in letters] == [('port "13" seen', "bad")]
        assert dead_letters(scored, w).columns[2:] == place
    scored = score_python(df, OddPortDetector(), {}, ALL, EVENT_TIME)
    results = scored.where("error is null").collect()
    assert [(r.flow_key, r.details.odd_ports, r.packets_in_window) for r in results] == [("good", 1, 2)]
    elements = df.groupBy("flow_key").agg(F.collect_list(F.struct("ts_ms", "seq", "dest_port")).alias("elements")).selectExpr(
        "flow_key", "0L as window_start", "1000000L as window_end", "cast(size(elements) as bigint) as packets_in_window", "elements"
    )
    again = score_python_elements(elements, OddPortDetector(), {}, ALL)
    assert sorted(map(str, again.collect())) == sorted(map(str, scored.collect()))


def test_write_job_with_dead_letters(spark, data, tmp_path):
    spec = JobSpec.from_config(config("OddPortDetector"))
    scored = run_batch(packets(spark, data), spec)
    write_job(scored, spec, str(tmp_path / "out"), str(tmp_path / "dlq"))
    dead = spark.read.json(str(tmp_path / "dlq" / "OddPortDetector"))
    assert {r.error for r in dead.collect()} == {'port "13" seen'}
    good = spark.read.json(str(tmp_path / "out" / "OddPortDetector"))
    assert good.select("analysisDetails.odd_ports").where("odd_ports > 0").count() == good.count() > 0


class Seen(PythonDetector):
    """Never reset; keyed by a column that no worker can be sent."""

    name, schema = "Seen", "seen: bigint"

    def __init__(self):
        self.seen = 0

    def process(self, packets):
        self.seen += len(packets)

    def detect(self):
        return {"seen": self.seen}


def test_state_stays_within_a_flow(spark):
    Seen.key = F.col("flow_key")
    df = flow(spark, [0, 5, 11, 12, 25], name="a").union(flow(spark, [1, 2], name="b")).drop("dest_port").coalesce(1)
    got = score_python(df, Seen(), {}, FlowWindow("tumbling", size_ms=10), EVENT_TIME).collect()
    assert sorted((r.flow_key, r.window_start, r.details.seen) for r in got) == [("a", 0, 2), ("a", 10, 4), ("a", 20, 5), ("b", 0, 2)]
    each = score_python(df, Seen(), {}, FlowWindow("none"), EVENT_TIME).collect()
    assert sorted((r.flow_key, r.details.seen) for r in each) == [("a", n) for n in range(1, 6)] + [("b", 1), ("b", 2)]
    assert Seen.key is not None


def test_parallelism_is_set_back(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spec = JobSpec.from_config({"algorithmClassName": "PacketCountDetector", "parallelism": 7})
    with parallel(spark, spec):
        assert spark.conf.get("spark.sql.shuffle.partitions") == "7"
    assert spark.conf.get("spark.sql.shuffle.partitions") == before


def test_runner_refuses_what_is_missing(spark, tmp_path):
    for broken in ({"algorithmClassName": "PacketCountDetector"}, {"algorithmClassName": "PacketCountDetector", "inputTopic": "t"}):
        with pytest.raises(ValueError):
            run_job(spark, broken, str(tmp_path))
