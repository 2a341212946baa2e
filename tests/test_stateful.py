"""Keyed state on streams: several micro-batches against plain Python over all packets."""

import random
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from checks.failing import CountingDetector
from flowlens.detectors import CompressibilityDetector, PythonDetector
from flowlens.detectors.base import Settings
from flowlens.functions.gzip import gzip_size
from flowlens.functions.iat import code_of
from flowlens.operators.windows import ARRIVAL, FlowWindow
from flowlens.plans.python_windows import packet_results, score_python
from flowlens.streaming import stateful
from flowlens.streaming.stateful import chained_python, compression_lengths, fired_windows
from flowlens.streaming.time_windows import PARTITION, window_counts, with_event_time

SCHEMA = "flow_key string, ts_ms bigint, seq bigint"


def streamed(spark, tmp_path, batches, build, name, schema=SCHEMA):
    """``batches`` one after the other as micro-batches."""
    folder = str(tmp_path / "in")
    for rows in batches:
        df = rows if hasattr(rows, "write") else spark.createDataFrame(rows, schema)
        df.coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    q = build(stream).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).collect()


def some_batches(seed=1, n=400, parts=4, late=0.0):
    r = random.Random(seed)
    rows, last = [], {}
    for i in range(n):
        flow = r.choice("aabc")
        last[flow] = last.get(flow, 0) + r.choice([0, 7, 40, 900, 3000])
        rows.append((flow, last[flow] - (1500 if r.random() < late else 0), i))
    cut = [rows[i * n // parts : (i + 1) * n // parts] for i in range(parts)]
    for some in cut:
        r.shuffle(some)  # order within a micro-batch comes from seq
    return rows, cut


@pytest.mark.parametrize("size,step", [(12, 5), (10, 10), (30, 1)])
def test_count_windows(spark, tmp_path, monkeypatch, size, step):
    monkeypatch.setattr(stateful, "BLOCK", 8)
    rows, batches = some_batches(seed=size)
    w = FlowWindow("sliding_count", count=size, slide_count=step)
    got = streamed(spark, tmp_path, batches, lambda p: fired_windows(p, w, ["seq", "ts_ms"]), f"count{size}")
    flows, expected = {}, {}
    for flow, ts, seq in rows:
        flows.setdefault(flow, []).append((seq, ts))
    for flow, packets in flows.items():
        for no in range(1, len(packets) // step + 1):
            expected[flow, no] = packets[max(0, no * step - size) : no * step]
    assert {(r.flow_key, r.window_no): [tuple(e) for e in r.elements] for r in got} == expected
    assert len(got) == len(expected) and all(r.packets_in_window == len(r.elements) for r in got)


def test_a_million_packets_of_one_flow_in_one_batch(spark, tmp_path):
    n = 1_000_000
    rows = spark.range(n).select(F.lit("a").alias("flow_key"), (F.col("id") * 3).alias("ts_ms"), F.col("id").alias("seq"))
    w = FlowWindow("sliding_count", count=2000, slide_count=500)

    def build(p):
        windows = fired_windows(p, w, ["seq", "ts_ms"])
        times = F.transform("elements", lambda e: e["ts_ms"])
        return windows.select("window_no", "packets_in_window", F.array_min(times).alias("a"), F.array_max(times).alias("b"))

    got = sorted(streamed(spark, tmp_path, [rows], build, "million"))
    assert len(got) == n // 500
    assert all(tuple(r) == (k, min(2000, k * 500), 3 * max(0, k * 500 - 2000), 3 * (k * 500 - 1)) for k, r in enumerate(got, 1))


def test_state_follows_new_packets():
    """What is written in a micro-batch does not grow with what a flow has seen."""
    class Value:
        held = None
        exists = lambda self: self.held is not None
        get = lambda self: self.held

        def update(self, value):
            self.held = value

    class Map(dict):
        written = 0
        containsKey, getValue, removeKey = dict.__contains__, dict.__getitem__, dict.pop  # noqa: N815

        def updateValue(self, key, value):  # noqa: N802
            self.written += len(value[1])
            self[key] = value

    import pandas as pd

    p = stateful.CountWindows(5000, 500, {"ts_ms": "bigint", "seq": "bigint"})
    p.seen, p.blocks, seq = Value(), Map(), 0
    for _ in range(300):
        piece = pd.DataFrame({"ts_ms": np.arange(seq, seq + 40), "seq": np.arange(seq, seq + 40)})
        seq += 40
        fired = list(p.handleInputRows(("a",), iter([piece]), None))
        assert all(f["ts_ms"].map(len).max() <= 5000 for f in fired)
        assert p.blocks.written <= 40 + stateful.BLOCK
        p.blocks.written = 0
        assert len(p.blocks) <= 5500 // stateful.BLOCK + 2


def brute_lengths(rows, threshold=1000):
    seen, out = {}, {}
    for flow, ts, seq in rows:
        times = seen.setdefault(flow, [])
        times.append(ts)
        times.sort()
        gaps = [b - a for a, b in zip(times, times[1:]) if 0 < b - a <= threshold]
        text = "".join(code_of(g, 2) for g in gaps)
        out[seq] = (flow, ts, len(times), len(gaps), len(text), gzip_size(text))
    return out


@pytest.mark.parametrize("late", [0.0, 0.1])
def test_compression_after_each_packet(spark, tmp_path, late):
    rows, batches = some_batches(seed=7, n=200, late=late)
    got = streamed(spark, tmp_path, batches, lambda p: compression_lengths(p, 1000.0, 2), f"lengths{late > 0}")
    assert {r.seq: (r.flow_key, r.ts_ms, r.packets, r.codes, r.text_len, r.gzip_len) for r in got} == brute_lengths(rows)
    if not late:
        d = CompressibilityDetector({"minIats": 1})
        batch = d.score_running(spark.createDataFrame(rows, SCHEMA)).collect()
        known = {r.seq: r.text_len / r.gzip_len for r in got if r.codes}
        assert {r.seq: r.compressibility_score for r in batch} == known


def test_detectors_across_windows(spark, tmp_path):
    rows, batches = some_batches(seed=9)
    w = FlowWindow("tumbling_count", count=7)

    def build(p):
        return chained_python(fired_windows(p, w, ["seq", "ts_ms"]), CountingDetector(), {}, w)

    got = streamed(spark, tmp_path, batches, build, "chained")
    flows = {}
    for r in sorted(got, key=lambda r: (r.flow_key, r.window_no)):
        flows.setdefault(r.flow_key, []).append((r.window_no, r.packets_in_window, r.details.seen))
    sizes = {f: sum(r[0] == f for r in rows) for f in "abc"}
    assert flows == {f: [(k, 7, 7 * k) for k in range(1, n // 7 + 1)] for f, n in sizes.items()}


def test_unlisted_partitions_fail(spark, tmp_path):
    schema = f"{SCHEMA}, {PARTITION} int"
    w = FlowWindow("tumbling", size_ms=1000)
    for k, partition in enumerate([17, None]):
        rows = [("a", i, i, i % 17) for i in range(50)] + [("b", 60, 60, partition)]

        def build(p):
            return window_counts(with_event_time(p, "1 second", partitions=range(17)), w)

        with pytest.raises(Exception, match="not listed: " + ("17" if partition else "null")):
            streamed(spark, tmp_path / str(k), [rows], build, f"unlisted{k}", schema)


class BatchCounter(CountingDetector):
    """The batch form: the same results for many packets at once."""

    calls = 0

    def detect_each(self, packets):
        type(self).calls += 1
        first = self.seen + 1
        self.seen += len(packets)
        return [{"seen": first + i} for i in range(len(packets))]


def test_batch_form_of_detectors():
    import pandas as pd

    packets = pd.DataFrame({"flow_key": "a", "ts_ms": range(9), "seq": range(9)})
    one, many = CountingDetector(), BatchCounter()
    assert packet_results(one, packets) == packet_results(many, packets) and BatchCounter.calls == 1
    with pytest.raises(NotImplementedError):
        PythonDetector().detect_each(packets)


class Described(PythonDetector):
    """Says what it is handed."""

    name, schema = "Described", "said: string"

    def process(self, packets):
        self.said = "; ".join(f"{c} {packets[c].dtype} {[plain(v) for v in packets[c]]}" for c in sorted({*packets.columns} - {"rn", "window_no"}))

    def detect(self):
        return {"said": self.said}


def plain(value):
    return f"array {value.tolist()}" if isinstance(value, np.ndarray) else value


def test_frames_of_stream_windows_are_like_those_of_batches(spark, tmp_path):
    kinds = [
        "timestamp_millis(id * 1000) AS t", "map('a', id) AS m", "array(id, id + 1) AS l", "array('x') AS texts", "array(array(id)) AS deep",
        "encode('x', 'utf-8') AS b", "if(id IN (2, 3), null, id) AS n", "if(id IN (4, 5), null, 's') AS s", "named_struct('u', map('t', array(timestamp_millis(id)))) AS st",
        "id > 2 AS bo", "cast(id AS decimal(10, 2)) AS d", "date'2024-01-01' AS day", "9007199254740993 + id AS big",
    ]
    packets = spark.range(6).selectExpr("concat('f', id % 2) AS flow_key", "id * 10 AS ts_ms", "id AS seq", *kinds).coalesce(1)
    w, columns = FlowWindow("tumbling_count", count=3), [c for c in packets.columns if c != "flow_key"]
    windows = packets.groupBy("flow_key").agg(F.collect_list(F.struct(*columns)).alias("elements"))
    numbered = windows.withColumns({"window_no": F.lit(1).cast("long"), "packets_in_window": F.lit(3).cast("long")})
    got = streamed(spark, tmp_path, [numbered], lambda p: chained_python(p, Described(), {}, w), "described", numbered.schema)
    expected = score_python(packets, Described(), {}, w, ARRIVAL).collect()
    said = [{r.flow_key: r.details.said.split("; ") for r in rows} for rows in (got, expected)]
    assert len(got) == 2 and [(a, b) for f in "01" for a, b in zip(said[0][f"f{f}"], said[1][f"f{f}"], strict=True) if a != b] == []


def test_flows_with_a_few_windows_cost_a_frame_per_window(spark, monkeypatch):
    class Value(dict):
        def get(self):
            return self.held

        def update(self, value):
            self.held = value

        held = None

    import pandas as pd

    made = []
    monkeypatch.setattr(pd.DataFrame, "__init__", lambda self, *a, f=pd.DataFrame.__init__, **b: made.append(1) or f(self, *a, **b))
    packet = StructType.fromDDL("seq bigint, ts_ms bigint")
    p = stateful.ChainedWindows(CountingDetector, Settings({}), ["window_no", "packets_in_window"], packet)
    p.init(SimpleNamespace(getValueState=lambda *a: Value()))
    window = Row("window_no", "packets_in_window", "elements")
    rows = [window(k, 2, [{"seq": 2 * k + 1, "ts_ms": 7}, {"seq": 2 * k, "ts_ms": 5}]) for k in (3, 1, 2)]
    out = list(p.handleInputRows(("a",), iter(rows), None))
    assert [(r.flow_key, r.window_no, r.packets_in_window, r.details, r.error) for r in out] == [("a", k, 2, {"seen": 2 * k}, None) for k in (1, 2, 3)]
    assert list(p.handleInputRows(("a",), iter(rows[:1]), None))[0].details == {"seen": 8}
    assert len(made) == 4
