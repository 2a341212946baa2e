"""Detectors against plain Python over each window's packets."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from flowlens.detectors import CompressibilityDetector, FeatureCompressibilityDetector, InterArrivalCvDetector
from flowlens.functions.gzip import gzip_size
from flowlens.functions.iat import code_of, iat_code_ms
from flowlens.operators import ordering, texts
from flowlens.operators.histogram import port_histogram, sketched_ports, window_entropy
from flowlens.operators.ordering import SlicePolicy, with_slices
from flowlens.operators.windows import ARRIVAL, EVENT_TIME, FlowWindow

CUT = SlicePolicy(hot_rows=20, slice_rows=7)


def some_packets(n=400, flows=3, seed=1):
    r = random.Random(seed)
    rows = [(f"f{r.randrange(flows)}", r.choice([-5, r.randrange(0, 4000), 10 * i]), i) for i in range(n)]
    r.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "flow_key string, ts_ms bigint, seq bigint").repartition(3)


def arrival_gaps(times):
    """Gaps that are coded: to the last time that is not negative, if positive and at most a second."""
    last, gaps = None, []
    for t in times:
        if t < 0:
            continue
        if last is not None and 0 < t - last <= 1000:
            gaps.append(t - last)
        last = t
    return gaps


def count_windows(rows, size, step):
    flows = {}
    for flow, ts, seq in sorted(rows, key=lambda r: r[2]):
        flows.setdefault(flow, []).append((ts, seq))
    for flow, packets in flows.items():
        for no in range(1, len(packets) // step + 1):
            yield flow, no, packets[max(0, no * step - size) : no * step]


def test_negative_times_are_passed_over(spark):
    rows = [("f", t, i) for i, t in enumerate((100, -5, 200, 350))]
    d = FeatureCompressibilityDetector({"minIats": 1})
    got = d.score(frame(spark, rows), FlowWindow("tumbling_count", count=4), ARRIVAL).collect()
    assert [(r.iat_count, r.packets_in_window) for r in got] == [(2, 4)]


@pytest.mark.parametrize("policy", [SlicePolicy(None), CUT])
def test_arrival_gaps_in_count_windows(spark, policy):
    rows, w = some_packets(), FlowWindow("sliding_count", count=12, slide_count=5)
    d = FeatureCompressibilityDetector({"minIats": 1})
    got = {(r.flow_key, r.window_no): (r.packets_in_window, r.iat_count) for r in d.score(frame(spark, rows), w, ARRIVAL, policy).collect()}
    expected = {(f, no): (len(p), len(arrival_gaps([t for t, _ in p]))) for f, no, p in count_windows(rows, 12, 5)}
    assert got == {k: v for k, v in expected.items() if v[1]}
    listed = [(f, no, [{"ts_ms": t, "seq": s} for t, s in p]) for f, no, p in count_windows(rows, 12, 5)]
    elements = spark.createDataFrame(listed, "flow_key string, window_no bigint, elements array<struct<ts_ms:bigint,seq:bigint>>")
    same = d.score_elements(elements.withColumn("packets_in_window", F.size("elements").cast("bigint")), ARRIVAL).collect()
    assert {(r.flow_key, r.window_no): (r.packets_in_window, r.iat_count) for r in same} == got


@pytest.mark.parametrize("policy", [SlicePolicy(None), CUT])
def test_arrival_gaps_in_time_windows(spark, policy):
    rows, w = some_packets(seed=2), FlowWindow("sliding", size_ms=900, slide_ms=300)
    d = FeatureCompressibilityDetector({"minIats": 1})
    got = {(r.flow_key, r.window_start): r.iat_count for r in d.score(frame(spark, rows), w, ARRIVAL, policy).collect()}
    windows = {}
    for flow, ts, _ in sorted(rows, key=lambda x: x[2]):
        for k in range((ts - 900) // 300 + 1, ts // 300 + 1):
            windows.setdefault((flow, 300 * k), []).append(ts)
    expected = {k: len(arrival_gaps(v)) for k, v in windows.items()}
    assert got == {k: n for k, n in expected.items() if n}


@pytest.mark.parametrize("policy,order", [(SlicePolicy(None), EVENT_TIME), (CUT, EVENT_TIME), (CUT, ARRIVAL)])
@pytest.mark.parametrize("w", [FlowWindow("sliding", size_ms=1000, slide_ms=400), FlowWindow("sliding_count", count=12, slide_count=5)])
def test_variation_by_panes(spark, policy, w, order):
    rows = some_packets(seed=3)
    d = InterArrivalCvDetector({"minPackets": 2, "threshold": 0.9})
    got = {(r.flow_key, r[1]): (r.packetCount, r.cv) for r in d.score(frame(spark, rows), w, order, policy).collect()}
    flows, windows = {}, {}
    place = {EVENT_TIME: lambda r: (r[1], r[2]), ARRIVAL: lambda r: r[2]}[order]
    for r in sorted(rows, key=place):
        flows.setdefault(r[0], []).append(r[1])
        if not w.counted:
            for k in range((r[1] - w.size_ms) // w.slide_ms + 1, r[1] // w.slide_ms + 1):
                windows.setdefault((r[0], w.slide_ms * k), []).append(r[1])
    if w.counted:
        for flow, times in flows.items():
            for no in range(1, len(times) // w.step + 1):
                windows[flow, no] = times[max(0, no * w.step - w.count) : no * w.step]
    expected = {}
    for key, times in windows.items():
        gaps = [b - a for a, b in zip(times, times[1:])]
        if len(times) >= 2:
            mean = sum(gaps) / len(gaps)
            expected[key] = len(times), statistics.pstdev(gaps) / mean if mean else 0.0
    assert got.keys() == expected.keys()
    assert all(got[k][0] == n and abs(got[k][1] - cv) < 1e-9 * max(1, abs(cv)) for k, (n, cv) in expected.items())


def test_sliding_windows_repeat_panes_only(spark):
    d, w = InterArrivalCvDetector(), FlowWindow("sliding", size_ms=9000, slide_ms=1000)
    plan = d.score(frame(spark, some_packets()), w)._jdf.queryExecution().optimizedPlan().toString()
    lines = [line for line in plan.splitlines() if "Aggregate" in line or "Expand" in line or "Generate" in line]
    # from the scan upward, packets are aggregated before anything multiplies rows
    first = next(i for i, line in reversed(list(enumerate(lines))) if "_unit" in line and "Aggregate" in line)
    assert not any("Expand" in line or "Generate" in line for line in lines[first:])


@pytest.mark.parametrize("case", ["burst", "partitions"])
def test_slices_are_even(spark, case):
    r = random.Random(4)
    if case == "burst":  # nearly all packets in 0.1 % of the range
        times = [r.randrange(10**9) for _ in range(50)] + [500_000 + r.randrange(10**6) for _ in range(9950)]
    else:  # arrival positions of 16 partitions
        times = [(p << 40) + i for p in range(16) for i in range(100 + 100 * p)]
    rows = [("hot", t, i) for i, t in enumerate(times)] + [("cold", t, i) for i, t in enumerate(range(50))]
    df = with_slices(frame(spark, rows), ["flow_key"], "ts_ms", SlicePolicy(hot_rows=1000, slice_rows=200))
    sizes = {(x.flow_key, x.slice): x["count"] for x in df.groupBy("flow_key", "slice").count().collect()}
    hot = [n for (flow, _), n in sizes.items() if flow == "hot"]
    assert sizes["cold", -1] == 50 and sum(hot) == len(times)
    assert max(hot) <= 400 and len(hot) >= len(times) // 400
    bounds = df.where("flow_key = 'hot'").groupBy("slice").agg(F.min("ts_ms").alias("a"), F.max("ts_ms").alias("b")).orderBy("slice").collect()
    assert all(x.b < y.a for x, y in zip(bounds, bounds[1:]))


def test_slices_beyond_the_quantiles(spark, monkeypatch):
    monkeypatch.setattr(ordering, "QUANTILES", 4)
    rows = [("hot", t, t) for t in range(5000)]
    df = with_slices(frame(spark, rows), ["flow_key"], "ts_ms", SlicePolicy(hot_rows=1000, slice_rows=100))
    sizes = [x["count"] for x in df.groupBy("slice").count().collect()]
    assert max(sizes) <= 200 and len(sizes) >= 25


@pytest.mark.parametrize("policy,kind,order", [
    (CUT, CompressibilityDetector, EVENT_TIME), (CUT, FeatureCompressibilityDetector, EVENT_TIME),
    (CUT, FeatureCompressibilityDetector, ARRIVAL), (SlicePolicy(None), FeatureCompressibilityDetector, ARRIVAL),
])
@pytest.mark.parametrize("w", [
    FlowWindow("sliding", size_ms=1000, slide_ms=7), FlowWindow("sliding_count", count=12, slide_count=5),
    FlowWindow("sliding_count", count=30, slide_count=1),
])
def test_scores_of_overlapping_windows(spark, monkeypatch, policy, kind, w, order):
    """Every window's text put together packet by packet and packed as a whole."""
    monkeypatch.setattr(texts, "PIECE_ROWS", 5)
    monkeypatch.setattr(texts, "SHARED_BLOCK", 1)
    monkeypatch.setattr(texts, "OPEN_WINDOWS", 8)
    rows = some_packets(n=150, seed=5)
    d = kind({"minIats": 1, "iatThresholdMs": 1000})
    got = {(r.flow_key, r[1]): (r.packets_in_window, r.iat_count, r.compressibility_score) for r in d.score(frame(spark, rows), w, order, policy).collect()}
    buffered = kind is CompressibilityDetector
    place = (lambda r: (r[1], r[2])) if buffered or order == EVENT_TIME else (lambda r: r[2])
    flows, windows = {}, {}
    for r in sorted(rows, key=place):
        flows.setdefault(r[0], []).append(r[1])
        if not w.counted:
            for k in range((r[1] - w.size_ms) // w.slide_ms + 1, r[1] // w.slide_ms + 1):
                windows.setdefault((r[0], w.slide_ms * k), []).append(r[1])
    if w.counted:
        for flow, times in flows.items():
            for no in range(1, len(times) // w.step + 1):
                windows[flow, no] = times[max(0, no * w.step - w.count) : no * w.step]
    expected = {}
    for key, times in windows.items():
        known = times if buffered else [t for t in times if t >= 0]
        gaps = [b - a for a, b in zip(known, known[1:]) if 0 < b - a <= 1000]
        text = "".join(code_of(g, 2) for g in gaps)
        if gaps and (len(times) >= 2 or not buffered):
            expected[key] = len(times), len(times) if buffered else len(gaps), len(text) / gzip_size(text)
    assert got == expected and len(got) > 20


def test_codes_outside_of_plans(spark):
    gaps = [*range(1, 3000), 9_999, 99_949, 99_951, 10**7, 2**31, 2**40]
    df = spark.createDataFrame([(g,) for g in gaps], "g bigint")
    for precision in (0, 1, 2, 3, 9):
        found = df.select("g", iat_code_ms(F.col("g"), precision).alias("c")).collect()
        assert all(code_of(r.g, precision) == r.c for r in found)


@pytest.mark.parametrize("w", [
    FlowWindow("sliding", size_ms=8000, slide_ms=2000), FlowWindow("sliding_count", count=6000, slide_count=2000),
    FlowWindow("tumbling", size_ms=5000), FlowWindow("tumbling_count", count=5000), FlowWindow("session", size_ms=50),
])
def test_sketched_ports(spark, w):
    """Within five standard errors of the exact count, with thousands of ports in a window."""
    rows = spark.range(30_000, numPartitions=4).select(
        F.lit("a").alias("flow_key"), F.col("id").alias("ts_ms"), F.col("id").alias("seq"),
        F.when(F.col("id") % 10 == 0, -1).otherwise(F.pmod(F.xxhash64("id"), F.lit(50_000))).cast("int").alias("dest_port"),
    )
    exact = {r[:-3]: r[-3:] for r in map(tuple, window_entropy(port_histogram(rows, w), w).drop("entropy_score").collect())}
    got = {r[:-3]: r[-3:] for r in map(tuple, sketched_ports(rows, w).collect())}
    assert got.keys() == exact.keys() and len(got) >= 1
    for k, (packets, skipped, unique) in exact.items():
        assert got[k][:2] == (packets, skipped) and abs(got[k][2] - unique) <= 5 * 0.0163 * unique + 1
