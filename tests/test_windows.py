"""Windows and ordered operators against plain Python, with hot flows cut into slices."""

import math
import random

import pytest
from pyspark.sql import functions as F

from flowlens.operators.ingest import check_failures, failure_runs
from flowlens.operators.ordering import SlicePolicy, with_previous, with_row_number, with_running_sums
from flowlens.operators.windows import (
    ARRIVAL, EVENT_TIME, ORDERS, FlowWindow, accumulated, assign_sessions, window_gaps, window_of, windowed_counts,
)

POLICIES = [SlicePolicy(hot_rows=None), SlicePolicy(hot_rows=20, slice_rows=7), SlicePolicy()]


def some_packets(seed=3, n=400):
    """One flow holds most packets, many of them in the same millisecond."""
    rng = random.Random(seed)
    rows = []
    for seq in range(n):
        flow = "hot" if rng.random() < 0.7 else f"f{rng.randrange(6)}"
        burst = rng.random() < 0.3
        rows.append((flow, 5_000 if burst else rng.randrange(0, 60_000), seq, rng.choice((-1, 80, 80, 443, 8080))))
    return rows


@pytest.fixture(scope="module")
def rows():
    return some_packets()


@pytest.fixture(scope="module")
def packets(spark, rows):
    return spark.createDataFrame(rows, "flow_key string, ts_ms bigint, seq bigint, dest_port int").repartition(3).cache()


def flows(rows, order=EVENT_TIME):
    out = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2]) if order == EVENT_TIME else r[2]):
        out.setdefault(r[0], []).append(r)
    return out


def windows(rows, w, order=EVENT_TIME):
    """{(flow, window...): packets in order}, by definition."""
    out = {}
    for flow, ps in flows(rows, order).items():
        if w.counted:
            n, size, step = len(ps), w.count, w.step
            for f in range(1, math.ceil(n / step) + 1):
                if f * step <= n or w.partial_flush:
                    out[(flow, f)] = ps[max(0, f * step - size) : f * step]
        elif w.kind == "session":
            times = sorted(p[1] for p in ps)
            spans = []
            for t in times:
                if spans and t - spans[-1][1] <= w.size_ms:
                    spans[-1][1] = t
                else:
                    spans.append([t, t])
            for a, b in spans:
                out[(flow, a, b + w.size_ms)] = [p for p in ps if a <= p[1] <= b]
        else:
            slide = w.slide_ms if w.kind == "sliding" else w.size_ms
            for start in range(-(w.size_ms // slide + 1) * slide, 60_000, slide):
                part = [p for p in ps if start <= p[1] < start + w.size_ms]
                if part:
                    out[(flow, start, start + w.size_ms)] = part
    return out


WINDOWS = [
    FlowWindow("tumbling", size_ms=10_000),
    FlowWindow("sliding", size_ms=9_000, slide_ms=2_000),
    FlowWindow("sliding", size_ms=1_500, slide_ms=5_000),
    FlowWindow("session", size_ms=700),
    FlowWindow("tumbling_count", count=6),
    FlowWindow("sliding_count", count=10, slide_count=4),
    FlowWindow("tumbling_count", count=9, slide_count=3),
    FlowWindow("tumbling_count", count=10, partial_flush=True),
    FlowWindow("sliding_count", count=10, slide_count=4, partial_flush=True),
]


@pytest.mark.parametrize("w", WINDOWS, ids=lambda w: f"{w.kind}-{w.size_ms}-{w.count}-{w.step}-{w.partial_flush}")
@pytest.mark.parametrize("order", [EVENT_TIME, ARRIVAL])
def test_counts_and_gaps(packets, rows, w, order):
    policy = POLICIES[1]
    expected = windows(rows, w, order)
    counts = windowed_counts(packets, w, order=order, policy=policy)
    got = {tuple(r[c] for c in w.group): (r.n, r.first_ts, r.last_ts) for r in counts.collect()}
    assert got == {k: (len(v), min(p[1] for p in v), max(p[1] for p in v)) for k, v in expected.items()}

    gaps, window = window_gaps(packets, w, order, policy)
    found = {}
    for r in gaps.orderBy(*window, *ORDERS[order]).collect():
        found.setdefault(tuple(r[c] for c in window), []).append((r.seq, r.prev_ts))
    by_definition = {}
    for k, v in expected.items():
        by_definition[k] = [(p[2], before[1] if before else None) for p, before in zip(v, [None, *v])]
    if "session_no" in window:
        assert sorted(found.values()) == sorted(by_definition.values())
    elif w.counted:
        assert {k: v for k, v in found.items() if k in by_definition} == by_definition
    else:
        assert found == by_definition


@pytest.mark.parametrize("policy", POLICIES, ids=["never", "often", "default"])
def test_positions_previous_and_sums(packets, rows, policy):
    order = ORDERS[EVENT_TIME]
    df = with_previous(packets, ["flow_key"], order, "ts_ms", policy, number="no")
    df = with_running_sums(df, ["flow_key"], order, {"total": F.col("seq")}, policy)
    numbered = with_row_number(packets, ["flow_key"], order, policy).select("seq", "rn")
    got = {r.seq: (r.no, r.rn, r.prev, r.total) for r in df.join(numbered, "seq").collect()}
    expected = {}
    for ps in flows(rows).values():
        total, before = 0, None
        for i, p in enumerate(ps, 1):
            total += p[2]
            expected[p[2]] = (i, i, before, total)
            before = p[1]
    assert got == expected


def test_hot_flow_is_cut_and_others_are_not(packets):
    df = with_row_number(packets, ["flow_key"], ORDERS[EVENT_TIME], SlicePolicy(hot_rows=100, slice_rows=20))
    slices = {r.flow_key: r.n for r in df.groupBy("flow_key").agg(F.countDistinct("slice").alias("n")).collect()}
    assert slices.pop("hot") > 5 and set(slices.values()) == {1}


def test_session_bounds_and_touching_gap(spark):
    df = spark.createDataFrame([("a", 0, 1), ("a", 10_000, 2), ("a", 21_000, 3)], "flow_key string, ts_ms bigint, seq bigint")
    w = FlowWindow("session", size_ms=10_000)
    counts = windowed_counts(df, w).select("window_start", "window_end", "n").orderBy("window_start").collect()
    assert [tuple(r) for r in counts] == [(0, 20_000, 2), (21_000, 31_000, 1)]
    assert {r.window_end for r in assign_sessions(df, 10_000).collect()} == {20_000, 31_000}


def test_sliding_count_golden(spark):
    df = spark.createDataFrame([("a", i, i) for i in range(1, 26)], "flow_key string, ts_ms bigint, seq bigint")

    def spans(w):
        rows = windowed_counts(df, w).orderBy("window_no").collect()
        return [(r.first_ts, r.last_ts) for r in rows]

    assert spans(FlowWindow("sliding_count", count=10, slide_count=4)) == [(1, 4), (1, 8), (3, 12), (7, 16), (11, 20), (15, 24)]
    assert spans(FlowWindow("tumbling_count", count=10)) == [(1, 10), (11, 20)]
    assert spans(FlowWindow("tumbling_count", count=10, partial_flush=True)) == [(1, 10), (11, 20), (21, 25)]


def test_accumulated(packets, rows):
    w = WINDOWS[0]
    got = accumulated(windowed_counts(packets, w), w, policy=SlicePolicy(hot_rows=2, slice_rows=1)).collect()
    total = {}
    for key, ps in sorted(windows(rows, w).items()):
        total[key] = total.get((key[0], "sum"), 0) + len(ps)
        total[(key[0], "sum")] = total[key]
    assert all(r.n_so_far == total[(r.flow_key, r.window_start, r.window_end)] for r in got) and len(got) > 7


def test_failure_runs(spark):
    marks = "..xx.xxx..x"
    df = spark.createDataFrame([("s", i, m == ".") for i, m in enumerate(marks)], "source string, no bigint, ok boolean")
    runs = failure_runs(df, F.col("ok"), ["source"], "no", SlicePolicy(hot_rows=3, slice_rows=2))
    got = sorted((r.first_position, r.last_position, r.failures) for r in runs.collect())
    assert got == [(2, 3, 2), (5, 7, 3), (10, 10, 1)]
    check_failures(runs, 4)
    with pytest.raises(RuntimeError, match="3 consecutive"):
        check_failures(runs, 3)


@pytest.mark.parametrize(
    "settings",
    [
        {"kind": "tumbling", "size_ms": 0}, {"kind": "sliding", "size_ms": 5, "slide_ms": 0},
        {"kind": "tumbling_count", "count": 0}, {"kind": "sliding_count", "count": 5, "slide_count": -1},
        {"kind": "sliding_count", "count": 5, "slide_count": 6}, {"kind": "hexagonal"},
    ],
)
def test_invalid_windows(settings):
    with pytest.raises(ValueError):
        FlowWindow(**settings)


def test_window_names():
    assert window_of(" Session ").kind == "session"
    assert window_of("unheard of").kind == window_of(None).kind == "tumbling"
    assert window_of("tumbling_count", count=8, slide_count=2).step == 2


def test_ingest_statistics(spark, tmp_path):
    from flowlens.operators.ingest import ingest_statistics, observed

    df = spark.createDataFrame([(bytearray(20),), (bytearray(13),), (bytearray(3),), (None,)], "value binary")
    ok = F.coalesce(F.length("value") >= 12, F.lit(False))
    expected = {"packets_sent": 2, "packets_failed": 2, "bytes_read": 33, "success_rate": 50.0}
    assert ingest_statistics(df, ok, F.col("value")).first().asDict() == expected
    watched, seen = observed(df, ok, F.col("value"))
    watched.write.parquet(str(tmp_path / "out"))
    assert seen.get == expected
    assert ingest_statistics(df.limit(0), ok, F.col("value")).first().success_rate == 0.0
