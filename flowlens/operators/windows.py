"""Cutting flows into time, session and count windows (batch forms).

Packets come as rows ``flow_key, ts_ms, seq, ...``. Two kinds of operator work on them:

* :func:`windowed_counts` for results that can be merged. It aggregates small
  units first (panes, gap-wide buckets, blocks of rows) and only then expands
  them to the windows that overlap them, so a sliding window does not multiply
  the rows that are shuffled, and a hot flow is reduced on the map side.
* :func:`window_gaps` for results that depend on the order of packets. Each row
  learns its predecessor in the window; see ``ordering`` for hot flows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import DEFAULT_POLICY, SlicePolicy, with_previous, with_row_number, with_running_sums

NONE, TUMBLING, SLIDING, SESSION = "none", "tumbling", "sliding", "session"
TUMBLING_COUNT, SLIDING_COUNT = "tumbling_count", "sliding_count"
KINDS = (NONE, TUMBLING, SLIDING, SESSION, TUMBLING_COUNT, SLIDING_COUNT)

EVENT_TIME, ARRIVAL = "event_time", "arrival"
ORDERS = {EVENT_TIME: ("ts_ms", "seq"), ARRIVAL: ("seq",)}


@dataclass(frozen=True)
class FlowWindow:
    """How a flow is cut. Sizes in milliseconds or packets."""

    kind: str = TUMBLING
    size_ms: int = 5000
    slide_ms: int = 0
    count: int = 0
    slide_count: int = 0
    partial_flush: bool = False

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"{self.kind!r} is none of the window kinds {', '.join(KINDS)}")
        wrong = []
        if self.counted:
            wrong += ["count has to be positive"] * (self.count <= 0)
            wrong += ["slide_count may not be below 0"] * (self.slide_count < 0)
            wrong += [f"a slide of {self.slide_count} would skip packets between windows of {self.count}"] * (self.slide_count > self.count)
        elif self.kind != NONE:
            wrong += ["size_ms has to be positive"] * (self.size_ms <= 0)
            wrong += ["slide_ms has to be positive"] * (self.kind == SLIDING and self.slide_ms <= 0)
        if wrong:
            raise ValueError(f"{self.kind} window: {'; '.join(wrong)}")

    @property
    def counted(self) -> bool:
        return self.kind in (TUMBLING_COUNT, SLIDING_COUNT)

    @property
    def step(self) -> int:
        """Packets between two firings. The slide decides, not the kind's name; a partial
        flush replaces the sliding trigger by one that fires and clears at the full count."""
        return self.count if self.slide_count == 0 or self.partial_flush else self.slide_count

    @property
    def columns(self) -> list[str]:
        if self.kind == NONE:
            return []
        return ["window_no"] if self.counted else ["window_start", "window_end"]

    @property
    def group(self) -> list[str]:
        return ["flow_key", *self.columns]

    def closed(self, last_rn: Column) -> Column:
        """Whether a count window has fired: its last packet is the one that triggers it."""
        return F.lit(True) if self.partial_flush else last_rn == F.col("window_no") * self.step

    @property
    def family(self) -> str:
        return "count_based" if self.counted else "time_based"


def window_of(kind: str | None, **settings) -> FlowWindow:
    """A window from its configured name; unknown or missing names mean tumbling."""
    name = (kind or TUMBLING).strip().lower()
    return FlowWindow(kind=name if name in KINDS else TUMBLING, **settings)


# ---------------------------------------------------------------- assignment


def assign_time_windows(df: DataFrame, w: FlowWindow, at: str = "ts_ms") -> DataFrame:
    """Adds ``window_start, window_end`` (ms); one row per window that covers the instant ``at``."""
    if w.kind == SLIDING and w.slide_ms > w.size_ms:
        start = F.col(at) - F.pmod(F.col(at), F.lit(w.slide_ms))
        hits = df.where(F.pmod(F.col(at), F.lit(w.slide_ms)) < w.size_ms)
        return hits.withColumns({"window_start": start, "window_end": start + F.lit(w.size_ms)})
    length = f"{w.size_ms} milliseconds"
    slide = f"{w.slide_ms} milliseconds" if w.kind == SLIDING else length
    cut = df.withColumn("_w", F.window(F.timestamp_millis(at), length, slide))
    return cut.withColumns(
        {"window_start": F.unix_millis("_w.start"), "window_end": F.unix_millis("_w.end")}
    ).drop("_w")


def _bucket(gap_ms: int, at: str = "ts_ms") -> Column:
    """Packets of a flow in one gap-wide bucket always belong to the same session."""
    return F.floor(F.col(at) / F.lit(gap_ms)) if gap_ms > 1 else F.col(at)


def _sessions(spans: DataFrame, gap_ms: int) -> DataFrame:
    """Sessions from bucket spans: ``flow_key, bucket, first_ts, last_ts`` to session bounds.

    A flow has at most (time range / gap) buckets, however many packets it has.
    """
    by_time = Window.partitionBy("flow_key").orderBy("bucket")
    opens = F.col("first_ts") - F.lag("last_ts").over(by_time) > gap_ms
    spans = spans.withColumn("_new", F.coalesce(opens, F.lit(True)).cast("int"))
    spans = spans.withColumn("_no", F.sum("_new").over(by_time))
    session = Window.partitionBy("flow_key", "_no")
    return spans.withColumns(
        {
            "window_start": F.min("first_ts").over(session),
            "window_end": F.max("last_ts").over(session) + F.lit(gap_ms),
        }
    ).drop("_new", "_no")


def assign_sessions(df: DataFrame, gap_ms: int) -> DataFrame:
    """Adds the bounds of each packet's session; a distance equal to the gap still joins."""
    rows = df.withColumn("bucket", _bucket(gap_ms))
    spans = rows.groupBy("flow_key", "bucket").agg(F.min("ts_ms").alias("first_ts"), F.max("ts_ms").alias("last_ts"))
    bounds = _sessions(spans, gap_ms).drop("first_ts", "last_ts")
    return rows.join(bounds, ["flow_key", "bucket"]).drop("bucket")


def assign_count_windows(df: DataFrame, w: FlowWindow) -> DataFrame:
    """Adds ``window_no`` to numbered rows; one row per firing that includes the packet."""
    first = F.ceil(F.col("rn") / w.step)
    if w.step == w.count:
        return df.withColumn("window_no", first)
    last = F.floor((F.col("rn") + (w.count - 1)) / w.step)
    return df.withColumn("window_no", F.explode(F.sequence(first, last)))


# ------------------------------------------------------- mergeable aggregates


def _partials(df: DataFrame, keys: list[str], numbered: bool) -> DataFrame:
    aggs = [
        F.count(F.lit(1)).alias("n"), F.min("ts_ms").alias("first_ts"), F.max("ts_ms").alias("last_ts"),
    ]
    return df.groupBy(*keys).agg(*aggs, *([F.max("rn").alias("last_rn")] if numbered else []))


def _merge(units: DataFrame, keys: list[str]) -> DataFrame:
    aggs = [
        F.sum("n").alias("n"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"),
    ]
    numbered = "last_rn" in units.columns
    return units.groupBy(*keys).agg(*aggs, *([F.max("last_rn").alias("last_rn")] if numbered else []))


def windowed_counts(
    packets: DataFrame, w: FlowWindow, by: tuple[str, ...] = (),
    order: str = EVENT_TIME, policy: SlicePolicy = DEFAULT_POLICY,
) -> DataFrame:
    """``n, first_ts, last_ts`` per flow, window and ``by`` columns.

    Count windows also carry ``last_rn``. Without ``by`` the windows that never
    fired are left out; with it that is up to the caller, after merging the
    ``by`` columns away (see :meth:`FlowWindow.closed`).
    """
    keys, narrow = ["flow_key", *by], ["flow_key", "ts_ms", *by]
    out = [*w.group, *by]
    if w.counted:
        rows = with_row_number(packets.select("flow_key", "ts_ms", "seq", *by), ["flow_key"], ORDERS[order], policy)
        unit = math.gcd(w.count, w.step)
        blocks = _partials(rows.withColumn("_block", F.floor((F.col("rn") - 1) / unit)), [*keys, "_block"], True)
        first = F.ceil((F.col("_block") + 1) * unit / w.step)
        last = F.floor((F.col("_block") * unit + w.count) / w.step)
        if w.step == w.count:
            fired = blocks.withColumn("window_no", F.col("_block") + 1).drop("_block")
        else:
            fired = _merge(blocks.withColumn("window_no", F.explode(F.sequence(first, last))), out)
        return fired if by else fired.where(w.closed(F.col("last_rn")))
    rows = packets.select(*narrow)
    if w.kind == SESSION:
        units = _partials(rows.withColumn("bucket", _bucket(w.size_ms)), [*keys, "bucket"], False)
        if not by:
            return _merge(_sessions(units, w.size_ms), out)
        spans = units.groupBy("flow_key", "bucket").agg(
            F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts")
        )
        bounds = _sessions(spans, w.size_ms).drop("first_ts", "last_ts")
        return _merge(units.join(bounds, ["flow_key", "bucket"]), out)
    if w.kind == SLIDING and w.slide_ms <= w.size_ms:
        pane = math.gcd(w.size_ms, w.slide_ms)
        units = rows.withColumn("_pane", F.col("ts_ms") - F.pmod(F.col("ts_ms"), F.lit(pane)))
        units = _partials(units, [*keys, "_pane"], False)
        return _merge(assign_time_windows(units, w, at="_pane"), out)
    return _partials(assign_time_windows(rows, w), out, False)


# ------------------------------------------------------------ ordered packets


def shares_panes(w: FlowWindow, order: str) -> bool:
    """Whether windows overlap and are made of whole panes (or blocks of packets) in this order."""
    if w.counted:
        return w.step < w.count
    return w.kind == SLIDING and w.slide_ms <= w.size_ms and order == EVENT_TIME


def with_unit(rows: DataFrame, w: FlowWindow) -> DataFrame:
    """Adds ``_unit``: the start of a packet's pane, or the number of its block (from ``rn``)."""
    if w.counted:
        return rows.withColumn("_unit", F.floor((F.col("rn") - 1) / math.gcd(w.count, w.step)))
    pane = math.gcd(w.size_ms, w.slide_ms)
    return rows.withColumn("_unit", F.col("ts_ms") - F.pmod(F.col("ts_ms"), F.lit(pane)))


def windows_of_units(units: DataFrame, w: FlowWindow) -> DataFrame:
    """One row per unit and window that holds it."""
    if not w.counted:
        return assign_time_windows(units, w, at="_unit")
    unit = math.gcd(w.count, w.step)
    first = F.ceil((F.col("_unit") + 1) * unit / w.step)
    last = F.floor((F.col("_unit") * unit + w.count) / w.step)
    return units.withColumn("window_no", F.explode(F.sequence(first, last)))


def window_gap_sums(
    packets: DataFrame, w: FlowWindow, order: str = EVENT_TIME, policy: SlicePolicy = DEFAULT_POLICY,
) -> DataFrame:
    """``n, gap_sum, gap_squares`` of overlapping windows, with ``first_ts, last_ts, last_rn``.

    A unit (pane or block) is summed once, over the gaps before its packets; windows add
    up units and take away the gap before their first packet. Only units are repeated for
    windows, never packets. Squares are decimals, so that taking away is exact.
    """
    rows = with_previous(packets.select("flow_key", "ts_ms", "seq"), ["flow_key"], ORDERS[order], "ts_ms", policy, name="prev_ts", number="rn")
    gap = F.coalesce(F.col("ts_ms") - F.col("prev_ts"), F.lit(0)).cast("decimal(18,0)")
    rows = with_unit(rows, w).withColumn("_square", gap * gap)
    units = rows.groupBy("flow_key", "slice", "_unit").agg(
        F.count(F.lit(1)).alias("n"), F.sum("_square").alias("squares"), F.min_by("_square", "rn").alias("lead"),
        F.min_by("ts_ms", "rn").alias("start"), F.max_by("ts_ms", "rn").alias("end"),
        F.min("ts_ms").alias("first_ts"), F.max("ts_ms").alias("last_ts"), F.min("rn").alias("first_rn"), F.max("rn").alias("last_rn"),
    )
    merged = windows_of_units(units, w).groupBy(*w.group).agg(
        F.sum("n").alias("n"), (F.sum("squares") - F.min_by("lead", "first_rn")).alias("gap_squares"),
        (F.max_by("end", "last_rn") - F.min_by("start", "first_rn")).alias("gap_sum"),
        F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.max("last_rn").alias("last_rn"),
    )
    return merged.where(w.closed(F.col("last_rn"))) if w.counted else merged


def window_gaps(
    packets: DataFrame, w: FlowWindow, order: str = EVENT_TIME, policy: SlicePolicy = DEFAULT_POLICY,
    usable: Column | None = None,
) -> tuple[DataFrame, list[str]]:
    """Packets with their window and ``prev_ts``, the packet before them in that window.

    Returns the rows and the columns that identify a window. Rows also carry
    ``slice`` and ``rn``, a number that ascends along the window, and stay
    partitioned by flow and slice, so grouping them by window and slice costs
    no further shuffle.
    Sessions in event-time order are identified by ``session_no``; their bounds
    follow from the first and last packet. In order of arrival the packet before is the
    last ``usable`` one; packets that are not count in their window all the same.
    """
    by, flow = ORDERS[order], ["flow_key"]
    # arrival order equals flow order inside count windows only; elsewhere a late packet
    # may belong to an earlier window than its predecessor
    if order == ARRIVAL and not w.counted:
        placed = assign_sessions(packets, w.size_ms) if w.kind == SESSION else assign_time_windows(packets, w)
        return with_previous(placed, w.group, by, "ts_ms", policy, name="prev_ts", number="rn", usable=usable), w.group

    passing = usable if order == ARRIVAL else None
    rows = with_previous(packets, flow, by, "ts_ms", policy, name="prev_ts", number="rn", usable=passing)
    if w.counted:
        rows = assign_count_windows(rows, w)
        last = F.col("rn") - 1 if passing is None else F.col("prev_ts_rn")
        inside = last > F.col("window_no") * w.step - w.count
        return rows.withColumn("prev_ts", F.when(inside, F.col("prev_ts"))), w.group
    if w.kind == SESSION:
        opens = F.coalesce(F.col("ts_ms") - F.col("prev_ts") > w.size_ms, F.lit(True))
        rows = rows.withColumn("prev_ts", F.when(~opens, F.col("prev_ts")))
        numbers = {"session_no": F.col("prev_ts").isNull().cast("bigint")}
        return with_running_sums(rows, flow, by, numbers, policy), ["flow_key", "session_no"]
    rows = assign_time_windows(rows, w)
    return rows.withColumn("prev_ts", F.when(F.col("prev_ts") >= F.col("window_start"), F.col("prev_ts"))), w.group


def session_bounds(df: DataFrame, w: FlowWindow) -> DataFrame:
    """Turns ``session_no`` with ``first_ts, last_ts`` into window bounds; other windows pass unchanged."""
    if "session_no" not in df.columns:
        return df
    return df.withColumns(
        {"window_start": F.col("first_ts"), "window_end": F.col("last_ts") + F.lit(w.size_ms)}
    ).drop("session_no")


def accumulated(
    counts: DataFrame, w: FlowWindow, sums: tuple[str, ...] = ("n",), policy: SlicePolicy = DEFAULT_POLICY
) -> DataFrame:
    """Running totals over a flow's windows, for detectors that keep their state between windows."""
    order = [w.columns[0]]
    totals = {f"{c}_so_far": F.col(c) for c in sums}
    return with_running_sums(counts, ["flow_key"], order, totals, policy).drop("slice")


def flow_changes(packets: DataFrame, group: list[str], flow: str, order: str = EVENT_TIME) -> DataFrame:
    """Packets per group whose ``flow`` differs from that of the group's first packet.

    Groups by the flow first, so that a group is compared flow by flow and not
    packet by packet. It is 0 where the flow is part of the group.
    """
    position = F.struct(*ORDERS[order])
    flows = packets.groupBy(*group, flow).agg(F.count(F.lit(1)).alias("_n"), F.min(position).alias("_first"))
    first = F.min_by("_n", "_first")
    return flows.groupBy(*group).agg((F.sum("_n") - first).alias("flow_changes"))
