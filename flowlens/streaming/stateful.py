"""Keyed state of a stream that grows and shrinks piece by piece.

A flow's state is a list or a map in the state store (RocksDB): a micro-batch appends to it, or replaces
the one block it adds to, and removes what no later window can reach. What is written follows the new
packets, not what a flow holds. Packets of a flow in one micro-batch are put in order of arrival as
plain arrays of the columns in use; results leave in frames of bounded size, those of user-written detectors
as rows.
"""

from __future__ import annotations

import logging
from bisect import insort
from collections.abc import Iterator, Mapping
from operator import itemgetter
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..detectors.base import PythonDetector, Settings, shippable
from ..functions.gzip import RunningLength
from ..functions.iat import code_of
from ..operators.windows import FlowWindow
from ..plans.python_windows import as_in_frames, window_packets

log = logging.getLogger(__name__)

#: Packets of a block of state, rows of a result frame.
BLOCK, FRAME = 256, 2_000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keep_state_in_rocksdb(spark: SparkSession) -> None:
    """Lists and maps need this store; it holds for queries started from here on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def transformed(keyed: DataFrame, processor: StatefulProcessor, schema: str) -> DataFrame:
    """``processor`` over the rows of each flow, in append mode and without timers."""
    keep_state_in_rocksdb(keyed.sparkSession)
    return keyed.groupBy("flow_key").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="None"
    )


def in_arrival_order(pieces: Iterator[pd.DataFrame], columns: list[str]) -> dict[str, np.ndarray]:
    """The named columns of one flow's new rows, in order of ``seq``."""
    held: dict[str, list[np.ndarray]] = {c: [] for c in [*columns, "seq"]}
    for piece in pieces:
        for c, arrays in held.items():
            values = piece[c]
            arrays.append(values.to_numpy() if values.notna().all() else values.astype(object).where(values.notna(), None).to_numpy())
    whole = {c: np.concatenate(arrays) if arrays else np.zeros(0, np.int64) for c, arrays in held.items()}
    order = np.argsort(whole["seq"], kind="stable")
    return {c: v[order] for c, v in whole.items()}


def frames(rows: Iterator[tuple], columns: list[str], size: int = FRAME) -> Iterator[pd.DataFrame]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pd.DataFrame(held, columns=columns)
            held = []
    if held:
        yield pd.DataFrame(held, columns=columns)


class CountWindows(StatefulProcessor):
    """Count windows as they fire, from the last packets of a flow kept in blocks.

    A block holds up to ``BLOCK`` packets by number; only the last one is written again when
    packets are added, and blocks before the reach of the next window are removed.
    """

    def __init__(self, size: int, step: int, types: dict[str, str]):
        self.size, self.step, self.types = size, step, types

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "n bigint")
        arrays = ", ".join(f"`{c}` array<{t}>" for c, t in self.types.items())
        self.blocks = handle.getMapState("blocks", "no bigint", f"first bigint, {arrays}")

    def needed_from(self, seen: int) -> int:
        """Number (from 0) of the first packet that a window after ``seen`` packets can reach."""
        return max(0, seen - (self.size - self.step + seen % self.step))

    def _kept(self, start: int, seen: int) -> dict[str, list]:
        kept: dict[str, list] = {c: [] for c in self.types}
        for no in range(start // BLOCK, (seen - 1) // BLOCK + 1) if start < seen else ():
            first, *arrays = self.blocks.getValue((no,))
            for values, array in zip(kept.values(), arrays):
                values.extend(array[max(0, start - first) :])
        return kept

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        names = list(self.types)
        new = in_arrival_order(rows, names)
        seen = self.seen.get()[0] if self.seen.exists() else 0
        start, total = self.needed_from(seen), seen + len(new["seq"])
        values = [[*held, *new[c].tolist()] for c, held in self._kept(start, seen).items()]

        def fired() -> Iterator[tuple]:
            for number in range(seen // self.step + 1, total // self.step + 1):
                a, b = max(0, number * self.step - self.size - start), number * self.step - start
                yield key[0], number, b - a, *[v[a:b] for v in values]

        yield from frames(fired(), ["flow_key", "window_no", "packets_in_window", *names])
        needed = self.needed_from(total)
        for no in range(seen // BLOCK, (total - 1) // BLOCK + 1):
            a, b = max(no * BLOCK, start, needed), min((no + 1) * BLOCK, total)
            if a < b:
                self.blocks.updateValue((no,), (a, *[v[a - start : b - start] for v in values]))
        for no in range(start // BLOCK, min(needed, seen) // BLOCK + 1):
            if (no + 1) * BLOCK <= needed and self.blocks.containsKey((no,)):
                self.blocks.removeKey((no,))
        if needed >= total and self.blocks.containsKey((seen // BLOCK,)):
            self.blocks.removeKey((seen // BLOCK,))
        self.seen.update((total,))

    def close(self) -> None:
        pass


class CompressionLengths(StatefulProcessor):
    """After each packet the number of codes of its flow so far, their length and that of their gzip form.

    The state is the flow's packet times, appended in each micro-batch; the compressor is fed with their
    codes once in a micro-batch and then code by code. A packet behind the newest one
    changes codes in the middle of the text, which is then fed anew.
    """

    columns = ["flow_key", "ts_ms", "seq", "packets", "codes", "text_len", "gzip_len"]
    schema = "flow_key string, ts_ms bigint, seq bigint, packets bigint, codes bigint, text_len bigint, gzip_len bigint"

    def __init__(self, threshold_ms: float, precision: int):
        self.threshold_ms, self.precision = threshold_ms, precision

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.times = handle.getListState("times", "t array<bigint>")

    def _code(self, gap: int) -> str | None:
        return code_of(gap, self.precision) if gap > 0 and gap / 1000.0 <= self.threshold_ms / 1000.0 else None

    def _fed(self, times: list[int]) -> RunningLength:
        state = RunningLength()
        for a, b in zip(times, times[1:]):
            state.add(self._code(b - a))
        return state

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        times = sorted(t for (chunk,) in self.times.get() for t in chunk) if self.times.exists() else []
        new = in_arrival_order(rows, ["ts_ms"])

        def results() -> Iterator[tuple]:
            state = self._fed(times)
            for t, seq in zip(new["ts_ms"].tolist(), new["seq"].tolist()):
                if not times or t >= times[-1]:
                    if times:
                        state.add(self._code(t - times[-1]))
                    times.append(t)
                else:
                    insort(times, t)
                    state = self._fed(times)
                yield key[0], t, seq, len(times), state.codes, state.text_len, state.gzip_len

        yield from frames(results(), self.columns)
        added = new["ts_ms"].tolist()
        self.times.appendList([(added[i : i + BLOCK],) for i in range(0, len(added), BLOCK)])

    def close(self) -> None:
        pass


class ChainedWindows(StatefulProcessor):
    """A user-written detector over the windows of a flow, one after the other; what it keeps beyond
    ``reset`` is kept from window to window as the bytes of its ``snapshot``.

    Windows come and results leave as rows: a flow with a few windows is not worth a frame.
    """

    def __init__(self, kind: type[PythonDetector], settings: Settings, columns: list[str], packet: T.StructType):
        self.kind, self.settings, self.columns, self.packet = kind, settings, columns, packet

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("snapshot", "state binary")
        changes = {f.name: as_in_frames(f.dataType) for f in self.packet}
        self.changes = {c: change for c, change in changes.items() if change}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        detector = self.kind()
        detector.initialize(self.settings)
        held = self.held.get()  # none for a new flow
        if held is not None:
            detector.restore(bytes(held[0]))
        result = Row("flow_key", *self.columns, "details", "error")
        for window in sorted(rows, key=itemgetter(self.columns[0])):
            details, error = None, None
            try:
                detector.process(window_packets(window["elements"], key[0], self.changes))
                details = detector.detect()
            except Exception as e:  # noqa: BLE001 - a failed window becomes a dead letter
                error = str(e)
            try:
                detector.reset()
            except Exception:  # noqa: BLE001
                log.exception("reset failed for %s", self.kind.name)
            if details is not None or error is not None:
                yield result(key[0], *[window[c] for c in self.columns], details, error)
        self.held.update((detector.snapshot(),))
        detector.close()

    def close(self) -> None:
        pass


def fired_windows(packets: DataFrame, w: FlowWindow, columns: list[str]) -> DataFrame:
    """Count windows as they fire: ``flow_key, window_no, packets_in_window, elements``; packets count in order of arrival."""
    types = {c: packets.schema[c].dataType.simpleString() for c in dict.fromkeys([*columns, "seq"])}
    arrays = ", ".join(f"`{c}` array<{t}>" for c, t in types.items())
    windows = transformed(
        packets.select("flow_key", *types), CountWindows(w.count, w.step, types),
        f"flow_key string, window_no bigint, packets_in_window bigint, {arrays}",
    )
    return windows.select("flow_key", "window_no", "packets_in_window", F.arrays_zip(*columns).alias("elements"))


def compression_lengths(packets: DataFrame, threshold_ms: float, precision: int) -> DataFrame:
    """``flow_key, ts_ms, seq, packets, codes, text_len, gzip_len`` after each packet."""
    return transformed(packets.select("flow_key", "ts_ms", "seq"), CompressionLengths(threshold_ms, precision), CompressionLengths.schema)


def chained_python(windows: DataFrame, detector: PythonDetector, config: Mapping[str, Any], w: FlowWindow) -> DataFrame:
    """Results of a user-written detector over closed windows; its state spans the windows of a flow."""
    kind, columns, packet = type(detector), [*w.columns, "packets_in_window"], windows.schema["elements"].dataType.elementType
    bounds = ", ".join(f"{c} bigint" for c in columns)
    schema = f"flow_key string, {bounds}, details struct<{kind.schema}>, error string"
    keep_state_in_rocksdb(windows.sparkSession)
    with shippable(kind):
        return windows.groupBy("flow_key").transformWithState(
            statefulProcessor=ChainedWindows(kind, Settings(dict(config)), columns, packet),
            outputStructType=schema, outputMode="Append", timeMode="None",
        )
