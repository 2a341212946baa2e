"""Per-packet detection on a stream: small running state per flow, a result after each packet."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..detectors.base import PythonDetector, Settings, shippable
from ..plans.python_windows import PACKET_COLUMNS, packet_results
from .stateful import FRAME, in_arrival_order


def running_gaps(packets: DataFrame) -> DataFrame:
    """Per packet: its number in the flow, the gap before it and running sums of gaps.

    ``flow_key, ts_ms, seq, rn, gap_ms, gap_sum, gap_squares``; the state of a flow is four numbers.
    """
    columns = ["flow_key", "ts_ms", "seq", "rn", "gap_ms", "gap_sum", "gap_squares"]

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, last, total, squares = state.get if state.exists else (0, 0, 0.0, 0.0)
        new = pd.DataFrame(in_arrival_order(batches, ["ts_ms"])).assign(flow_key=key[0])
        gaps = new["ts_ms"].diff()
        if n:
            gaps.iloc[0] = new["ts_ms"].iloc[0] - last
        known = gaps.fillna(0.0).astype("float64")
        out = new[["flow_key", "ts_ms", "seq"]].assign(
            rn=range(n + 1, n + 1 + len(new)),
            gap_ms=gaps.astype("Int64"),
            gap_sum=known.cumsum() + total,
            gap_squares=(known * known).cumsum() + squares,
        )
        state.update(
            (n + len(new), int(new["ts_ms"].iloc[-1]), float(out["gap_sum"].iloc[-1]), float(out["gap_squares"].iloc[-1]))
        )
        yield out[columns]

    return packets.select("flow_key", "ts_ms", "seq").groupBy("flow_key").applyInPandasWithState(
        update,
        "flow_key string, ts_ms bigint, seq bigint, rn bigint, gap_ms bigint, gap_sum double, gap_squares double",
        "n bigint, last bigint, gap_sum double, gap_squares double",
        "append",
        GroupStateTimeout.NoTimeout,
    )


def running_python(packets: DataFrame, detector: PythonDetector, config: Mapping[str, Any]) -> DataFrame:
    """Results of a user-written detector after each packet, as the batch form gives them.

    Each packet is processed once. Between micro-batches a flow's detector is kept as
    the bytes of its ``snapshot``. Packets count in order of arrival.
    """
    kind, settings = type(detector), Settings(dict(config))
    columns = [c for c in packets.columns if c not in ("flow_key", "seq")]

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        instance = kind()
        instance.initialize(settings)
        if state.exists:
            instance.restore(bytes(state.get[0]))
        new = in_arrival_order(batches, columns)
        for start in range(0, len(new["seq"]), FRAME):
            some = pd.DataFrame({c: v[start : start + FRAME] for c, v in new.items()}).assign(flow_key=key[0])
            out = packet_results(instance, some)
            if out:
                yield pd.DataFrame(out, columns=PACKET_COLUMNS)
        state.update((instance.snapshot(),))
        instance.close()

    schema = f"flow_key string, ts_ms bigint, seq bigint, details struct<{kind.schema}>, error string"
    with shippable(kind):
        return packets.groupBy("flow_key").applyInPandasWithState(
            update, schema, "snapshot binary", "append", GroupStateTimeout.NoTimeout
        )
