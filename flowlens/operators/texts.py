"""Inter-arrival code texts of windows and their compressibility."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.gzip import gzip_length_of_groups, gzip_lengths_of_overlapping, score
from ..functions.iat import iat_code_ms, valid_iat
from .ordering import SlicePolicy, with_previous
from .windows import ORDERS, FlowWindow, shares_panes, with_unit

PIECE_ROWS = 8_192
#: Count windows share the texts of blocks of at least so many packets; smaller ones are no shorter than their packets.
SHARED_BLOCK = 16
#: Neighbouring windows that one task packs at a time; a compressor holds about 256 KB.
OPEN_WINDOWS = 64


def joined_in_order(value: Column, *order: str | Column) -> Column:
    """Aggregate: non-null values joined in the given order."""
    pairs = F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(*order, value.alias("v")))))
    return F.array_join(F.transform(pairs, lambda p: p["v"]), "")


def with_codes(rows: DataFrame, threshold_ms: float, precision: int) -> DataFrame:
    """Adds ``code``, null where the packet has no usable inter-arrival time."""
    delta = F.col("ts_ms") - F.col("prev_ts")
    return rows.withColumn("code", F.when(valid_iat(delta, threshold_ms), iat_code_ms(delta, precision)))


def text_pieces(coded: DataFrame, window: list[str], order: tuple[str, ...]) -> DataFrame:
    """Joined codes of consecutive packets: rows of a window with ``text`` and its position ``piece``.

    A piece covers at most :data:`PIECE_ROWS` packets, whatever the size of the
    window, and never crosses a slice. The rows are partitioned by flow and
    slice already, so this aggregates in place.
    """
    block = F.floor((F.col("rn") - 1) / PIECE_ROWS).alias("_block")
    aggs = [
        F.count(F.lit(1)).alias("packets"), F.count("code").alias("codes"),
        F.min("ts_ms").alias("first_ts"), F.max("ts_ms").alias("last_ts"),
        F.min("rn").alias("piece"), F.max("rn").alias("last_rn"),
        joined_in_order(F.col("code"), *order).alias("text"),
    ]
    return coded.groupBy(*window, "slice", block).agg(*aggs).drop("slice", "_block")


def shares_texts(w: FlowWindow, order: str) -> bool:
    """Whether overlapping windows gain from texts that are built once per pane or block."""
    return shares_panes(w, order) and (not w.counted or math.gcd(w.count, w.step) >= SHARED_BLOCK)


def overlapping_lengths(
    packets: DataFrame, w: FlowWindow, order: str, policy: SlicePolicy, threshold_ms: float, precision: int,
    usable: Column | None = None,
) -> DataFrame:
    """``packets, codes, first_ts, last_ts, last_rn, text_len, gzip_len`` of windows that share panes or blocks.

    The text of a unit is built once, from the gaps before its packets; a window is a list
    of units without the code that refers to a packet before its first one.
    """
    rows = with_previous(
        packets.select("flow_key", "ts_ms", "seq"), ["flow_key"], ORDERS[order], "ts_ms", policy,
        name="prev_ts", number="rn", usable=usable,
    )
    counts = F.lit(True) if usable is None else usable
    if usable is not None:
        rows = rows.withColumn("prev_ts", F.when(usable, F.col("prev_ts")))
    coded = with_unit(with_codes(rows, threshold_ms, precision), w)
    block = F.floor((F.col("rn") - 1) / PIECE_ROWS).alias("_block")
    units = coded.groupBy("flow_key", "slice", "_unit", block).agg(
        F.count(F.lit(1)).alias("packets"), F.count("code").alias("codes"), F.count(F.when(counts, 1)).alias("usable"),
        F.min("ts_ms").alias("first_ts"), F.max("ts_ms").alias("last_ts"), F.min("rn").alias("piece"), F.max("rn").alias("last_rn"),
        F.coalesce(F.min_by(F.coalesce(F.octet_length("code"), F.lit(0)), F.when(counts, F.col("rn"))), F.lit(0)).alias("lead"),
        joined_in_order(F.col("code"), *ORDERS[order]).alias("text"),
    )
    if w.counted:
        unit, number = math.gcd(w.count, w.step), F.col("no")
        first = F.ceil((F.col("_unit") + 1) * unit / w.step)
        last = F.floor((F.col("_unit") * unit + w.count) / w.step)
        place, overlap = {"window_no": number}, w.count / w.step
    else:
        first = F.floor((F.col("_unit") - w.size_ms) / w.slide_ms) + 1
        last = F.floor(F.col("_unit") / w.slide_ms)
        start, overlap = F.col("no") * w.slide_ms, w.size_ms / w.slide_ms
        place = {"window_start": start, "window_end": start + w.size_ms}
    numbered = units.withColumns({"first_no": first.cast("bigint"), "last_no": last.cast("bigint")}).drop("slice", "_unit", "_block")
    lengths = gzip_lengths_of_overlapping(numbered, "flow_key", max(1, min(OPEN_WINDOWS, math.ceil(overlap))))
    lengths = lengths.withColumns(place).drop("no")
    return lengths.where(w.closed(F.col("last_rn"))) if w.counted else lengths


def with_window_totals(pieces: DataFrame, window: list[str]) -> DataFrame:
    """Replaces the counts of a piece by those of its whole window."""
    # ordered only so that the pieces are sorted once, for this and for reading them in order
    whole = (
        Window.partitionBy(*window).orderBy("piece")
        .rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    totals = {
        "packets": F.sum("packets").over(whole), "codes": F.sum("codes").over(whole),
        "first_ts": F.min("first_ts").over(whole), "last_ts": F.max("last_ts").over(whole),
        "text_len": F.sum(F.octet_length("text")).over(whole), "last_rn": F.max("last_rn").over(whole),
    }
    return pieces.withColumns(totals)


def whole_texts(pieces: DataFrame, window: list[str]) -> DataFrame:
    """One row per window with its complete text, for reading rather than scoring."""
    aggs = [
        F.sum("packets").alias("packets"), F.sum("codes").alias("codes"),
        F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"),
        F.max("last_rn").alias("last_rn"),
        joined_in_order(F.col("text"), "piece").alias("text"),
    ]
    return pieces.groupBy(*window).agg(*aggs)


def compressibility(pieces: DataFrame, window: list[str]) -> DataFrame:
    """Adds the gzip length and score of each window; ``pieces`` carry window totals."""
    carry = tuple(c for c in pieces.columns if c not in (*window, "piece", "text"))
    scored = gzip_length_of_groups(pieces, window, "piece", carry=carry)
    return scored.withColumn("compressibility_score", score(F.col("text_len"), F.col("gzip_len")))
