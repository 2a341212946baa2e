"""Row numbers, previous values and running sums inside groups, also inside huge groups.

A window function puts a whole group into one task. One flow may hold a third
of all packets, so groups above ``hot_rows`` are first cut into *slices*:
consecutive ranges of the order column. A slice is numbered or lagged on its
own, and what it needs from earlier slices (a count, a last value, a sum)
comes from one summary row per slice. Ordinary groups are a single slice and
pay no more than the window function they would need anyway. Group columns
must not hold nulls (flow keys and windows never do), so that the rows keep
their partitioning through the join with the summary.

Slices end at quantiles of the order column, estimated in one mergeable sketch per hot
group, so a burst, or arrival positions that lie far apart, are cut into even slices all the same. Beyond
``QUANTILES`` slices each of them is cut again into equal widths. Rows with equal values
are never parted.

Broadcast bound: the table of hot groups has at most ``N / hot_rows`` rows for
``N`` input rows (a group in it has more than ``hot_rows`` of them), with at most
``N / slice_rows`` boundaries in all. A trillion rows give at most a million entries with four
million boundaries at the default setting.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SlicePolicy:
    """When to cut a group, and how many rows a slice should hold on average.

    ``hot_rows=None`` switches the cutting off for data known to be even.
    """

    hot_rows: int | None = 1_000_000
    slice_rows: int = 250_000


DEFAULT_POLICY = SlicePolicy()
WHOLE = -1  # slice number of a group that is not cut
#: Quantiles estimated for a hot group, and the sketch's accuracy (rank errors are below rows / ACCURACY).
QUANTILES, ACCURACY = 1000, 20_000


def _hot_groups(df: DataFrame, group: Sequence[str], by: str, policy: SlicePolicy) -> DataFrame:
    """``_bounds`` (ascending; with the lowest and the highest value) of each hot group and ``_parts``, cuts between two of them."""
    sizes = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > policy.hot_rows)
    # only rows of hot groups reach the sketches
    rows = df.select(*group, by).join(F.broadcast(sizes), list(group))
    shares = F.array(*[F.lit(i / QUANTILES) for i in range(QUANTILES + 1)])
    sketched = rows.groupBy(*group).agg(F.max("_n").alias("_n"), F.percentile_approx(by, shares, ACCURACY).alias("_q"), F.min(by).alias("_low"))
    wanted = F.ceil(F.col("_n") / F.lit(policy.slice_rows))
    slices = F.least(wanted, F.lit(QUANTILES)).cast("int")
    place = lambda i: F.floor(i * F.lit(float(QUANTILES)) / slices).cast("int") + 1
    inner = F.transform(F.sequence(F.lit(1), slices), lambda i: F.element_at("_q", place(i)))
    return sketched.select(
        *group, F.concat(F.array("_low"), inner).alias("_bounds"), F.ceil(wanted / slices).cast("bigint").alias("_parts")
    )


def _slice_number(value: Column) -> Column:
    """Slices before ``value``: a binary search in ``_bounds``, then equal widths between two bounds."""
    steps = F.array(*[F.lit(1 << k) for k in range(QUANTILES.bit_length() - 1, -1, -1)])
    bound = lambda i: F.try_element_at(F.col("_bounds"), i)
    found = F.aggregate(
        steps, F.lit(1), lambda at, k: F.when(F.coalesce(bound(at + k) <= value, F.lit(False)), at + k).otherwise(at)
    )
    # the last bound is the highest value, and belongs to the slice before it
    slice_ = F.least(found, F.size("_bounds") - 1)
    low, high = bound(slice_), bound(slice_ + 1)
    # doubles are enough here: any width gives right results, only the slice sizes differ
    inside = F.floor((value - low).cast("double") / (high - low + 1) * F.col("_parts"))
    part = F.greatest(F.lit(0), F.least(inside, F.col("_parts") - 1))
    return ((slice_ - 1) * F.col("_parts") + F.when(F.col("_parts") > 1, part).otherwise(0)).cast("bigint")


def with_slices(
    df: DataFrame, group: Sequence[str], by: str, policy: SlicePolicy = DEFAULT_POLICY, hot_only: bool = False
) -> DataFrame:
    """Adds ``slice`` (bigint): -1 in ordinary groups, from 0 up along ``by`` (bigint) in hot ones.

    With ``hot_only`` just the rows of hot groups are returned.
    """
    if policy.hot_rows is None:
        return df.withColumn("slice", F.lit(WHOLE).cast("bigint"))
    hot = F.broadcast(_hot_groups(df, group, by, policy))
    joined = df.join(hot, list(group), "inner" if hot_only else "left")
    number = F.when(F.col("_bounds").isNotNull(), _slice_number(F.col(by)))
    return joined.select(*df.columns, F.coalesce(number, F.lit(WHOLE)).cast("bigint").alias("slice"))


def _earlier(group: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*group).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)


def _attach(rows: DataFrame, summary: DataFrame, group: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Joins the summary of a hot group's slices; rows keep their partitioning by group and slice."""
    keys = [*group, "slice"]
    return rows.join(summary.select(*keys, *names), keys, "left").select(*rows.columns, *names)


def with_row_number(
    df: DataFrame, group: Sequence[str], order: Sequence[str],
    policy: SlicePolicy = DEFAULT_POLICY, name: str = "rn",
) -> DataFrame:
    """Adds the 1-based position of each row in its group, and its ``slice``."""
    rows = with_slices(df, group, order[0], policy)
    inside = Window.partitionBy(*group, "slice").orderBy(*order)
    rows = rows.withColumn(name, F.row_number().over(inside).cast("bigint"))
    if policy.hot_rows is None:
        return rows
    before = (
        with_slices(df, group, order[0], policy, hot_only=True)
        .groupBy(*group, "slice").agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn("_before", F.sum("_rows").over(_earlier(group)))
    )
    rows = _attach(rows, before, group, ["_before"])
    return rows.withColumn(name, F.col(name) + F.coalesce(F.col("_before"), F.lit(0))).drop("_before")


def with_previous(
    df: DataFrame, group: Sequence[str], order: Sequence[str], column: str,
    policy: SlicePolicy = DEFAULT_POLICY, name: str = "prev", number: str | None = None, usable: Column | None = None,
) -> DataFrame:
    """Adds the value of ``column`` in the row before (null in a group's first row), and ``slice``.

    ``number`` also adds the row's position, from the same sort and the same summary. With
    ``usable``, rows without it are passed over: the value is that of the last usable row
    before, and its position is ``<name>_<number>``. ``column`` must not hold nulls.
    """
    if usable is not None:
        return _with_previous_usable(df, group, order, column, policy, name, number or "rn", usable)
    rows = with_slices(df, group, order[0], policy)
    inside = Window.partitionBy(*group, "slice").orderBy(*order)
    rows = rows.withColumn(name, F.lag(column).over(inside))
    if number:
        rows = rows.withColumn(number, F.row_number().over(inside).cast("bigint"))
    if policy.hot_rows is None:
        return rows
    if column == order[0]:
        last = F.max(column)
    else:
        last = F.max_by(column, order[0] if len(order) == 1 else F.struct(*order))
    ends = (
        with_slices(df, group, order[0], policy, hot_only=True)
        .groupBy(*group, "slice")
        .agg(last.alias("_last"), F.count(F.lit(1)).alias("_rows"))
        .withColumn("_carry", F.lag("_last").over(Window.partitionBy(*group).orderBy("slice")))
        .withColumn("_before", F.sum("_rows").over(_earlier(group)))
    )
    rows = _attach(rows, ends, group, ["_carry", "_before"])
    rows = rows.withColumn(name, F.coalesce(name, "_carry"))
    if number:
        rows = rows.withColumn(number, F.col(number) + F.coalesce(F.col("_before"), F.lit(0)))
    return rows.drop("_carry", "_before")


def _with_previous_usable(
    df: DataFrame, group: Sequence[str], order: Sequence[str], column: str,
    policy: SlicePolicy, name: str, number: str, usable: Column,
) -> DataFrame:
    place = f"{name}_{number}"
    rows = with_slices(df, group, order[0], policy)
    inside = Window.partitionBy(*group, "slice").orderBy(*order)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    own = F.when(usable, F.struct(F.col(column).alias("value"), F.col(number).alias("place")))
    rows = rows.withColumn(number, F.row_number().over(inside).cast("bigint"))
    rows = rows.withColumn("_found", F.last(own, ignorenulls=True).over(before))
    if policy.hot_rows is not None:
        earlier = _earlier(group)
        hot = with_slices(df, group, order[0], policy, hot_only=True).withColumn(number, F.row_number().over(inside).cast("bigint"))
        ends = (
            hot.groupBy(*group, "slice")
            .agg(F.max_by(own, F.when(usable, F.col(number))).alias("_own"), F.count(F.lit(1)).alias("_rows"))
            .withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
            .withColumn("_own", F.when(F.col("_own").isNotNull(), F.struct("_own.value", (F.col("_own.place") + F.col("_before")).alias("place"))))
            .withColumn("_carry", F.last("_own", ignorenulls=True).over(earlier))
        )
        rows = _attach(rows, ends, group, ["_carry", "_before"])
        shift = F.coalesce("_before", F.lit(0))
        moved = F.when(F.col("_found").isNotNull(), F.struct("_found.value", (F.col("_found.place") + shift).alias("place")))
        rows = rows.withColumn("_found", F.coalesce(moved, F.col("_carry"))).withColumn(number, F.col(number) + shift).drop("_carry", "_before")
    return rows.withColumns({name: F.col("_found.value"), place: F.col("_found.place")}).drop("_found")


def with_running_sums(
    df: DataFrame, group: Sequence[str], order: Sequence[str], sums: dict[str, Column],
    policy: SlicePolicy = DEFAULT_POLICY,
) -> DataFrame:
    """Adds running totals (up to and including the row) of integer expressions.

    ``df`` may carry a ``slice`` column from an earlier step over the same group
    and order; it is used again, so no further shuffle is needed.
    """
    sliced = "slice" in df.columns
    rows = df if sliced else with_slices(df, group, order[0], policy)
    inside = (
        Window.partitionBy(*group, "slice").orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    result = rows.withColumns({n: F.sum(e).over(inside) for n, e in sums.items()})
    if policy.hot_rows is None:
        return result
    hot = rows.where(F.col("slice") != WHOLE) if sliced else with_slices(df, group, order[0], policy, hot_only=True)
    totals = hot.groupBy(*group, "slice").agg(*[F.sum(e).alias(f"_t_{n}") for n, e in sums.items()])
    totals = totals.withColumns({f"_b_{n}": F.sum(f"_t_{n}").over(_earlier(group)) for n in sums})
    result = _attach(result, totals, group, [f"_b_{n}" for n in sums])
    return result.withColumns(
        {n: F.col(n) + F.coalesce(F.col(f"_b_{n}"), F.lit(0)) for n in sums}
    ).drop(*[f"_b_{n}" for n in sums])
