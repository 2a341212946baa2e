"""Reading a packet source: limits, runs of bad records, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from .ordering import DEFAULT_POLICY, SlicePolicy, with_row_number, with_running_sums

MAX_CONSECUTIVE_FAILURES = 100  # fixed value: default abort threshold


def limit_packets(
    packets: DataFrame, source: str, position: str, max_packets: int = 0,
    policy: SlicePolicy = DEFAULT_POLICY,
) -> DataFrame:
    """The first ``max_packets`` packets over all sources (files, partitions) in order; 0 means no limit.

    The limit is applied where the rows are: a packet is kept if its number in its
    source, after the packets of earlier sources, is within the limit.
    """
    if max_packets <= 0:
        return packets
    earlier = Window.orderBy(source).rowsBetween(Window.unboundedPreceding, -1)  # one row per source
    sizes = packets.groupBy(source).agg(F.count(F.lit(1)).alias("_size"))
    before = sizes.select(source, F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"))
    rows = with_row_number(packets, [source], [position], policy, name="_no").drop("slice")
    kept = rows.join(before, source).where(F.col("_before") + F.col("_no") <= max_packets)
    return kept.select(*packets.columns)


def failure_runs(
    records: DataFrame, ok: Column, source: list[str], position: str, policy: SlicePolicy = DEFAULT_POLICY
) -> DataFrame:
    """Runs of consecutive failures: ``source..., first_position, last_position, failures``.

    Failures with the same number of good records before them form one run.
    """
    rows = records.select(*source, position, ok.alias("_ok"))
    good = {"_good": F.col("_ok").cast("bigint")}
    rows = with_running_sums(rows, source, [position], good, policy).where(~F.col("_ok"))
    return rows.groupBy(*source, "_good").agg(
        F.min(position).alias("first_position"),
        F.max(position).alias("last_position"),
        F.count(F.lit(1)).alias("failures"),
    ).drop("_good")


def check_failures(runs: DataFrame, limit: int = MAX_CONSECUTIVE_FAILURES) -> None:
    """Raises if any source has a run of at least ``limit`` failures (runs the job)."""
    worst = runs.where(F.col("failures") >= limit).take(1)
    if worst:
        raise RuntimeError(f"ingest aborted: {worst[0]['failures']} consecutive failures in {worst[0].asDict()}")


def ingest_measures(ok: Column, raw: Column) -> dict[str, Column]:
    sent, total = F.count_if(ok), F.count(F.lit(1))
    return {
        "packets_sent": sent,
        "packets_failed": F.count_if(~ok),
        "bytes_read": F.coalesce(F.sum(F.when(ok, F.length(raw)).cast("bigint")), F.lit(0)),
        "success_rate": F.when(total > 0, sent / total * 100).otherwise(F.lit(0.0)),
    }


def ingest_statistics(records: DataFrame, ok: Column, raw: Column, by: list[str] | None = None) -> DataFrame:
    """Counts, bytes and success rate in percent (0 when nothing was read)."""
    measures = ingest_measures(ok, raw)
    return records.groupBy(*(by or [])).agg(*[c.alias(n) for n, c in measures.items()])


def observed(records: DataFrame, ok: Column, raw: Column, name: str = "ingest") -> tuple[DataFrame, Observation]:
    """The same statistics as a by-product of whatever job reads ``records``."""
    observation = Observation(name)
    return records.observe(observation, *[c.alias(n) for n, c in ingest_measures(ok, raw).items()]), observation
