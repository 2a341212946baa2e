"""Results as JSON lines, dead letters as JSON lines beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..detectors import Detector, PythonDetector
from ..plans.job import JobSpec, letter_columns, parallel, result_columns
from .rolling import rolling


def result_line(results: DataFrame) -> DataFrame:
    """One column ``value``: the JSON object of each result."""
    line = F.struct(
        F.col("algorithm").alias("algorithmName"),
        F.col("flow_id").alias("flowId"),
        F.col("result_ts").alias("timestamp"),
        F.col("details").alias("analysisDetails"),
    )
    return results.select(F.to_json(line).alias("value"))


def dead_letter_line(letters: DataFrame) -> DataFrame:
    """One column ``value``: ``error``, ``key`` and the window of each failure, escaped as JSON."""
    rest = [c for c in letters.columns if c not in ("error", "flow_key")]
    return letters.select(F.to_json(F.struct("error", F.col("flow_key").alias("key"), *rest)).alias("value"))


def _folder(base: str | None, algorithm: str) -> str:
    if not base:
        raise ValueError("an output path is required")
    return f"{base.rstrip('/')}/{algorithm}"


def write_lines(
    lines: DataFrame, base: str | None, algorithm: str, max_records: int | None = None, single_file: bool = False
) -> str:
    """Writes part files below ``base/algorithm``, in parallel unless a single file is asked for."""
    path = _folder(base, algorithm)
    writer = (lines.coalesce(1) if single_file else lines).write.mode("append")
    if max_records:
        writer = writer.option("maxRecordsPerFile", max_records)
    writer.text(path)
    return path


def replace_lines(lines: DataFrame, base: str | None, algorithm: str, batch: int) -> str:
    """As ``write_lines`` for one micro-batch, whose files take the place of those of an earlier attempt."""
    path = _folder(base, algorithm)
    rows = lines.select(F.lit(False).alias("failed"), "value")
    rolling(rows.write, rows, path).option("batch", str(batch)).mode("append").save()
    return path


def both_lines(scored: DataFrame, spec: JobSpec, detector: Detector | PythonDetector) -> DataFrame:
    """``failed, value``: the line of each result, and of each failure, in one pass over the rows."""
    algorithm, flow, at, details = result_columns(scored, spec, detector)
    result = F.to_json(F.struct(algorithm.alias("algorithmName"), flow.alias("flowId"), at.alias("timestamp"), details.alias("analysisDetails")))
    if not isinstance(detector, PythonDetector):
        return scored.select(F.lit(False).alias("failed"), result.alias("value"))
    failed = F.col("error").isNotNull()
    if not spec.window.columns:  # per packet there are no dead letters
        return scored.where(~failed).select(F.lit(False).alias("failed"), result.alias("value"))
    error, key, place = letter_columns(spec.window)
    letter = F.to_json(F.struct(error, key.alias("key"), place))
    return scored.select(failed.alias("failed"), F.when(failed, letter).otherwise(result).alias("value"))


def write_job(
    scored: DataFrame, spec: JobSpec, output: str | None, dead_letter_path: str | None = None, single_file: bool = False,
    max_records: int | None = None, roll_bytes: int | None = None, roll_seconds: float | None = None,
) -> None:
    """Writes a batch job's results and, where a path is given, its dead letters, in one pass.

    Files are rolled by number, size and age; all of them appear when the job has ended.
    """
    detector = spec.detector()
    results = _folder(output, detector.name)
    failures = _folder(dead_letter_path, detector.name) if dead_letter_path else None
    lines = both_lines(scored, spec, detector)
    with parallel(scored.sparkSession, spec):
        lines = lines.coalesce(1) if single_file else lines
        limits = {"roll_records": max_records, "roll_bytes": roll_bytes, "roll_seconds": roll_seconds}
        rolling(lines.write, lines, results, failures, **limits).mode("append").save()


def stream_lines(
    lines: DataFrame, base: str | None, algorithm: str, checkpoint: str, interval: str = "30 seconds"
) -> DataStreamWriter:
    """Stream writer for result lines; files are committed with the checkpoint."""
    return (
        lines.writeStream.format("text").outputMode("append")
        .option("path", _folder(base, algorithm)).option("checkpointLocation", checkpoint)
        .trigger(processingTime=interval)
    )


def details_variant(details: Column) -> Column:
    """Details as VARIANT, so that results of different detectors fit one table."""
    return F.parse_json(F.to_json(details))


def stream_job(
    scored: DataFrame, spec: JobSpec, output: str | None, dead_letter_path: str | None, checkpoint: str, interval: str = "30 seconds"
) -> DataStreamWriter:
    """Stream writer for results and dead letters; a micro-batch's files are rolled alike and appear together."""
    detector = spec.detector()
    failures = _folder(dead_letter_path, detector.name) if dead_letter_path else None
    lines = both_lines(scored, spec, detector)
    writer = rolling(lines.writeStream, lines, _folder(output, detector.name), failures).outputMode("append")
    return writer.option("checkpointLocation", checkpoint).trigger(processingTime=interval)
