"""Reading result files back, with the labels a log pipeline adds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PIPELINE = "covert-detection"  # fixed value: label of every collected result
LINE_SCHEMA = "algorithmName string, flowId string, timestamp bigint, analysisDetails string"


def parse_results(lines: DataFrame, source: str, host: str, pipeline: str = PIPELINE) -> DataFrame:
    """Columns of the JSON lines in ``value`` with labels; details stay JSON until asked for."""
    parsed = lines.select(F.from_json("value", LINE_SCHEMA).alias("r"), *[c for c in lines.columns if c != "value"])
    return parsed.select("r.*", *[c for c in parsed.columns if c != "r"]).withColumns(
        {"source": F.lit(source), "host": F.lit(host), "pipeline": F.lit(pipeline)}
    )


def read_results(spark: SparkSession, base: str, source: str, host: str, **labels: str) -> DataFrame:
    """All result lines below ``base/<algorithm>``, with the file each came from."""
    lines = spark.read.option("recursiveFileLookup", "true").text(base)
    return parse_results(lines.withColumn("file", F.col("_metadata.file_path")), source, host, **labels)


def stream_results(spark: SparkSession, base: str, source: str, host: str, **labels: str) -> DataFrame:
    """The same for result files that are still being written."""
    return parse_results(spark.readStream.text(f"{base.rstrip('/')}/*"), source, host, **labels)
