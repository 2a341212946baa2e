"""One call from a job's configuration to its results, for all three modes."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from .plans.job import STREAMING, JobSpec, run_batch
from .session import ship_package
from .sinks.results import write_job
from .sources.topic import packets, read_kafka, read_topic, stream_kafka, stream_topic
from .streaming.job import start


def source(spark: SparkSession, spec: JobSpec, topics: str | None = None) -> DataFrame:
    """The records of the job's topic: from its brokers, or from the folder ``topics/<topic>`` where given."""
    if not spec.input_topic:
        raise ValueError("the configuration names no inputTopic")
    live = spec.mode == STREAMING
    if topics:
        path = f"{topics.rstrip('/')}/{spec.input_topic}"
        return stream_topic(spark, path) if live else read_topic(spark, path)
    if not spec.brokers:
        raise ValueError("the configuration names no kafkaBrokers, and there is no folder of topics")
    return (stream_kafka if live else read_kafka)(spark, spec.brokers, spec.input_topic)


def run_job(
    spark: SparkSession, config: str | Mapping[str, Any], output: str, dead_letters: str | None = None,
    topics: str | None = None, checkpoint: str | None = None, delay: str | None = None, partitions: Sequence[int] | None = None,
) -> StreamingQuery | None:
    """Runs a job from its JSON configuration or the same as a mapping.

    BATCH and REPLAY write below ``output`` (and ``dead_letters``) and return nothing,
    STREAMING returns the running query; it needs ``checkpoint`` and, for time windows, ``delay``.
    """
    spec = JobSpec.from_json(config) if isinstance(config, str) else JobSpec.from_config(json.loads(json.dumps(dict(config))))
    ship_package(spark)
    read = packets(source(spark, spec, topics))
    if spec.mode == STREAMING:
        if not checkpoint:
            raise ValueError("a stream needs a checkpoint folder")
        return start(read, spec, output, checkpoint, dead_letters, delay, partitions=partitions)
    write_job(run_batch(read, spec, stage=True), spec, output, dead_letters)
    return None
