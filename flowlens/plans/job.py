"""Job configuration and the batch run of a detector."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Mapping
from contextlib import contextmanager
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..detectors import Detector, PythonDetector, Settings, create
from ..functions.features import project_features
from ..functions.keys import with_flow_key
from ..operators.ordering import DEFAULT_POLICY, SlicePolicy
from ..operators.windows import ARRIVAL, EVENT_TIME, NONE, FlowWindow, window_of
from ..session import shared_dir
from .python_windows import score_python

BATCH, REPLAY, STREAMING = "BATCH", "REPLAY", "STREAMING"


@dataclass(frozen=True)
class JobSpec:
    """A job from its flat JSON configuration."""

    algorithm: str
    mode: str = STREAMING
    window: FlowWindow = field(default_factory=FlowWindow)
    input_topic: str | None = None
    brokers: str | None = None
    parallelism: int | None = None
    config: Mapping[str, Any] = field(default_factory=dict)

    @classmethod
    def from_config(cls, config: Mapping[str, Any]) -> JobSpec:
        if not config.get("algorithmClassName"):
            raise ValueError("algorithmClassName is required")
        mode = str(config.get("executionMode", STREAMING)).upper()
        mode = mode if mode in (BATCH, REPLAY) else STREAMING
        flush = str(config.get("partialFlush", "false")).lower() == "true"
        window = window_of(
            config.get("windowType"),
            size_ms=int(config.get("windowSizeMs", 5000)),
            slide_ms=int(config.get("slideMs", 0)),
            count=int(config.get("windowCount", 0)),
            slide_count=int(config.get("slideCount", 0)),
            partial_flush=flush and mode == BATCH,
        )
        parallelism = config.get("parallelism")
        return cls(
            algorithm=config["algorithmClassName"],
            mode=mode,
            window=window,
            input_topic=config.get("inputTopic"),
            brokers=config.get("kafkaBrokers"),
            parallelism=int(parallelism) if parallelism is not None else None,
            config=dict(config),
        )

    @classmethod
    def from_json(cls, text: str) -> JobSpec:
        return cls.from_config(json.loads(text))

    @property
    def order(self) -> str:
        """Batch runs see a flow by event time, replays in order of arrival."""
        return EVENT_TIME if self.mode == BATCH else ARRIVAL

    def detector(self) -> Detector | PythonDetector:
        return create(self.algorithm, Settings(self.config))


def keyed_features(packets: DataFrame, detector: Detector | PythonDetector) -> DataFrame:
    """Packets with their flow key and just the columns the detector reads."""
    return project_features(with_flow_key(packets, detector.key), *detector.features())


def staged(features: DataFrame) -> DataFrame:
    """Features written to and read back from the cluster's shared folder.

    Ordered plans read their input more than once. Over raw packets that would
    mean parsing them again, over staged features it is a narrow columnar
    scan, which also survives the loss of executors.
    """
    spark = features.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/flowlens-features-{uuid.uuid4().hex}"
    features.write.parquet(path)
    return spark.read.parquet(path)


@contextmanager
def parallel(spark: SparkSession, spec: JobSpec) -> Iterator[None]:
    """Shuffle partitions as the job asks for, for what is executed within, and as they were after it."""
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    if spec.parallelism:
        spark.conf.set(key, str(spec.parallelism))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def run_batch(
    packets: DataFrame, spec: JobSpec, policy: SlicePolicy = DEFAULT_POLICY, stage: bool = False
) -> DataFrame:
    """Scored windows of a BATCH or REPLAY job.

    Columns: ``flow_key``, the window columns, ``packets_in_window``, the
    detector's details and, for user-written detectors, ``error``.
    """
    detector = spec.detector()
    features = keyed_features(packets, detector)
    if stage:
        features = staged(features)
    if isinstance(detector, PythonDetector):
        return score_python(features, detector, spec.config, spec.window, spec.order, policy)
    if spec.window.kind == NONE:
        return detector.score_running(features, spec.order, policy)
    return detector.score(features, spec.window, spec.order, policy)


def enriched(scored: DataFrame, spec: JobSpec, detector: Detector | PythonDetector | None = None) -> DataFrame:
    """Result rows ``algorithm, flow_id, result_ts, details`` with the framework's own details.

    Details is a struct; the framework's values are text, as result files have them.
    """
    detector = detector or spec.detector()
    if isinstance(detector, PythonDetector):
        scored = scored.where(F.col("error").isNull())
    return scored.select(*result_columns(scored, spec, detector))


def result_columns(scored: DataFrame, spec: JobSpec, detector: Detector | PythonDetector) -> list[Column]:
    now = F.unix_millis(F.current_timestamp())
    if isinstance(detector, PythonDetector):
        names = [F.col("details")[f].alias(f) for f in scored.schema["details"].dataType.names]
    else:
        names = list(detector.details)
    extra = []  # the names below are fixed values: readers of result files look for them
    if spec.window.kind != NONE:
        extra = [
            F.col("packets_in_window").cast("string").alias("packets_in_window"),
            F.lit("incremental" if detector.feature_based else "buffered").alias("aggregation_mode"),
            now.cast("string").alias("processing_timestamp"),
        ]
        if spec.window.counted or detector.feature_based:
            extra.append(F.lit(spec.window.family).alias("window_type"))
        if not spec.window.counted:
            extra += [
                F.col("window_start").cast("string").alias("flink_window_start"),
                F.col("window_end").cast("string").alias("flink_window_end"),
            ]
    return [
        F.lit(detector.name).alias("algorithm"), F.col("flow_key").alias("flow_id"), now.alias("result_ts"),
        F.struct(*names, *extra).alias("details"),
    ]


def dead_letters(scored: DataFrame, w: FlowWindow) -> DataFrame:
    """``error, flow_key`` and ``window_start`` or ``window_type`` of the windows that failed."""
    return scored.where(F.col("error").isNotNull()).select(*letter_columns(w))


def letter_columns(w: FlowWindow) -> list[Column]:
    place = F.lit(w.family).alias("window_type") if w.counted else F.col("window_start")
    return [F.col("error"), F.col("flow_key"), place]
