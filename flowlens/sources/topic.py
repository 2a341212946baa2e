"""Packet topics: bounded and unbounded reads, and their profile.

A topic is anything with the columns of Spark's Kafka source. Where the Kafka
connector is not installed, a folder of parquet files with those columns takes
its place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.headers import with_headers
from ..operators.ordering import DEFAULT_POLICY, SlicePolicy, with_row_number
from .wire import arrival_position, decode, encode

TOPIC_SCHEMA = "key string, value binary, topic string, partition int, offset bigint, timestamp timestamp"


def read_topic(spark: SparkSession, path: str) -> DataFrame:
    """All records written so far (bounded)."""
    return spark.read.schema(TOPIC_SCHEMA).parquet(path)


def stream_topic(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Records from the earliest on, and new ones as they come."""
    reader = spark.readStream.schema(TOPIC_SCHEMA)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def read_kafka(spark: SparkSession, brokers: str, topic: str, **options: str) -> DataFrame:
    """Earliest to latest offsets of a Kafka topic; needs the Kafka connector on the classpath."""
    reader = spark.read.format("kafka").option("kafka.bootstrap.servers", brokers).option("subscribe", topic)
    bounded = reader.option("startingOffsets", "earliest").option("endingOffsets", "latest")
    return bounded.options(**options).load().withColumn("key", F.col("key").cast("string"))


def stream_kafka(
    spark: SparkSession, brokers: str, topic: str, max_records: int | None = None, **options: str
) -> DataFrame:
    """Unbounded read from the earliest offset; ``max_records`` limits a micro-batch."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", brokers).option("subscribe", topic)
    reader = reader.option("startingOffsets", "earliest").options(**options)
    if max_records:
        reader = reader.option("maxOffsetsPerTrigger", max_records)
    return reader.load().withColumn("key", F.col("key").cast("string"))


def topic_keyed(packets: DataFrame) -> DataFrame:
    """``key, value`` of packets with ``src_ip, dlt, ts_ms, raw``: the source address keeps a host's packets together."""
    return encode(packets).select(F.col("src_ip").alias("key"), "value")


def write_kafka(packets: DataFrame, brokers: str, topic: str, **options: str) -> None:
    """Packets to a Kafka topic by source address; needs the Kafka connector on the classpath."""
    writer = topic_keyed(packets).write.format("kafka").option("kafka.bootstrap.servers", brokers)
    writer.option("topic", topic).options(**options).save()


def write_topic(packets: DataFrame, path: str, topic: str, partitions: int = 16, policy: SlicePolicy = DEFAULT_POLICY) -> None:
    """The same into a folder with the columns of a topic; packets have ``seq``, the order in which they are sent.

    Packets without a source address are spread, as Kafka does with records that have no key.
    """
    place = F.pmod(F.coalesce(F.xxhash64("src_ip"), F.lit(0)) + F.when(F.col("src_ip").isNull(), F.col("seq")).otherwise(0), F.lit(partitions))
    records = encode(packets.withColumn("partition", place.cast("int")))
    numbered = with_row_number(records, ["partition"], ["seq"], policy, name="offset")
    numbered.select(
        F.col("src_ip").alias("key"), "value", F.lit(topic).alias("topic"), "partition", (F.col("offset") - 1).alias("offset"),
        F.timestamp_millis("ts_ms").alias("timestamp"),
    ).write.mode("append").parquet(path)


def packets(records: DataFrame) -> DataFrame:
    """Decoded records with header columns and ``seq``, their arrival position."""
    decoded = decode(records).withColumn("seq", arrival_position(F.col("partition"), F.col("offset")))
    return with_headers(decoded)


def profile(records: DataFrame) -> DataFrame:
    """Offsets and message counts per partition, with a total per topic (null partition).

    Offsets are those of the records read. Partitions are counted first, so the
    total is made from one row per partition.
    """
    parts = records.groupBy("topic", "partition").agg(
        F.min("offset").alias("begin_offset"), (F.max("offset") + 1).alias("end_offset")
    )
    parts = parts.withColumn("messages", F.col("end_offset") - F.col("begin_offset"))
    totals = parts.groupBy("topic").agg(F.sum("messages").alias("messages")).select(
        "topic",
        F.lit(None).cast("int").alias("partition"),
        F.lit(None).cast("bigint").alias("begin_offset"),
        F.lit(None).cast("bigint").alias("end_offset"),
        "messages",
    )
    return parts.unionByName(totals)
