"""Packet records of a topic: ``int32 link type | int64 time in ms | raw bytes``, big-endian."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.octets import read_int32, read_int64, write_int32, write_int64

HEADER_BYTES = 12

# Arrival position of a record: offsets below 2**40 within up to 2**23 topic partitions
_OFFSET_BITS = 40


def arrival_position(partition: Column, offset: Column) -> Column:
    """One ascending number from topic partition and offset; fails where an offset does not fit."""
    fits = (offset >= 0) & (offset < 1 << _OFFSET_BITS)
    checked = F.when(fits, offset).when(offset.isNotNull(), F.raise_error(F.lit("offset beyond 2^40")).cast("bigint"))
    return F.shiftleft(partition.cast("bigint"), _OFFSET_BITS) + checked


def partition_of(position: Column) -> Column:
    """The topic partition in an arrival position."""
    return F.shiftright(position, _OFFSET_BITS).cast("int")


def decodable(value: Column) -> Column:
    """Records shorter than their header, and missing ones, are not packets."""
    return F.coalesce(F.length(value) >= HEADER_BYTES, F.lit(False))


def decode(records: DataFrame, value: str = "value") -> DataFrame:
    """Adds ``dlt, ts_ms, raw``; undecodable records are dropped."""
    v = F.col(value)
    return records.where(decodable(v)).withColumns(
        {
            "dlt": read_int32(v, 0),
            "ts_ms": read_int64(v, 4),
            "raw": F.substring(v, F.lit(HEADER_BYTES + 1), F.length(v)),
        }
    )


def encode(packets: DataFrame, name: str = "value") -> DataFrame:
    """Adds the record built from ``dlt, ts_ms, raw``."""
    return packets.withColumn(name, F.concat(write_int32(F.col("dlt")), write_int64(F.col("ts_ms")), F.col("raw")))
