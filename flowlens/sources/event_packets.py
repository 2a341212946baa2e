"""Packets derived from the ``events`` test table, one per event.

Every event becomes a frame with real header bytes, so that the byte-level
operators can be checked against the columns the bytes were made from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .wire import encode

TOPIC = "network-flows"
PARTITIONS = 4

# Event type to destination and protocol number
IPV4_TARGETS = {"click": (1, 6), "view": (2, 17), "purchase": (3, 6), "error": (4, 1)}
IPV6_TYPE = "signup"
_MACS = "AABBCCDDEEFF112233445566"


def load_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _port() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def flat_packets(events: DataFrame) -> DataFrame:
    """Header columns straight from the events: what parsing the frames has to give."""
    kind, arp = F.col("event_type"), F.col("event_id") % 97 == 0

    def part(shift: int, size: int) -> Column:
        return F.pmod(F.shiftright("user_id", shift), F.lit(size))

    ip6 = kind == IPV6_TYPE
    number = F.when(ip6, 6)
    target = F.lit(None).cast("int")
    for name, (host, code) in IPV4_TARGETS.items():
        number = number.when(kind == name, code)
        target = F.when(kind == name, host).otherwise(target)
    has_ports = ~arp & number.isin(6, 17)
    v4_src = F.concat_ws(".", F.lit("10"), *[part(shift, 256).cast("string") for shift in (16, 8, 0)])
    v6_src = F.concat_ws(":", F.lit("fd00:0:0:0:0:0"), *[F.lower(F.hex(part(s, 65536))) for s in (16, 0)])
    names = F.when(number == 6, "TCP").when(number == 17, "UDP").when(number == 1, "ICMPv4")
    return events.select(
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"),
        F.col("event_id").alias("seq"),
        "event_id", "user_id", "event_type", "value",
        (F.col("user_id") % PARTITIONS).cast("int").alias("partition"),
        F.when(~arp, F.when(ip6, 6).otherwise(4)).alias("ip_version"),
        F.when(~arp, F.when(ip6, v6_src).otherwise(v4_src)).alias("src_ip"),
        F.when(
            ~arp,
            F.when(ip6, F.lit("fd00:0:0:0:0:0:0:5")).otherwise(F.concat(F.lit("10.1.0."), target.cast("string"))),
        ).alias("dst_ip"),
        F.when(~arp, names).alias("proto"),
        F.when(~arp, number).alias("proto_number"),
        target.alias("target"),
        F.when(has_ports, (1024 + F.col("event_id") % 50000).cast("int")).alias("src_port"),
        F.when(has_ports, _port()).alias("dst_port"),
        F.when(~arp, (32 + F.col("event_id") % 32).cast("int")).alias("ttl"),
    )


def raw_packets(events: DataFrame) -> DataFrame:
    """``dlt, ts_ms, raw`` and arrival columns, with the frame bytes of each event."""
    p = flat_packets(events)

    number, user = F.col("proto_number"), F.col("user_id")

    def hexed(value: Column | str, size: int) -> Column:
        return F.lpad(F.hex(value), 2 * size, "0")

    def joined(*parts: Column | str) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    room = F.when(number == 6, 20).otherwise(8)
    ports = joined(hexed("src_port", 2), hexed("dst_port", 2))
    transport = (
        F.when(number == 6, joined(ports, "00000000000000005002000000000000"))
        .when(number == 17, joined(ports, "00080000"))
        .otherwise("0800000000000000")
    )
    v4 = joined(
        _MACS + "0800" + "4500", hexed(20 + room, 2), "00010000", hexed("ttl", 1), hexed(number, 1), "00000A",
        hexed(F.pmod(user, F.lit(1 << 24)), 3), "0A0100", hexed("target", 1), transport,
    )
    v6 = joined(
        _MACS + "86DD" + "60000000", hexed(room, 2), hexed(number, 1), hexed("ttl", 1), "FD00" + "00" * 10,
        hexed(F.pmod(user, F.lit(1 << 32)), 4), "FD00" + "00" * 13 + "05", transport,
    )
    arp = F.lit(_MACS + "0806" + "0001080006040001" + "00" * 20)
    raw = F.unhex(F.when(F.col("ip_version") == 4, v4).when(F.col("ip_version") == 6, v6).otherwise(arp))
    return p.select("event_id", "partition", "seq", "src_ip", F.lit(1).alias("dlt"), "ts_ms", raw.alias("raw"))


def topic_records(events: DataFrame) -> DataFrame:
    """Topic records of the events; every 101st one is cut short and cannot be decoded.

    ``inline`` keeps later filters above the step that builds the frames, which
    they would otherwise repeat.
    """
    value = F.when(F.col("event_id") % 101 == 0, F.substring("value", 1, 8)).otherwise(F.col("value"))
    record = F.struct(
        F.col("src_ip").alias("key"),
        value.alias("value"),
        F.lit(TOPIC).alias("topic"),
        "partition",
        F.col("event_id").alias("offset"),
        F.timestamp_millis("ts_ms").alias("timestamp"),
    )
    return encode(raw_packets(events)).select(F.inline(F.array(record)))
