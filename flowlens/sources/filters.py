"""Capture filters: predicates over the header columns, combined with ``& | ~``.

``proto("tcp") & port(443)`` keeps what the capture expression ``tcp and port 443`` keeps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Protocol names of capture expressions
_PROTOCOLS = {"tcp": "TCP", "udp": "UDP", "icmp": "ICMPv4", "icmp6": "ICMPv6"}
_VERSIONS = {"ip": 4, "ip6": 6}


def _true(condition: Column) -> Column:
    """A missing header field means "no match", also under ``~``."""
    return F.coalesce(condition, F.lit(False))


def proto(name: str) -> Column:
    if name in _VERSIONS:
        return _true(F.col("ip_version") == _VERSIONS[name])
    return _true(F.col("proto") == _PROTOCOLS[name])


def src_host(ip: str) -> Column:
    return _true(F.col("src_ip") == ip)


def dst_host(ip: str) -> Column:
    return _true(F.col("dst_ip") == ip)


def host(ip: str) -> Column:
    return src_host(ip) | dst_host(ip)


def src_port(number: int) -> Column:
    return _true(F.col("src_port") == number)


def dst_port(number: int) -> Column:
    return _true(F.col("dst_port") == number)


def port(number: int) -> Column:
    return src_port(number) | dst_port(number)


def capture(packets: DataFrame, condition: Column | None = None) -> DataFrame:
    """Packets that match; no condition keeps all."""
    return packets if condition is None else packets.where(condition)
