"""Flow keys. A flow is the set of packets whose key is equal.

Each key is a column expression over the header columns, so it is evaluated
before the shuffle and the raw bytes are pruned with it. Any other
deterministic column can serve as a key just as well.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .headers import PARSED

# Keys of packets without the header a key needs
UNPARSED_KEY = "null"
NO_IP_KEY = "Unknown"
NO_FLOW_KEY = "unknown"


def default_key(parsed: Column | None = None) -> Column:
    """``src->dst``; packets without an IP header share one key, undecodable ones another."""
    hosts = F.concat(F.col("src_ip"), F.lit("->"), F.col("dst_ip"))
    key = F.coalesce(hosts, F.lit(NO_IP_KEY))
    return key if parsed is None else F.when(parsed, key).otherwise(F.lit(UNPARSED_KEY))


def five_tuple_key() -> Column:
    """``src:sport->dst:dport|PROTO``, ports 0 where the packet has none."""
    def end(ip: str, port: str) -> Column:
        return F.concat(F.col(ip), F.lit(":"), F.coalesce(F.col(port), F.lit(0)).cast("string"))

    key = F.concat(end("src_ip", "src_port"), F.lit("->"), end("dst_ip", "dst_port"), F.lit("|"), F.col("proto"))
    return F.coalesce(key, F.lit(NO_FLOW_KEY))


def guide_key() -> Column:
    """``src:sport-dst:dport-PROTO`` for IPv4 with ports, ``src-dst-PROTO`` for other IPv4."""
    src, dst, proto = F.col("src_ip"), F.col("dst_ip"), F.col("proto")
    sport, dport = F.col("src_port").cast("string"), F.col("dst_port").cast("string")
    full = F.concat(src, F.lit(":"), sport, F.lit("-"), dst, F.lit(":"), dport, F.lit("-"), proto)
    short = F.concat_ws("-", src, dst, proto)
    return F.when(F.col("ip_version") == 4, F.coalesce(full, short)).otherwise(F.lit(NO_FLOW_KEY))


def legacy_key() -> Column:
    """``src:sport->dst:dport(PROTO)`` of the flat packet record."""
    return F.format_string(
        "%s:%d->%s:%d(%s)",
        F.col("src_ip"),
        F.coalesce(F.col("src_port"), F.lit(0)),
        F.col("dst_ip"),
        F.coalesce(F.col("dst_port"), F.lit(0)),
        F.col("proto"),
    )


KEYS: dict[str, Callable[[], Column]] = {
    "default": default_key,
    "five_tuple": five_tuple_key,
    "guide": guide_key,
    "legacy": legacy_key,
}


def with_flow_key(df: DataFrame, key: Column | str = "default") -> DataFrame:
    """Adds ``flow_key`` from a named key or from any column; null keys become one named flow.

    Packets that ``with_headers`` could not read share the flow ``null`` under the default key.
    """
    if isinstance(key, str):
        readable = F.col(PARSED) if PARSED in df.columns else None
        expr = default_key(readable) if key == "default" else KEYS[key]()
    else:
        expr = key
    return df.withColumn("flow_key", F.coalesce(expr.cast("string"), F.lit(UNPARSED_KEY)))
