"""Packet header fields as Catalyst expressions over the raw bytes.

Every field is null when the bytes for it are missing, so a damaged frame
never fails a job. Fields that a query does not read are pruned together with
their expressions, and the raw bytes never reach a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .octets import digits_at, uint_in

# Link types, ethertypes and protocol numbers of the public registries
DLT_ETHERNET = 1
DLT_LINUX_SLL = 113
ETHERTYPE_IPV4 = 0x0800
ETHERTYPE_IPV6 = 0x86DD
ETHERTYPE_VLAN = 0x8100
ETHERTYPE_QINQ = 0x88A8
PROTO_TCP = 6
PROTO_UDP = 17
#: Protocols in the order of their numbers, from 0; "-" stands for numbers without a keyword.
PROTOCOL_NAMES = """
HOPOPT ICMPv4 IGMP GGP IPv4 ST TCP CBT EGP IGP BBN-RCC-MON NVP-II PUP ARGUS EMCON XNET CHAOS UDP MUX DCN-MEAS HMP PRM
XNS-IDP TRUNK-1 TRUNK-2 LEAF-1 LEAF-2 RDP IRTP ISO-TP4 NETBLT MFE-NSP MERIT-INP DCCP 3PC IDPR XTP DDP IDPR-CMTP TP++ IL
IPv6 SDRP IPv6-Route IPv6-Frag IDRP RSVP GRE DSR BNA ESP AH I-NLSP SWIPE NARP MOBILE TLSP SKIP ICMPv6 IPv6-NoNxt
IPv6-Opts - CFTP - SAT-EXPAK KRYPTOLAN RVD IPPC - SAT-MON VISA IPCV CPNX CPHB WSN PVP BR-SAT-MON SUN-ND WB-MON WB-EXPAK
ISO-IP VMTP SECURE-VMTP VINES IPTM NSFNET-IGP DGP TCF EIGRP OSPFIGP Sprite-RPC LARP MTP AX.25 IPIP MICP SCC-SP ETHERIP
ENCAP - GMTP IFMP PNNI PIM ARIS SCPS QNX A/N IPComp SNP Compaq-Peer IPX-in-IP VRRP PGM - L2TP DDX IATP STP SRP UTI SMP SM
PTP ISIS-over-IPv4 FIRE CRTP CRUDP SSCOPMCE IPLT SPS PIPE SCTP FC RSVP-E2E-IGNORE Mobility-Header UDPLite MPLS-in-IP manet
HIP Shim6 WESP ROHC Ethernet AGGFRAG NSH
""".split()
UNKNOWN_PROTOCOL = "unknown"
IPV6_FRAGMENT = 44
IPV6_SKIPPABLE = (0, 43, 51, 60)  # hop-by-hop, routing, authentication, destination options
IPV6_AUTHENTICATION = 51
MIN_TCP = 20
MIN_UDP = 8

PARSED = "parsed"
HEADER_COLUMNS = (
    "ip_version", "src_ip", "dst_ip", "proto", "src_port", "dst_port", "ttl", "total_len",
)


def protocol_name(number: Column) -> Column:
    names = F.array(*[F.lit(UNKNOWN_PROTOCOL if name == "-" else name) for name in PROTOCOL_NAMES])
    return F.when(number.isNotNull(), F.coalesce(F.get(names, number), F.lit(UNKNOWN_PROTOCOL)))


def ipv4_text(raw: Column, offset: int) -> Column:
    return F.concat_ws(".", *[digits_at(raw, offset + i, 1) for i in range(4)])


def ipv6_text(raw: Column, offset: int) -> Column:
    """Eight lower-case groups without leading zeros and without ``::`` compression."""
    groups = [digits_at(raw, offset + 2 * i, 2, base=16) for i in range(8)]
    return F.lower(F.concat_ws(":", *groups))


def _after(raw: Column, offset: int | Column) -> Column:
    at = F.lit(offset) if isinstance(offset, int) else offset
    return F.substring(raw, at + F.lit(1), F.length(raw))


def _steps(data: Column, size: int) -> Column:
    """As many numbers as headers of ``size`` bytes can follow each other in ``data``."""
    return F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor(F.length(data) / size).cast("int")))


def _network_packet(raw: Column, link: Column) -> Column:
    """Struct of the ethertype and the bytes from the IP header on; VLAN tags are skipped, however many."""
    def tagged(at: int | Column) -> Column:
        return uint_in(raw, at, 2).isin(ETHERTYPE_VLAN, ETHERTYPE_QINQ)

    def from_type(at: int) -> Column:
        behind = F.aggregate(_steps(raw, 4), F.lit(at), lambda a, _: F.when(tagged(a), a + 4).otherwise(a))
        place = F.when(tagged(at), behind).otherwise(F.lit(at))
        return F.struct(uint_in(raw, place, 2).alias("type"), _after(raw, place + 2).alias("ip"))

    return F.when(link == DLT_ETHERNET, from_type(12)).when(link == DLT_LINUX_SLL, from_type(14))


def _past_extensions(up: Column, load: Column) -> Column:
    """Protocol and payload behind a chain of IPv6 extension headers; a chain that is cut short ends in nulls."""
    def step(state: Column, _: Column) -> Column:
        size = uint_in(state["load"], 1, 1)
        jump = F.when(state["up"] == IPV6_AUTHENTICATION, (size + 2) * 4).otherwise((size + 1) * 8)
        inner = F.struct(uint_in(state["load"], 0, 1).alias("up"), _after(state["load"], jump).alias("load"))
        return F.when(state["up"].isin(*IPV6_SKIPPABLE), inner).otherwise(state)

    return F.aggregate(_steps(load, 8), F.struct(up.alias("up"), load.alias("load")), step)


def _declared(ip: Column, length: Column, header: Column | int) -> Column:
    """The bytes after a header, without what follows the declared packet length (padding)."""
    head = F.lit(header) if isinstance(header, int) else header
    return F.substring(ip, head + F.lit(1), F.greatest(length - head, F.lit(0)))


def with_headers(df: DataFrame, raw: str = "raw", dlt: str = "dlt") -> DataFrame:
    """Adds :data:`HEADER_COLUMNS` to a frame that has raw bytes and their link type, and ``parsed``.

    A packet without any bytes is not ``parsed``. One that is cut inside its headers
    is: it lacks only the fields behind the cut.

    The frame is cut once into its layers. ``inline`` keeps that step apart:
    a filter on a header field is evaluated above it and does not repeat the
    cutting, and fields nobody reads are still pruned.
    """
    kept = df.columns
    df = df.withColumn("_net", _network_packet(F.col(raw), F.col(dlt)))
    ip, kind = F.col("_net.ip"), F.col("_net.type")

    # Network layer: protocol number and payload of whole headers
    first = uint_in(ip, 0, 1)
    head4 = F.pmod(first, F.lit(16)) * 4
    size4 = uint_in(ip, 2, 2)
    is4 = (kind == ETHERTYPE_IPV4) & (F.shiftright(first, 4) == 4) & (head4 >= 20) & (F.length(ip) >= head4)
    is6 = (kind == ETHERTYPE_IPV6) & (F.shiftright(first, 4) == 6) & (F.length(ip) >= 40)
    whole4 = F.pmod(uint_in(ip, 6, 2), F.lit(1 << 14)) == 0  # neither offset nor more fragments
    load4 = F.when(size4 == 0, _after(ip, head4)).otherwise(_declared(ip, size4, head4))
    payload = F.when(
        is4, F.struct(F.lit(4).alias("version"), uint_in(ip, 9, 1).alias("up"), F.when(whole4, load4).alias("load"))
    ).when(
        is6,
        F.struct(
            F.lit(6).alias("version"), uint_in(ip, 6, 1).alias("up"),
            _declared(ip, uint_in(ip, 4, 2) + 40, 40).alias("load"),
        ),
    )
    df = df.withColumn("_load", payload)

    # IPv6 extension headers: (next header, length, ...), one after the other
    df = df.withColumns({"_version": F.col("_load.version"), "_next": F.col("_load.up")})
    up, load = F.col("_load.up"), F.col("_load.load")
    chained = (F.col("_version") == 6) & up.isin(*IPV6_SKIPPABLE)
    plain = F.struct(up.alias("up"), load.alias("load"))
    df = df.withColumn("_load", F.when(chained, _past_extensions(up, load)).otherwise(plain))

    # Transport layer: only whole TCP and UDP headers count
    up, load = F.col("_load.up"), F.col("_load.load")
    whole = ((up == PROTO_TCP) & (F.length(load) >= MIN_TCP)) | ((up == PROTO_UDP) & (F.length(load) >= MIN_UDP))
    layers = F.struct(
        F.col("_version").alias("ip_version"), F.col("_next").alias("_next"),
        F.when(F.col("_version").isNotNull(), ip).alias("_ip"), F.when(whole, load).alias("_segment"),
    )
    df = df.select(*kept, F.inline(F.array(layers)))

    is4, is6 = F.col("ip_version") == 4, F.col("ip_version") == 6
    ip, segment = F.col("_ip"), F.col("_segment")
    return df.select(
        *kept,
        F.coalesce(F.length(F.col(raw)) > 0, F.lit(False)).alias(PARSED),
        "ip_version",
        F.when(is4, ipv4_text(ip, 12)).when(is6, ipv6_text(ip, 8)).alias("src_ip"),
        F.when(is4, ipv4_text(ip, 16)).when(is6, ipv6_text(ip, 24)).alias("dst_ip"),
        protocol_name(F.col("_next")).alias("proto"),
        uint_in(segment, 0, 2).alias("src_port"),
        uint_in(segment, 2, 2).alias("dst_port"),
        F.when(is4, uint_in(ip, 8, 1)).when(is6, uint_in(ip, 7, 1)).alias("ttl"),
        F.when(is4, uint_in(ip, 2, 2)).when(is6, uint_in(ip, 4, 2) + 40).alias("total_len"),
    )
