"""Golden values of the byte, header, key and code functions."""

import pytest
from pyspark.sql import functions as F

from flowlens.functions.features import typed_value
from flowlens.functions.gzip import compressor, gzip_size
from flowlens.functions.headers import PROTOCOL_NAMES, with_headers
from flowlens.functions.iat import iat_code, iat_code_ms, valid_iat
from flowlens.functions.keys import default_key, five_tuple_key, guide_key, legacy_key, with_flow_key
from flowlens.functions.octets import read_int32, read_int64, write_int32, write_int64
from flowlens.sources import filters
from flowlens.sources.wire import arrival_position, decode, encode

RECORD = (
    "000000010000018CC251F47BAABBCCDDEEFF11223344556608004500002800010000400600000A0000010A000002"
    "1388005000000000000000005002000000000000"
)
ETHERNET = "AABBCCDDEEFF112233445566"
TCP = "1388005000000000000000005002000000000000"
UDP = "0035123400080000"


def frame(spark, *hex_and_link):
    rows = [(i, bytearray.fromhex(h), link) for i, (h, link) in enumerate(hex_and_link)]
    return spark.createDataFrame(rows, "id int, raw binary, dlt int")


def ipv4(payload, proto=6, flags="0000", total=None, ihl=5, options=""):
    size = total if total is not None else ihl * 4 + len(payload) // 2
    return f"4{ihl:X}00{size:04X}0001{flags}40{proto:02X}00000A0000010A000002{options}{payload}"


def ipv6(payload, following=6):
    return f"60000000{len(payload) // 2:04X}{following:02X}40" + "0" * 31 + "1" + "FE80" + "0" * 27 + "A" + payload


def test_wire_record(spark):
    df = spark.createDataFrame([(bytearray.fromhex(RECORD),)], "value binary")
    packet = decode(df)
    row = packet.select("dlt", "ts_ms", F.length("raw").alias("n")).first()
    assert tuple(row) == (1, 1704067200123, 54)
    again = encode(packet.select("dlt", "ts_ms", "raw")).select(F.hex("value")).first()[0]
    assert again == RECORD
    keyed = with_headers(packet).select(default_key(), five_tuple_key(), guide_key(), legacy_key()).first()
    assert tuple(keyed) == (
        "10.0.0.1->10.0.0.2", "10.0.0.1:5000->10.0.0.2:80|TCP", "10.0.0.1:5000-10.0.0.2:80-TCP",
        "10.0.0.1:5000->10.0.0.2:80(TCP)",
    )


def test_record_lengths(spark):
    values = [None, b"", b"\0" * 4, b"\0" * 11, b"\0" * 12, b"\0" * 13]
    df = spark.createDataFrame([(v if v is None else bytearray(v),) for v in values], "value binary")
    assert sorted(r.n for r in decode(df).select(F.length("raw").alias("n")).collect()) == [0, 1]


@pytest.mark.parametrize("number", [0, 1, -1, 2**31 - 1, -(2**31), 123456789])
def test_int32(spark, number):
    df = spark.createDataFrame([(number,)], "n int").select(write_int32(F.col("n")).alias("b"))
    assert bytes(df.first()[0]) == number.to_bytes(4, "big", signed=True)
    assert df.select(read_int32(F.col("b"), 0)).first()[0] == number


@pytest.mark.parametrize("number", [0, 1, -1, 2**63 - 1, -(2**63), 1704067200123, -5_000_000_000])
def test_int64(spark, number):
    df = spark.createDataFrame([(number,)], "n bigint").select(write_int64(F.col("n")).alias("b"))
    assert bytes(df.first()[0]) == number.to_bytes(8, "big", signed=True)
    assert df.select(read_int64(F.col("b"), 0)).first()[0] == number


def test_headers(spark):
    hop = "0600" + "000000000000"  # extension header: next is TCP, 8 bytes
    cases = [
        (ETHERNET + "0800" + ipv4(TCP), 1),
        (ETHERNET + "8100000A" + "0800" + ipv4(UDP, 17), 1),
        (ETHERNET + "88A8000A" + "8100000B" + "0800" + ipv4(TCP), 1),
        ("00" * 14 + "0800" + ipv4(TCP), 113),
        (ETHERNET + "0800" + ipv4(TCP, ihl=6, options="01010101"), 1),
        (ETHERNET + "0800" + ipv4(TCP, flags="2000"), 1),  # first fragment
        (ETHERNET + "0800" + ipv4(TCP, flags="4000"), 1),  # "do not fragment" is no fragment
        (ETHERNET + "0800" + ipv4("0800000000000000", 1), 1),
        (ETHERNET + "86DD" + ipv6(TCP), 1),
        (ETHERNET + "86DD" + ipv6(hop + TCP, 0), 1),
        (ETHERNET + "0806" + "00" * 28, 1),
        (ETHERNET + "0800" + ipv4(TCP)[:30], 1),  # cut inside the IP header
        (ETHERNET + "0800" + ipv4(TCP)[:60], 1),  # cut inside the TCP header
        ("", 1),
        (ETHERNET + "0800" + ipv4(TCP), 105),  # other link type
        (ETHERNET + "0800" + ipv4(UDP + "00" * 12, 17, total=28), 1),  # padded frame
        (ETHERNET + "0800" + ipv4(TCP, total=24), 1),  # declared too short for TCP
    ]
    rows = with_headers(frame(spark, *cases)).orderBy("id").select(
        "ip_version", "src_ip", "proto", "src_port", "dst_port"
    ).collect()
    host = "10.0.0.1"
    assert [tuple(r) for r in rows] == [
        (4, host, "TCP", 5000, 80), (4, host, "UDP", 53, 4660), (4, host, "TCP", 5000, 80),
        (4, host, "TCP", 5000, 80), (4, host, "TCP", 5000, 80), (4, host, "TCP", None, None),
        (4, host, "TCP", 5000, 80), (4, host, "ICMPv4", None, None),
        (6, "0:0:0:0:0:0:0:1", "TCP", 5000, 80), (6, "0:0:0:0:0:0:0:1", "HOPOPT", 5000, 80),
        (None,) * 5, (None,) * 5, (4, host, "TCP", None, None), (None,) * 5, (None,) * 5,
        (4, host, "UDP", 53, 4660), (4, host, "TCP", None, None),
    ]


def test_long_header_chains(spark):
    tags = "8100000A" * 5
    def extension(following, kind):  # authentication counts its length in 4-byte words
        return f"{following:02X}" + ("04" if kind == 51 else "00") + "00" * (22 if kind == 51 else 6)
    chain = extension(60, 0) + extension(51, 60) + extension(43, 51) + extension(60, 43) + extension(60, 60) + extension(6, 60)
    rows = with_headers(frame(
        spark, (ETHERNET + tags + "0800" + ipv4(TCP), 1), (ETHERNET + "86DD" + ipv6(chain + TCP, 0), 1),
        (ETHERNET + "86DD" + ipv6("00", 0), 1), (ETHERNET + "8100000A" * 300 + "0800" + ipv4(UDP, 17), 1),
    )).orderBy("id").select("ip_version", "src_port", "dst_port").collect()
    assert [tuple(r) for r in rows] == [(4, 5000, 80), (6, 5000, 80), (6, None, None), (4, 53, 4660)]


def test_flows_of_rarer_protocols_and_empty_frames(spark):
    numbers = (47, 50, 89, 132, 200)
    df = with_headers(frame(spark, *[(ETHERNET + "0800" + ipv4("0" * 16, n), 1) for n in numbers], ("", 1), (ETHERNET[:8], 1)))
    keys = [r[0] for r in with_flow_key(df, "five_tuple").orderBy("id").select("flow_key").collect()]
    assert [k.rpartition("|")[2] for k in keys[:5]] == ["GRE", "ESP", "OSPFIGP", "SCTP", "unknown"]
    assert [r[0] for r in with_flow_key(df).orderBy("id").select("flow_key").collect()][5:] == ["null", "Unknown"]
    assert PROTOCOL_NAMES[6] == "TCP" and PROTOCOL_NAMES[58] == "ICMPv6" and PROTOCOL_NAMES[142] == "ROHC"


def test_offsets_that_do_not_fit_are_refused(spark):
    def position(offset):
        row = spark.createDataFrame([(1, offset)], "p int, o bigint")
        return row.select(arrival_position(F.col("p"), F.col("o"))).collect()[0][0]

    assert position(5) == (1 << 40) + 5
    with pytest.raises(Exception, match="2\\^40"):
        position(2**40)


def test_keys_of_other_packets(spark):
    df = with_headers(frame(spark, (ETHERNET + "0806" + "00" * 28, 1), (ETHERNET + "0800" + ipv4("08" + "0" * 14, 1), 1)))
    keys = df.orderBy("id").select(default_key(), five_tuple_key(), guide_key()).collect()
    assert tuple(keys[0]) == ("Unknown", "unknown", "unknown")
    assert tuple(keys[1]) == ("10.0.0.1->10.0.0.2", "10.0.0.1:0->10.0.0.2:0|ICMPv4", "10.0.0.1-10.0.0.2-ICMPv4")
    assert with_flow_key(df, F.lit(None)).select("flow_key").first()[0] == "null"
    assert df.limit(1).select(default_key(F.lit(False))).first()[0] == "null"


CODES = {  # gap in ms: codes at precision 1, 2, 3
    1: ("A1", "A10", "A100"), 9: ("A9", "A90", "A900"), 10: ("X1", "X10", "X100"), 19: ("X2", "X19", "X190"),
    57: ("X6", "X57", "X570"), 95: ("1", "X95", "X950"), 99: ("1", "X99", "X990"), 100: ("1", "10", "100"),
    105: ("1", "11", "105"), 150: ("2", "15", "150"), 994: ("1", "99", "994"), 995: ("1", "10", "995"),
    1000: ("1", "10", "100"), 1500: ("1", "15", "150"), 5000: ("5", "50", "500"), 50000: ("50", "500", "5000"),
}


def test_iat_codes(spark):
    df = spark.createDataFrame([(k,) for k in CODES], "ms bigint")
    rows = df.select("ms", *[iat_code_ms(F.col("ms"), p) for p in (1, 2, 3)], iat_code(F.col("ms") / 1000.0, 2)).collect()
    assert {r[0]: tuple(r)[1:4] for r in rows} == CODES
    assert all(r[4] == r[2] for r in rows)
    traps = spark.createDataFrame([(145,), (285,), (565,), (575,), (0,), (-5,)], "ms bigint")
    assert [r[0] for r in traps.select(iat_code_ms(F.col("ms"), 2)).collect()] == ["14", "28", "56", "57", "Z", "Z"]
    tiny = spark.createDataFrame([(1e-5,), (1e-30,)], "s double")
    assert [r[0] for r in tiny.select(iat_code(F.col("s"), 2)).collect()] == ["C10", "Z"]
    with pytest.raises(ValueError):
        iat_code(F.col("ms"), 12)


def test_iat_filter(spark):
    df = spark.createDataFrame([(0,), (1,), (1000,), (1001,), (-4,)], "ms bigint")
    assert [r.ms for r in df.where(valid_iat(F.col("ms"), 1000.0)).collect()] == [1, 1000]


def test_gzip_lengths():
    assert [gzip_size(t) for t in ("10" * 127, "X50" * 127, "", "A10X2030")] == [25, 27, 20, 28]


def test_gzip_in_pieces_equals_gzip_at_once():
    text = "".join(f"X{i * i % 97}" for i in range(200_000))
    for step in (1, 7, 1000, 65_537):
        c = compressor()
        size = sum(len(c.compress(text[i : i + step].encode())) for i in range(0, len(text), step))
        assert size + len(c.flush()) == gzip_size(text)


def test_typed_values(spark):
    df = spark.createDataFrame([('{"i": 7, "d": 5.5, "s": "7", "b": true}',), ("{}",)], "j string")
    v = F.parse_json("j")
    row = df.select(
        typed_value(v, "i", "int", -1), typed_value(v, "s", "int", -1), typed_value(v, "d", "double", 0.0),
        typed_value(v, "i", "double", 0.5), typed_value(v, "s", "string", "x"), typed_value(v, "i", "string", "x"),
    ).collect()
    assert tuple(row[0]) == (7, -1, 5.5, 0.5, "7", "x")
    assert tuple(row[1]) == (-1, -1, 0.0, 0.5, "x", "x")


def test_filters(spark):
    df = with_headers(
        frame(
            spark, (ETHERNET + "0800" + ipv4(TCP), 1), (ETHERNET + "0800" + ipv4(UDP, 17), 1),
            (ETHERNET + "86DD" + ipv6(TCP), 1), (ETHERNET + "0806" + "00" * 28, 1),
        )
    )

    def kept(condition):
        return [r.id for r in filters.capture(df, condition).orderBy("id").collect()]

    assert kept(None) == [0, 1, 2, 3]
    assert kept(filters.proto("tcp") & filters.port(80)) == [0, 2]
    assert kept(filters.proto("ip") & ~filters.proto("udp")) == [0]
    assert kept(~filters.host("10.0.0.1")) == [2, 3]
    assert kept(filters.src_port(53) | filters.proto("ip6")) == [1, 2]
