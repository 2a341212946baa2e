"""Capture files written here byte by byte, read back in one piece and in splits."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from flowlens.functions.headers import with_headers
from flowlens.operators.ingest import limit_packets
from flowlens.sources.pcap import read_captures, with_packet_numbers
from flowlens.sources.wire import decode, encode

FRAME = bytes.fromhex(
    "AABBCCDDEEFF11223344556608004500002800010000400600000A0000010A0000021388005000000000000000005002000000000000"
)


def classic(packets, order="<", nano=False):
    magic = 0xA1B23C4D if nano else 0xA1B2C3D4
    out = struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 65535, 1)
    for ts_ms, raw in packets:
        fraction = ts_ms % 1000 * (1_000_000 if nano else 1000) + 7
        out += struct.pack(order + "IIII", ts_ms // 1000, fraction, len(raw), len(raw)) + raw
    return out


def next_generation(packets, digits=None):
    """With ``digits``, times have so many decimals of a second."""

    def block(kind, body):
        body += b"\0" * (-len(body) % 4)
        return struct.pack("<II", kind, len(body) + 12) + body + struct.pack("<I", len(body) + 12)

    out = block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1))
    options = b"" if digits is None else struct.pack("<HHB3xHH", 9, 1, digits, 0, 0)
    out += block(1, struct.pack("<HHI", 1, 0, 0) + options)
    for ts_ms, raw in packets:
        ticks = ts_ms * 10 ** (6 if digits is None else digits) // 1000
        out += block(6, struct.pack("<IIIII", 0, ticks >> 32, ticks & 0xFFFFFFFF, len(raw), len(raw)) + raw)
    return out


def some_packets(n, seed=1):
    rng = random.Random(seed)
    # zeros and small numbers look like record headers, which the search must not fall for
    def raw():
        body = bytes(rng.choice((0, 1, 2, rng.randrange(256))) for _ in range(rng.randrange(0, 700)))
        return FRAME + body

    return [(1_704_067_200_123 + i * 10, raw()) for i in range(n)]


def found(df):
    return [(r.ts_ms, bytes(r.raw)) for r in df.orderBy("file", "file_offset").collect()]


@pytest.mark.parametrize("order,nano", [("<", False), (">", False), ("<", True)])
def test_classic(spark, tmp_path, order, nano):
    packets = some_packets(40)
    (tmp_path / "a.pcap").write_bytes(classic(packets, order, nano))
    df = read_captures(spark, str(tmp_path / "a.pcap"))
    assert found(df) == packets
    assert {r.dlt for r in df.select("dlt").distinct().collect()} == {1}


@pytest.mark.parametrize("split", [500, 4_000, 33_333])
def test_splits_lose_and_double_nothing(spark, tmp_path, split):
    packets = some_packets(300, seed=split)
    (tmp_path / "a.pcap").write_bytes(classic(packets))
    df = read_captures(spark, str(tmp_path / "a.pcap"), split_bytes=split)
    assert df.rdd.getNumPartitions() > 2
    assert found(df) == packets


def test_folder_formats_numbers_and_limit(spark, tmp_path):
    first, second = some_packets(5), some_packets(7, seed=2)
    (tmp_path / "a.pcap").write_bytes(classic(first))
    (tmp_path / "b.pcapng").write_bytes(next_generation(second))
    (tmp_path / "c.txt").write_text("no capture")
    (tmp_path / "below").mkdir()
    (tmp_path / "below" / "d.pcap").write_bytes(classic(first))
    df = read_captures(spark, str(tmp_path))
    assert found(df) == first + second
    numbered = with_packet_numbers(df)
    assert sorted(r.packet_no for r in numbered.collect()) == sorted([*range(1, 6), *range(1, 8)])
    assert found(limit_packets(df, "file", "file_offset", 8)) == (first + second)[:8]
    assert found(limit_packets(df, "file", "file_offset")) == first + second


def test_truncated_file_and_headers(spark, tmp_path):
    packets = some_packets(3)
    (tmp_path / "a.pcap").write_bytes(classic(packets)[:-5])
    df = read_captures(spark, str(tmp_path / "a.pcap"))
    assert found(df) == packets[:2]
    row = with_headers(df).select("src_ip", "dst_port", "ttl").first()
    assert tuple(row) == ("10.0.0.1", 80, 64)
    assert decode(encode(df.select("dlt", "ts_ms", "raw"))).where(F.col("dlt") == 1).count() == 2


def test_other_files_and_damaged_blocks_are_refused(spark, tmp_path):
    (tmp_path / "a.pcap").write_bytes(b"no capture at all")
    with pytest.raises(Exception, match="neither"):
        read_captures(spark, str(tmp_path / "a.pcap")).collect()
    good = next_generation(some_packets(3))
    damaged = good[:28] + struct.pack("<II", 1, 13) + good[36:]
    (tmp_path / "b.pcapng").write_bytes(damaged)
    with pytest.raises(Exception, match="damaged"):
        read_captures(spark, str(tmp_path / "b.pcapng")).collect()


def test_obsolete_blocks_and_clock_offsets(spark, tmp_path):
    def block(kind, body):
        body += b"\0" * (-len(body) % 4)
        return struct.pack("<II", kind, len(body) + 12) + body + struct.pack("<I", len(body) + 12)

    clock = struct.pack("<HHB3x", 9, 1, 3) + struct.pack("<HHq", 14, 8, 1_700_000_000) + struct.pack("<HH", 0, 0)
    data = block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1)) + block(1, struct.pack("<HHI", 1, 0, 0) + clock)
    data += block(2, struct.pack("<HHIIII", 0, 0, 0, 1234, len(FRAME), len(FRAME)) + FRAME)
    (tmp_path / "a.pcapng").write_bytes(data)
    assert found(read_captures(spark, str(tmp_path / "a.pcapng"))) == [(1_700_000_001_234, FRAME)]


@pytest.mark.parametrize("digits", [3, 6, 9])
def test_whole_milliseconds_stay_whole(spark, tmp_path, digits):
    packets = [(1_704_067_200_000 + i, FRAME) for i in range(3000)]
    (tmp_path / "a.pcapng").write_bytes(next_generation(packets, digits))
    assert found(read_captures(spark, str(tmp_path))) == packets


def many_sections(packets, seed=3):
    """Sections of either byte order with interfaces declared late, other blocks, and captures inside packets."""
    r = random.Random(seed)
    out, order, clocks = b"", "<", []

    def block(kind, body):
        body += b"\0" * (-len(body) % 4)
        return struct.pack(order + "II", kind, len(body) + 12) + body + struct.pack(order + "I", len(body) + 12)

    for i, (ts_ms, raw) in enumerate(packets):
        if i % 90 == 0:
            order, clocks = r.choice("<>"), []
            out += block(0x0A0D0D0A, struct.pack(order + "IHHq", 0x1A2B3C4D, 1, 0, -1))
        if not clocks or r.random() < 0.04:
            digits = r.choice([3, 6, 9])
            clocks.append(digits)
            out += block(1, struct.pack(order + "HHI", len(clocks), 0, 0) + struct.pack(order + "HHB3xHH", 9, 1, digits, 0, 0))
        if r.random() < 0.1:
            out += block(0x80000001, bytes(r.randrange(60)))
        number = r.randrange(len(clocks))
        ticks = ts_ms * 10 ** clocks[number] // 1000
        out += block(6, struct.pack(order + "IIIII", number, ticks >> 32, ticks & 0xFFFFFFFF, len(raw), len(raw)) + raw)
    return out


@pytest.mark.parametrize("split", [900, 6_000, 50_000])
def test_indexed_block_files(spark, tmp_path, split):
    inner = next_generation([(1_700_000_000_000 + i, FRAME) for i in range(30)])
    packets = some_packets(300, seed=split)
    packets = [(t, inner + raw if i % 40 == 7 else raw) for i, (t, raw) in enumerate(packets)]
    (tmp_path / "a.pcapng").write_bytes(many_sections(packets))
    (tmp_path / "b.pcapng").write_bytes(next_generation(packets[:20])[:-9])  # cut inside its last block
    whole = read_captures(spark, str(tmp_path), indexed=False).orderBy("file", "file_offset").collect()
    df = read_captures(spark, str(tmp_path), split_bytes=split)
    assert df.rdd.getNumPartitions() > 2
    assert df.orderBy("file", "file_offset").collect() == whole and len(whole) == 319
    assert [(r.ts_ms, bytes(r.raw)) for r in whole[:300]] == packets


@pytest.mark.parametrize("split", [700, 9_000])
def test_indexed_classic_files_without_sure_cuts(spark, tmp_path, split):
    """Packets full of records that look like the file's own."""
    inner = classic([(1_700_000_000_000 + i, FRAME) for i in range(40)])[24:]
    packets = [(t, inner if i % 9 == 4 else raw) for i, (t, raw) in enumerate(some_packets(120, seed=split))]
    (tmp_path / "a.pcap").write_bytes(classic(packets))
    assert found(read_captures(spark, str(tmp_path), split_bytes=split, indexed=True)) == packets


def test_damaged_blocks_are_an_error_with_an_index_too(spark, tmp_path):
    data = bytearray(next_generation(some_packets(60)))
    data[len(data) // 2 :] = b"\x05" * (len(data) - len(data) // 2)
    (tmp_path / "a.pcapng").write_bytes(bytes(data))
    with pytest.raises(Exception, match="damaged"):
        read_captures(spark, str(tmp_path), split_bytes=2_000).count()
