"""Capture files (``.pcap``, ``.pcapng``) as a Spark data source.

``spark.read.format("capture").load(path)`` gives one row per packet:
``file, file_offset, dlt, ts_ms, raw``. ``path`` is a file or a folder, whose
capture files are read without going into subfolders.

A capture file has no index, but a large one is still read by many tasks:
it is cut at byte positions, and a reader finds the first record at or after
its cut by looking for a chain of plausible record headers. Every reader also
makes that search for the cut that follows its own and compares the outcome
with where its own records end. The first reader starts at a known place, so
agreement at all cuts proves that no packet is lost, doubled or invented; a
disagreement fails the job. ``splitBytes=0`` reads the file in one piece; ``read_captures(..., indexed=True)``
proves every cut in a job of its own first, which also lets ``.pcapng`` files be cut
(see ``capture_index``), at the price of reading headers twice.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..operators.ordering import DEFAULT_POLICY, SlicePolicy, with_row_number

SCHEMA = "file string, file_offset bigint, dlt int, ts_ms bigint, raw binary"
DEFAULT_SPLIT_BYTES = 128 << 20
BATCH_ROWS = 4096

# Fixed values of the two public file formats
MAGICS = {
    b"\xa1\xb2\xc3\xd4": (">", 1_000), b"\xd4\xc3\xb2\xa1": ("<", 1_000),
    b"\xa1\xb2\x3c\x4d": (">", 1_000_000), b"\x4d\x3c\xb2\xa1": ("<", 1_000_000),
}
FILE_HEADER, RECORD_HEADER = 24, 16
NG_SECTION, NG_INTERFACE, NG_OBSOLETE, NG_SIMPLE, NG_ENHANCED = 0x0A0D0D0A, 1, 2, 3, 6
NG_BYTE_ORDER = 0x1A2B3C4D
NG_TIME_RESOLUTION, NG_TIME_OFFSET = 9, 14
MAX_PACKET = 1 << 18

CHAIN = 12  # record headers in a row that make a start believable


class Split(InputPartition):
    def __init__(self, path: str, start: int, end: int | None, size: int, next_cut: int | None):
        self.path, self.start, self.end, self.size, self.next_cut = path, start, end, size, next_cut


def _open(path: str):
    filesystem, name = pa.fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else f"/{path}")
    return filesystem.open_input_file(name)


def _list(path: str) -> list[tuple[str, int]]:
    filesystem, name = pa.fs.FileSystem.from_uri(path)
    info = filesystem.get_file_info(name)
    if info.type == pa.fs.FileType.File:
        return [(path, info.size)]
    if info.type == pa.fs.FileType.NotFound:
        raise FileNotFoundError(path)
    prefix = path[: len(path) - len(name)] if path.endswith(name) else ""
    found = filesystem.get_file_info(pa.fs.FileSelector(name))
    return sorted(
        (prefix + f.path, f.size) for f in found if f.is_file and f.path.endswith((".pcap", ".pcapng"))
    )


class ClassicFile:
    """A ``.pcap`` file: a file header, then records of a 16-byte header and the packet's bytes."""

    def __init__(self, handle, size: int):
        self.handle, self.size = handle, size
        head = self.read(0, FILE_HEADER)
        self.order, self.per_ms = MAGICS[head[:4]]
        self.dlt = struct.unpack(self.order + "I", head[20:24])[0] & 0xFFFF

    def read(self, at: int, length: int) -> bytes:
        self.handle.seek(at)
        return self.handle.read(length)

    def _plausible(self, header: bytes, near: int | None) -> tuple[int, int] | None:
        seconds, fraction, kept, length = struct.unpack(self.order + "IIII", header)
        if fraction >= self.per_ms * 1000 or kept > length or kept > MAX_PACKET or length > MAX_PACKET or not length:
            return None
        # neighbours in a capture are close in time
        return (seconds, kept) if near is None or abs(seconds - near) <= 86_400 else None

    def first_record(self, cut: int) -> int:
        """Offset of the first record at or after ``cut``, or the file's size if there is none."""
        if cut <= FILE_HEADER:
            return FILE_HEADER
        window = self.read(cut, MAX_PACKET + RECORD_HEADER)
        for shift in range(len(window) - RECORD_HEADER + 1):
            if self._chain(cut + shift, window, shift):
                return cut + shift
        return self.size

    def _chain(self, at: int, window: bytes, shift: int) -> bool:
        near = None
        for _ in range(CHAIN):
            if at >= self.size:
                return at == self.size
            header = window[shift : shift + RECORD_HEADER] if shift + RECORD_HEADER <= len(window) else self.read(at, RECORD_HEADER)
            if len(header) < RECORD_HEADER:
                return False
            found = self._plausible(header, near)
            if found is None:
                return False
            near, kept = found
            at, shift = at + RECORD_HEADER + kept, shift + RECORD_HEADER + kept
        return at <= self.size

    def records(self, start: int, end: int, bodies: bool = True) -> Iterator[tuple[int, int, int, bytes]]:
        """Records that begin in ``[start, end)``; a truncated last one is left out. Without ``bodies`` these are skipped."""
        at = start
        self.handle.seek(at)
        self.stopped_at = self.size  # where nothing can follow
        while at < end:
            header = self.handle.read(RECORD_HEADER)
            if len(header) < RECORD_HEADER:
                return
            seconds, fraction, kept, _ = struct.unpack(self.order + "IIII", header)
            if bodies:
                raw = self.handle.read(kept)
            else:
                raw = b""
                self.handle.seek(at + RECORD_HEADER + kept)
            if (len(raw) if bodies else self.size - at - RECORD_HEADER) < kept:
                return
            yield at, self.dlt, seconds * 1000 + fraction // self.per_ms, raw
            at += RECORD_HEADER + kept
        self.stopped_at = at


def _next_generation(path: str, handle, size: int) -> Iterator[tuple[int, int, int, bytes]]:
    """Records of a ``.pcapng`` file; a truncated last block is left out, a damaged one is an error.

    Sections and interfaces are declared on the way, so the file is read in order.
    """
    at, order, interfaces = 0, "<", []
    handle.seek(0)
    while at + 12 <= size:
        head = handle.read(8)
        section = struct.unpack("<I", head[:4])[0] == NG_SECTION
        if section:
            mark = handle.read(4)
            order = "<" if struct.unpack("<I", mark)[0] == NG_BYTE_ORDER else ">"
            interfaces = []
        kind, length = struct.unpack(order + "II", head)
        if length < 12 or length % 4:
            raise ValueError(f"{path}: damaged block at byte {at}")
        if at + length > size:
            return
        body = handle.read(length - 12 - 4 * section)
        if handle.read(4) != struct.pack(order + "I", length):
            raise ValueError(f"{path}: damaged block at byte {at}")
        if section:
            at += length
            continue
        if kind == NG_INTERFACE:
            interfaces.append((struct.unpack(order + "H", body[:2])[0], *clock(body[8:], order)))
        elif kind in (NG_ENHANCED, NG_OBSOLETE, NG_SIMPLE):
            record = block_record(kind, body, order, interfaces)
            if record is not None:
                yield at, *record
        at += length


def block_record(kind: int, body: bytes, order: str, interfaces: list) -> tuple[int, int, bytes] | None:
    """Link type, time and bytes of a packet block."""
    if kind == NG_SIMPLE:
        original = struct.unpack(order + "I", body[:4])[0]
        return (interfaces[0][0], 0, body[4 : 4 + original]) if interfaces else None
    number, high, low, kept, _ = struct.unpack(order + ("IIIII" if kind == NG_ENHANCED else "HxxIIII"), body[:20])
    dlt, per_second, offset_ms = interfaces[number]
    return dlt, ((high << 32) | low) * 1000 // per_second + offset_ms, body[20 : 20 + kept]


def clock(options: bytes, order: str) -> tuple[int, int]:
    """Ticks in a second, and what is added to all times, in milliseconds."""
    at, ticks, offset = 0, 1_000_000, 0
    while at + 4 <= len(options):
        code, length = struct.unpack(order + "HH", options[at : at + 4])
        if code == 0:
            break
        if code == NG_TIME_RESOLUTION and length:
            value = options[at + 4]
            ticks = 2 ** (value & 0x7F) if value & 0x80 else 10**value
        elif code == NG_TIME_OFFSET and length == 8:
            offset = 1000 * struct.unpack(order + "q", options[at + 4 : at + 12])[0]
        at += 4 + length + (-length % 4)
    return ticks, offset


class CaptureReader(DataSourceReader):
    def __init__(self, path: str, split_bytes: int):
        self.path, self.split_bytes = path, split_bytes

    def partitions(self) -> list[Split]:
        splits = []
        for path, size in _list(self.path):
            with _open(path) as handle:
                classic = handle.read(4) in MAGICS
            step = self.split_bytes if classic and self.split_bytes > 0 else size
            cuts = list(range(0, size, max(step, 1)))
            for cut, following in zip(cuts, [*cuts[1:], None]):
                splits.append(Split(path, cut, following if following else None, size, following))
        return splits

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        with _open(split.path) as handle:
            magic = handle.read(4)
            if magic in MAGICS:
                yield from _batches(split.path, self._classic(handle, split))
            elif magic == struct.pack("<I", NG_SECTION):
                yield from _batches(split.path, _next_generation(split.path, handle, split.size))
            else:
                raise ValueError(f"{split.path}: neither a .pcap nor a .pcapng file")

    @staticmethod
    def _classic(handle, split: Split) -> Iterator[tuple[int, int, int, bytes]]:
        file = ClassicFile(handle, split.size)
        start = file.first_record(split.start)
        if split.next_cut is None:
            yield from file.records(start, split.size)
            return
        following = file.first_record(split.next_cut)
        yield from file.records(start, split.next_cut)
        if file.stopped_at != following:
            raise ValueError(f"{split.path}: no agreement on the records at byte {split.next_cut}; read it with indexed=True")


def _batches(path: str, records: Iterator[tuple[int, int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    types = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
    names = ["file", "file_offset", "dlt", "ts_ms", "raw"]
    rows: list[tuple[int, int, int, bytes]] = []

    def batch() -> pa.RecordBatch:
        columns = [[path] * len(rows), *zip(*rows)]
        return pa.record_batch([pa.array(list(c), t) for c, t in zip(columns, types)], names=names)

    for record in records:
        rows.append(record)
        if len(rows) == BATCH_ROWS:
            yield batch()
            rows.clear()
    if rows:
        yield batch()


class CaptureSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "capture"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> CaptureReader:
        return CaptureReader(self.options["path"], int(self.options.get("splitBytes", DEFAULT_SPLIT_BYTES)))


def read_captures(spark: SparkSession, path: str, split_bytes: int = DEFAULT_SPLIT_BYTES, indexed: bool | None = None) -> DataFrame:
    """Packets of a file or a folder. By default ``indexed`` where a ``.pcapng`` file is longer than ``split_bytes``."""
    if indexed is None:
        indexed = 0 < split_bytes < max((size for name, size in _list(path) if name.endswith(".pcapng")), default=0)
    if indexed:
        from .capture_index import read_indexed

        return read_indexed(spark, path, split_bytes)
    spark.dataSource.register(CaptureSource)
    return spark.read.format("capture").option("splitBytes", split_bytes).load(path)


def with_packet_numbers(captures: DataFrame, policy: SlicePolicy = DEFAULT_POLICY) -> DataFrame:
    """Adds ``packet_no``, 1-based within each file."""
    return with_row_number(captures, ["file"], ["file_offset"], policy, name="packet_no").drop("slice")
