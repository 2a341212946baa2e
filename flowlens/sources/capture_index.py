"""Large captures of any kind read by many tasks: an index of cuts first, then the packets.

A job of one task per cut finds the first record or block at or after it, walks the headers
from there to the next cut and notes where it stops, and which sections and interfaces a
``.pcapng`` file declares on the way. The first start of a file is known; every other one is
right if the cut before stops there, and is walked again from where that one stops if
it does not (a capture inside a packet can look like the file itself). So every cut
ends up at a proven place, with the interfaces that hold there, and the packets are read from there.

The driver holds one small row per cut, like a listing of files in parts.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import ship_package
from .pcap import (
    CHAIN, DEFAULT_SPLIT_BYTES, MAGICS, NG_BYTE_ORDER, NG_ENHANCED, NG_INTERFACE, NG_OBSOLETE, NG_SECTION, NG_SIMPLE, SCHEMA,
    ClassicFile, _batches, _list, _open, block_record, clock,
)

#: Longest block that a cut may fall on, and bytes read ahead while walking.
MOST_BLOCK, AHEAD = 1 << 24, 1 << 20


class BlockFile:
    """A ``.pcapng`` file: blocks of a type, a length, a body and the length again."""

    def __init__(self, path: str, handle, size: int):
        self.path, self.handle, self.size = path, handle, size
        self._at, self._held = 0, b""

    def read(self, at: int, length: int) -> bytes:
        if not self._at <= at <= at + length <= self._at + len(self._held):
            self.handle.seek(at)
            self._at, self._held = at, self.handle.read(max(length, AHEAD))
        return self._held[at - self._at : at - self._at + length]

    def order_of(self, at: int) -> str | None:
        """Byte order of the section that begins here, if one does."""
        head = self.read(at, 12)
        if len(head) < 12 or struct.unpack("<I", head[:4])[0] != NG_SECTION:
            return None
        mark = struct.unpack("<I", head[8:])[0]
        return "<" if mark == NG_BYTE_ORDER else ">" if mark == struct.unpack(">I", struct.pack("<I", NG_BYTE_ORDER))[0] else None

    def block(self, at: int, order: str) -> tuple[int, int, str] | None:
        """Kind, length and byte order of a whole block, None at the end of the file."""
        if at + 12 > self.size:
            return None
        order = self.order_of(at) or order
        kind, length = struct.unpack(order + "II", self.read(at, 8))
        if length < 12 or length % 4:
            raise ValueError(f"{self.path}: damaged block at byte {at}")
        if at + length > self.size:
            return None  # truncated
        if self.read(at + length - 4, 4) != struct.pack(order + "I", length):
            raise ValueError(f"{self.path}: damaged block at byte {at}")
        return kind, length, order

    def first(self, cut: int) -> tuple[int, str] | None:
        """The first block at or after ``cut`` that a chain of blocks follows, and its byte order."""
        if cut == 0:
            return 0, self.order_of(0) or "<"
        for at in range(cut + -cut % 4, min(cut + MOST_BLOCK, self.size - 11), 4):
            for order in "<>":
                if self._chain(at, order):
                    return at, order
        return None

    def _chain(self, at: int, order: str) -> bool:
        for _ in range(CHAIN):
            if at + 12 > self.size:
                return True
            head = self.read(at, 8)
            length = struct.unpack(order + "I", head[4:])[0]
            if length > MOST_BLOCK:
                return False
            try:
                found = self.block(at, order)
            except ValueError:
                return False
            if found is None:
                return False
            at, order = at + found[1], found[2]
        return True

    def walk(self, start: int, end: int, order: str) -> tuple[int, str, list]:
        """Where the blocks that begin in ``[start, end)`` stop, the byte order there, and what they declare."""
        at, said = start, []
        while at < end:
            found = self.block(at, order)
            if found is None:
                return self.size, order, said
            kind, length, order = found
            if kind == NG_SECTION:
                said.append(None)
            elif kind == NG_INTERFACE:
                body = self.read(at + 8, length - 12)
                said.append([struct.unpack(order + "H", body[:2])[0], *clock(body[8:], order)])
            at += length
        return at, order, said

    def records(self, start: int, end: int, order: str, interfaces: list) -> Iterator[tuple[int, int, int, bytes]]:
        at = start
        while at < end:
            found = self.block(at, order)
            if found is None:
                return
            kind, length, order = found
            if kind == NG_SECTION:
                interfaces = []
            elif kind in (NG_INTERFACE, NG_ENHANCED, NG_OBSOLETE, NG_SIMPLE):
                body = self.read(at + 8, length - 12)
                if kind == NG_INTERFACE:
                    interfaces = [*interfaces, [struct.unpack(order + "H", body[:2])[0], *clock(body[8:], order)]]
                else:
                    record = block_record(kind, body, order, interfaces)
                    if record is not None:
                        yield at, *record
            at += length


@dataclass
class Part:
    """One cut of a file and what is known about it."""

    path: str
    size: int
    cut: int
    end: int
    start: int | None = None
    order: str = "<"
    stop: int = -1
    stop_order: str = "<"
    said: list = field(default_factory=list)
    interfaces: list = field(default_factory=list)


def _walked(part: Part) -> Part:
    """Finds the start, unless it is given, and walks to the end; no start or a broken walk leave it unknown."""
    forced = part.start is not None
    with _open(part.path) as handle:
        try:
            if handle.read(4) in MAGICS:
                file = ClassicFile(handle, part.size)
                part.start = part.start if forced else file.first_record(part.cut)
                for _ in file.records(part.start, part.end, bodies=False):
                    pass
                part.stop = file.stopped_at
            else:
                file = BlockFile(part.path, handle, part.size)
                found = (part.start, part.order) if forced else file.first(part.cut)
                if found is not None:
                    part.start, part.order = found
                    part.stop, part.stop_order, part.said = file.walk(part.start, part.end, part.order)
        except ValueError:
            if forced:
                raise
            part.start = None
    return part


def _run(spark: SparkSession, parts: list[Part]) -> list[Part]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [json.dumps(vars(_walked(Part(**json.loads(p))))) for p in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], ["part"])

    ship_package(spark, "flowlens")
    return [Part(**json.loads(r.part)) for r in _dealt(spark, parts).mapInArrow(run, "part string").collect()]


def _dealt(spark: SparkSession, parts: list[Part]) -> DataFrame:
    rows = spark.createDataFrame([(i, json.dumps(vars(p))) for i, p in enumerate(parts)], "no long, part string")
    return rows.repartitionByRange(max(1, len(parts)), "no").select("part")


def index(spark: SparkSession, path: str, split_bytes: int = DEFAULT_SPLIT_BYTES) -> list[Part]:
    """All parts of the captures at ``path``, each with a proven start and the interfaces that hold there."""
    waiting: dict[str, list[Part]] = {}
    for name, size in _list(path):
        step = split_bytes if split_bytes > 0 else max(size, 1)
        cuts = list(range(0, max(size, 1), step))
        waiting[name] = [Part(name, size, a, b) for a, b in zip(cuts, [*cuts[1:], size])]
    known = {(p.path, p.cut): p for p in _run(spark, [p for parts in waiting.values() for p in parts])} if waiting else {}
    proven: list[Part] = []
    places = {name: (0, None, "<", []) for name in waiting}  # next part, where it starts, byte order, interfaces
    while waiting:
        again = []
        for name in list(waiting):
            at, start, order, interfaces = places[name]
            parts = waiting[name]
            while at < len(parts):
                part = known[name, parts[at].cut]
                if start is not None and start >= part.end:  # one block reaches beyond it
                    at += 1
                    continue
                if start is not None and part.start != start:
                    part.start, part.order, part.said = start, order, []
                    again.append(part)
                    break
                part.interfaces = interfaces
                proven.append(part)
                for said in part.said:
                    interfaces = [] if said is None else [*interfaces, said]
                start, order, at = part.stop, part.stop_order, at + 1
            places[name] = (at, start, order, interfaces)
            if at == len(parts):
                del waiting[name]
        if again:
            known.update({(p.path, p.cut): p for p in _run(spark, again)})
    return proven


def read_indexed(spark: SparkSession, path: str, split_bytes: int = DEFAULT_SPLIT_BYTES) -> DataFrame:
    """``file, file_offset, dlt, ts_ms, raw``, one task per part."""

    def records(part: Part) -> Iterator[tuple[int, int, int, bytes]]:
        with _open(part.path) as handle:
            if handle.read(4) in MAGICS:
                yield from ClassicFile(handle, part.size).records(part.start, part.end)
            else:
                yield from BlockFile(part.path, handle, part.size).records(part.start, part.end, part.order, part.interfaces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.column(0).to_pylist():
                part = Part(**json.loads(p))
                yield from _batches(part.path, records(part))

    ship_package(spark, "flowlens")
    return _dealt(spark, index(spark, path, split_bytes)).mapInArrow(run, SCHEMA)
