"""Lines to files that are rolled by size, age or number, results and failures in one pass.

``df.write.format("rolling_lines")`` and ``df.writeStream.format("rolling_lines")`` take rows of ``failed
boolean, value string``; lines go below ``results``, failed ones below ``failures`` or nowhere if
that is not set. Tasks write hidden files and send their names; the driver shows
all of them at once when every task has ended, and removes them if one has failed. The files of a micro-batch bear its number, and when it
runs again they take the place of those of the first time, so each line is there once.

Folders are paths or URIs that Arrow's file systems open (``file``, ``hdfs``, ``s3``, ``gs``).
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage,
)
from pyspark.sql.types import StructType

NAME, SCHEMA = "rolling_lines", "failed boolean, value string"
# fixed values: when a file of a batch run is full or old
ROLL_BYTES, ROLL_SECONDS = 128 << 20, 900


@dataclass
class Written(WriterCommitMessage):
    """Files of one task: their folder, the writer that hid them, and their names."""

    files: list[tuple[str, str, str]]


def _files(folder: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")


class _Part:
    """The file a task writes to a folder, and those it has finished there."""

    def __init__(self, folder: str, run: str, limits: dict[str, float]):
        self.folder, self.run, self.limits, self.stream, self.names = folder, run, limits, None, []
        self.system, self.root = _files(folder)

    def write(self, lines: list[bytes]) -> None:
        for line in lines:
            if self.stream is not None and self._full(len(line)):
                self.close()
            if self.stream is None:
                hidden = f"{self.root}/_rolling-{self.run}"
                self.system.create_dir(hidden, recursive=True)
                self.names.append(uuid.uuid4().hex)
                self.stream, self.size, self.count, self.since = self.system.open_output_stream(f"{hidden}/{self.names[-1]}"), 0, 0, time.monotonic()
            self.stream.write(line)
            self.size, self.count = self.size + len(line), self.count + 1

    def _full(self, more: int) -> bool:
        return (
            self.size + more > self.limits["bytes"] or self.count >= self.limits["records"]
            or time.monotonic() - self.since >= self.limits["seconds"]
        )

    def close(self) -> None:
        if self.stream is not None:
            self.stream.close()
            self.stream = None


class _Rolling:
    """What the batch and the stream writer share."""

    def __init__(self, options: dict[str, str]):
        self.run = uuid.uuid4().hex[:12]
        self.folders = {False: options["results"], True: options.get("failures")}
        self.batch = int(options["batch"]) if "batch" in options else None
        self.limits = {
            "bytes": float(options.get("rollbytes", ROLL_BYTES)), "seconds": float(options.get("rollseconds", ROLL_SECONDS)),
            "records": float(options.get("rollrecords", "inf")),
        }

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        parts = {k: _Part(folder.rstrip("/"), self.run, self.limits) for k, folder in self.folders.items() if folder}
        for batch in iterator:
            lines: dict[bool, list[bytes]] = {k: [] for k in parts}
            for failed, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if failed in lines and value is not None:
                    lines[failed].append(value.encode() + b"\n")
            for k, some in lines.items():
                parts[k].write(some)
        for part in parts.values():
            part.close()
        return Written([(p.folder, p.run, name) for p in parts.values() for name in p.names])

    def show(self, messages: list[WriterCommitMessage | None], batch: int | None) -> None:
        mark = f"part-{self.run}" if batch is None else f"batch-{batch:012d}"
        for folder in filter(None, self.folders.values()):
            system, root = _files(folder.rstrip("/"))
            system.create_dir(root, recursive=True)
            for old in system.get_file_info(pa.fs.FileSelector(root)):
                if old.is_file and old.base_name.startswith(f"{mark}-"):
                    system.delete_file(old.path)
            names = [(run, name) for m in messages if m is not None for f, run, name in m.files if f == folder.rstrip("/")]
            for k, (run, name) in enumerate(names):
                system.move(f"{root}/_rolling-{run}/{name}", f"{root}/{mark}-{k:05d}.txt")
        self.clear(messages)

    def clear(self, messages: list[WriterCommitMessage | None]) -> None:
        """Removes the hidden folders of this writer and of those that sent messages (on a stream they are others)."""
        runs = {self.run, *(run for m in messages if m is not None for _, run, _ in m.files)}
        for folder in filter(None, self.folders.values()):
            system, root = _files(folder.rstrip("/"))
            for run in sorted(runs):
                hidden = f"{root}/_rolling-{run}"
                if system.get_file_info(hidden).type == pa.fs.FileType.Directory:
                    system.delete_dir(hidden)


class RollingWriter(_Rolling, DataSourceArrowWriter):
    def commit(self, messages):
        self.show(messages, self.batch)

    def abort(self, messages):
        self.clear(messages)


class RollingStreamWriter(_Rolling, DataSourceStreamArrowWriter):
    def commit(self, messages, batchId):  # noqa: N803
        self.show(messages, batchId)

    def abort(self, messages, batchId):  # noqa: N803
        self.clear(messages)


class RollingLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return RollingWriter(dict(self.options))

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamWriter:  # noqa: N802
        return RollingStreamWriter(dict(self.options))


def rolling(writer, lines: DataFrame, results: str, failures: str | None = None, **limits):
    """Sets up ``lines.write`` or ``lines.writeStream`` for these folders; ``limits``: ``roll_bytes, roll_seconds, roll_records``."""
    lines.sparkSession.dataSource.register(RollingLines)
    writer = writer.format(NAME).option("results", results)
    if failures:
        writer = writer.option("failures", failures)
    for name, value in limits.items():
        if value is not None:
            writer = writer.option(name.replace("_", ""), str(value))
    return writer
