"""WARC archives: writing pages as transactions and assembling transactions from records.

A page becomes a transaction of three records in one file: ``response`` (or
``revisit`` where the same payload is archived under another page), ``request``
and ``metadata``, the latter two concurrent to the first. Reading goes the other
way for archives of any origin: records that name each other in
WARC-Concurrent-To are joined, and one nested row per capture comes out.

Files are gzip members, one per record, of about ``roll_bytes`` each. They are
written through the file system of ``spark.checkpoint.dir``, under names of their
own per attempt; only files in the manifest count, so a task that runs twice does
no harm.

Defined cases: null html is an empty payload; null urls and ids are archived and
come back as null; rows alike in id and payload are one page,
each archived in full; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.fs  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, partitions, scratch, stored, utf8

ROLL_BYTES = 32 << 20
REVISIT_FROM = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
KINDS = ("response", "request", "metadata")
RECORD = (
    "record_id string, kind string, concurrent_to array<string>, refers_to string, target string, "
    "payload_digest string, declared_bytes long, payload_bytes long, computed_digest string, block binary"
)


def record_id(page_id: int | None, mark: int, kind: str) -> str:
    """A custom (version 8) UUID that holds the page id, 55 bits of the payload's digest and the kind of record."""
    bits = (page_id or 0) & (1 << 64) - 1
    bits = (bits << 1 | (page_id is None)) << 57 | (mark & (1 << 55) - 1) << 2 | KINDS.index(kind)
    high, middle, low = bits >> 74, bits >> 62 & 0xFFF, bits & (1 << 62) - 1
    return f"<urn:uuid:{uuid.UUID(int=high << 80 | 8 << 76 | middle << 64 | 2 << 62 | low)}>"


def page_of(identifier: str | None) -> int | None:
    """The page id in an identifier made here."""
    if identifier is None:
        return None
    n = uuid.UUID(identifier[10:-1]).int
    bits = (n >> 80) << 74 | (n >> 64 & 0xFFF) << 62 | n & (1 << 62) - 1
    if bits >> 57 & 1:
        return None
    page = bits >> 58
    return page - (1 << 64) if page >> 63 else page


def record(kind: str, identifier: str, block: bytes, headers: list[tuple[str, str | None]], when: str) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", identifier), ("WARC-Date", when), *headers, ("Content-Length", str(len(block)))]
    # a line break in a value would end the header
    lines = "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in head if v is not None)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def _gzip(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def transaction(page_id, mark, url, payload, original, when) -> Iterator[bytes]:
    """The three records of one page; ``original`` is the page that archives the payload, None if this one does."""
    digest = hashlib.sha1(payload).hexdigest()
    of = record_id(page_id, mark, "response")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    shared = [("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha1:{digest}")]
    is_http = ("Content-Type", "application/http; msgtype=response")
    if original is None:
        yield record("response", of, http + payload, [*shared, is_http], when)
    else:
        refers = ("WARC-Refers-To", record_id(original, mark, "response"))
        yield record("revisit", of, http, [*shared, is_http, refers, ("WARC-Profile", PROFILE)], when)
    target, concurrent = ("WARC-Target-URI", url), ("WARC-Concurrent-To", of)
    asked = f"GET {' '.join((url or '/').split())} HTTP/1.1\r\n\r\n".encode()
    yield record("request", record_id(page_id, mark, "request"), asked, [target, concurrent, ("Content-Type", "application/http; msgtype=request")], when)
    notes = f"payload-sha1: {digest}\r\n".encode()
    yield record("metadata", record_id(page_id, mark, "metadata"), notes, [target, concurrent, ("Content-Type", "application/warc-fields")], when)


def originals(pages: DataFrame, revisit_from: int = REVISIT_FROM) -> DataFrame:
    """``page_id, mark, url, payload, original``: the page that archives a row's payload, null if the row's own page does.

    Equal payloads of at least ``revisit_from`` bytes are archived by the largest
    page id. Digests are counted before anything moves, and rows are joined to the
    digests that occur more than once. ``mark`` is drawn from the payload.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), utf8("html").alias("payload"))
    rows = rows.withColumn("sha", F.sha2("payload", 256))
    large = rows.filter(F.octet_length("payload") >= revisit_from)
    repeated = large.groupBy("sha").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).filter("n > 1").select("sha", "last")
    joined = rows.join(stored(repeated, "repeated"), "sha", "left")
    return joined.select(
        "page_id", F.conv(F.substring("sha", 1, 13), 16, 10).cast("long").alias("mark"), "url", "payload",
        F.when(~F.col("page_id").eqNullSafe(F.col("last")), F.col("last")).alias("original"),
    )


def write_warc(pages: DataFrame, folder: str | None = None, revisit_from: int = REVISIT_FROM, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Writes archives and returns their manifest, ``path, records``, which is stored."""
    folder = folder or f"{scratch(pages.sparkSession)}/warc-{uuid.uuid4().hex[:12]}"
    when = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, root = pa.fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        filesystem.create_dir(root, recursive=True)
        out, done, path, records = None, [], None, 0
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                for row in zip(*(c.to_pylist() for c in batch.slice(start, 64).columns)):
                    if out is None:
                        name = f"{uuid.uuid4().hex}.warc.gz"
                        path, out, records = f"{folder}/{name}", filesystem.open_output_stream(f"{root}/{name}", compression=None), 1
                        info = f"format: WARC File Format 1.1\r\nfile: {name}\r\n".encode()
                        out.write(_gzip(record("warcinfo", f"<urn:uuid:{uuid.uuid4()}>", info, [("Content-Type", "application/warc-fields")], when)))
                    for part in transaction(*row, when):
                        out.write(_gzip(part))
                        records += 1
                    if out.tell() >= roll_bytes:
                        out.close()
                        done.append((path, records))
                        out = None
        if out is not None:
            out.close()
            done.append((path, records))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done]), pa.array([n for _, n in done], pa.int64())], ["path", "records"])

    rows = originals(pages, revisit_from)
    return stored(rows.mapInArrow(run, "path string, records long"), "manifest")


def _members(handle, size: int = 1 << 20) -> Iterator[bytes]:
    """The contents of gzip members, one after the other; one is held at a time."""
    packer, parts, data = zlib.decompressobj(31), [], handle.read(size)
    while data:
        parts.append(packer.decompress(data))
        if packer.eof:
            yield b"".join(parts)
            data, packer, parts = packer.unused_data or handle.read(size), zlib.decompressobj(31), []
        else:
            data = handle.read(size)
    if any(parts):
        raise ValueError("the archive ends inside a record")


def parse(data: bytes) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """Headers and block of each record in ``data``, told apart by their stated lengths."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("no WARC record where one has to begin")
        headers = [(k.strip().lower(), v.strip()) for k, _, v in (line.partition(":") for line in lines[1:])]
        length = int(dict(headers)["content-length"])
        block = data[end + 4 : end + 4 + length]
        if len(block) < length or data[end + 4 + length : end + 8 + length] != b"\r\n\r\n":
            raise ValueError("a record's length is wrong")
        yield headers, block
        at = end + 8 + length


def read_records(manifest: DataFrame, with_block: bool = False) -> DataFrame:
    """The records of the archives in ``manifest``, without their info records; payloads are digested where they are read.

    ``block`` stays null unless ``with_block``.
    """

    def make():
        def one(row):
            filesystem, name = pa.fs.FileSystem.from_uri(row[0] if "://" in row[0] else f"file://{row[0]}")
            with filesystem.open_input_file(name) as handle:
                for member in _members(handle):
                    for headers, block in parse(member):
                        get = dict(headers).get
                        if get("warc-type") == "warcinfo":
                            continue
                        declared, payload = None, b""
                        if get("warc-type") in ("response", "revisit"):
                            head, _, payload = block.partition(b"\r\n\r\n")
                            lengths = [v for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")) if k.lower() == b"content-length"]
                            declared = int(lengths[0]) if lengths else None
                        yield (
                            get("warc-record-id"), get("warc-type"), [v for k, v in headers if k == "warc-concurrent-to"],
                            get("warc-refers-to"), get("warc-target-uri"), get("warc-payload-digest"), declared,
                            len(payload), hashlib.sha1(payload).hexdigest(), block if with_block else None,
                        )

        return one

    spread = manifest.select("path").repartition(partitions(manifest.sparkSession))
    return map_rows(spread, RECORD, make, rows=256)


def transactions(records: DataFrame) -> DataFrame:
    """One nested row per capture: ``capture`` with its ``request`` and ``metadata`` records.

    Identifiers may be named from either side. A metadata record may also be tied
    to the request alone; it then belongs to the capture that the request belongs
    to. Records without a capture are left out, captures without company stay, and
    records alike in everything count once as company.
    """
    # sizes of records that come from archives are unknown when the plan is made: no side is broadcast
    captured = F.col("kind").isin("response", "revisit")
    captures = records.filter(captured).select("record_id", F.struct(*records.columns).alias("capture"))
    others = records.filter(~captured).select("record_id", F.struct(*records.columns).alias("other"))
    ties = records.select("record_id", F.explode("concurrent_to").alias("to"))
    both = ties.union(ties.select("to", "record_id")).toDF("one", "two").distinct()
    ids = captures.select(F.col("record_id").alias("capture_id")).hint("merge")
    same = ids.withColumnRenamed("capture_id", "record_id").hint("merge")
    direct = both.join(ids, both.one == ids.capture_id).select("capture_id", F.col("two").alias("record_id"))
    direct = direct.join(same, "record_id", "left_anti")
    onward = direct.withColumnRenamed("record_id", "one").join(both.hint("merge"), "one").select("capture_id", F.col("two").alias("record_id"))
    loose = onward.join(same, "record_id", "left_anti")
    members = direct.union(loose).distinct().join(others.hint("merge"), "record_id")
    kind = F.col("other.kind")
    company = members.groupBy("capture_id").agg(
        F.min(F.when(kind == "request", F.col("other"))).alias("request"),
        F.sort_array(F.collect_set(F.when(kind == "metadata", F.col("other")))).alias("metadata"),
    )
    whole = captures.join(company.hint("merge"), captures.record_id == company.capture_id, "left")
    return whole.select("capture", "request", "metadata")


def archived(pages: DataFrame, revisit_from: int = REVISIT_FROM) -> DataFrame:
    """Pages written to archives, read back and assembled: ``page_id, payload_bytes, payload_digest, record_type, refers_to, n_company``."""
    page = F.udf(page_of, "long", useArrow=True)
    # parsed once; the joins read the records several times
    records = stored(read_records(write_warc(pages, revisit_from=revisit_from)), "records")
    whole = transactions(records)
    revisit = F.col("capture.kind") == "revisit"
    stated = F.regexp_extract("capture.payload_digest", "^sha1:([0-9a-f]{40})$", 1)
    return whole.select(
        page("capture.record_id").alias("page_id"),
        F.when(revisit, F.col("capture.declared_bytes")).otherwise(F.col("capture.payload_bytes")).alias("payload_bytes"),
        F.when(revisit, stated).otherwise(F.col("capture.computed_digest")).alias("payload_digest"),
        F.col("capture.kind").alias("record_type"), page("capture.refers_to").alias("refers_to"),
        (F.size(F.coalesce("metadata", F.array())) + F.col("request").isNotNull().cast("int")).alias("n_company"),
    )
