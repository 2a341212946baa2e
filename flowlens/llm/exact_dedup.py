"""Exact duplicates through content-defined chunk recipes.

A text without white space is cut where the bytes themselves say so, so equal
texts are cut alike. Each chunk is named by a digest; the digests are *verified*:
chunks are brought together by digest once, already merged in each map task, and
all bytes behind one digest have to be equal. A document is then no more than its
ordered list of chunk identifiers, and only those lists are grouped.

Defined cases: a null text counts as empty; empty texts equal each other; a null
document id sorts after all others; of rows equal in everything exactly one stays;
an empty table gives an empty result. Other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, stored, utf8

MIN_CHUNK, MAX_CHUNK, MASK_BITS = 512, 16384, 11
_SPACES = b" \t\n\x0b\x0c\r"
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

#: Tried in this order until all bytes behind each digest are equal.
DIGESTS: tuple[Callable[[bytes], bytes], ...] = (
    lambda b: hashlib.sha256(b).digest(),
    lambda b: hashlib.sha256(b).digest() + hashlib.blake2b(b).digest(),
)


def cut(data: bytes) -> list[bytes]:
    """Chunks of MIN_CHUNK to MAX_CHUNK bytes; a cut follows any eight bytes whose hash ends in zeros."""
    if len(data) <= MIN_CHUNK:
        return [data] if data else []
    b = np.frombuffer(data, np.uint8).astype(np.uint64)
    w = b[:-1] | b[1:] << np.uint64(8)
    w = w[:-2] | w[2:] << np.uint64(16)
    w = w[:-4] | w[4:] << np.uint64(32)
    marks = np.flatnonzero((w * _MULTIPLIER) >> np.uint64(64 - MASK_BITS) == 0) + 8
    chunks, start, end = [], 0, len(data)
    for mark in [*marks.tolist(), end]:
        while mark - start > MAX_CHUNK:
            chunks.append(data[start : start + MAX_CHUNK])
            start += MAX_CHUNK
        if mark - start >= MIN_CHUNK or mark == end and mark > start:
            chunks.append(data[start:mark])
            start = mark
    return chunks


def recipes(docs: DataFrame, digest: Callable[[bytes], bytes], id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, n_points, raw_sha256, text_sha256, recipe``: the ordered chunk digests of each text, end to end."""

    def make():
        def one(row):
            doc_id, data, points = row
            text = data.translate(None, _SPACES)
            yield (
                doc_id, points, hashlib.sha256(data).hexdigest(), hashlib.sha256(text).hexdigest(),
                b"".join(map(digest, cut(text))),
            )

        return one

    narrow = docs.select(F.col(id_column).alias("doc_id"), utf8(text_column).alias("data"), F.coalesce(F.char_length(text_column), F.lit(0)).cast("long"))
    return map_rows(narrow, "doc_id long, n_points long, raw_sha256 string, text_sha256 string, recipe binary", make)


def collisions(docs: DataFrame, digest: Callable[[bytes], bytes], text_column: str = "text") -> DataFrame:
    """Digests that stand for more than one sequence of bytes; map tasks merge equal chunks before they move."""

    def make():
        def one(row):
            for chunk in cut(row[0].translate(None, _SPACES)):
                yield digest(chunk), chunk

        return one

    chunks = map_rows(docs.select(utf8(text_column).alias("data")), "digest binary, chunk binary", make)
    return (
        chunks.groupBy("digest").agg(F.min("chunk").alias("first"), F.max("chunk").alias("last"))
        .filter(F.col("first") != F.col("last")).select("digest")
    )


def exact_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", digests=DIGESTS) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256, raw_sha256``.

    Of equal texts the row with the most code points in the original text stays,
    then the one with the smallest id.
    """
    for digest in digests:
        if collisions(docs, digest, text_column).isEmpty():
            break
    else:
        raise ValueError("two chunks share every digest")
    rows = stored(recipes(docs, digest, id_column, text_column).withColumn("row", F.monotonically_increasing_id()), "recipes")
    # the first of a group: most code points, then smallest id with null last, then the first row
    best = F.min(F.struct((-F.col("n_points")).alias("p"), F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("row").alias("r")))
    groups = rows.groupBy("recipe").agg(best.alias("best"), F.count("*").alias("group_size"), F.min("text_sha256").alias("text_sha256"))
    # a second key keeps the grouping's partitions apart from the join's, which can then be split where one recipe is common
    return rows.join(groups, ["recipe", "text_sha256"]).select(
        "doc_id", F.col("best.d").alias("keep_id"), "group_size", (F.col("row") == F.col("best.r")).alias("kept"),
        "text_sha256", "raw_sha256",
    )


def drop_exact(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows that stay, with their own columns; rows alike in id and text are one row."""
    key = ["flowlens_id", "flowlens_sha"]
    kept = exact_groups(docs, id_column, text_column).filter("kept").select(
        F.col("doc_id").alias("flowlens_id"), F.col("raw_sha256").alias("flowlens_sha")
    )
    keyed = docs.withColumns({"flowlens_id": F.col(id_column).cast("long"), "flowlens_sha": F.sha2(utf8(text_column), 256)})
    condition = keyed["flowlens_id"].eqNullSafe(kept["flowlens_id"]) & (keyed["flowlens_sha"] == kept["flowlens_sha"])
    return keyed.join(kept, condition, "left_semi").dropDuplicates(key).drop(*key)
