"""SimHash near-duplicates by a generalised pigeonhole search.

64-bit fingerprints link at Hamming distance ``limit`` or less. Bits that go
together (by their correlation over all fingerprints) are put into one part; if
the thresholds t of the parts satisfy sum(t + 1) = limit + 1, two linked
fingerprints are within t in some part. Thresholds and the number of parts come from a dynamic
program over the estimated number of candidates and probes. Every fingerprint is
listed under its own value of each part and probes the values within that part's
threshold; what meets is verified. In a bucket only a spanning forest of the links
found is emitted, never all pairs.

Defined cases: null and empty texts have the fingerprint zero and link like any
other; null ids get a component like all rows but never name one (the component of
only null ids is null); repeated rows are rows of one class; empty tables give
empty results; only id and text are read of the input.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.session import ship_package

from .common import map_rows, partitions, stored, utf8
from .components import components

SHINGLE, LIMIT, BITS, SEED = 4, 4, 64, 42
#: A bucket up to this many rows is compared offset by offset, a larger one leader by leader.
SMALL_BUCKET = 64


def shingle_hashes(data: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """One hash per shingle in the order of the text; none without words."""
    import xxhash

    words = data.lower().split()  # for bytes: A-Z only, and exactly the six white space characters
    if not words:
        return np.zeros(0, np.uint64)
    text, n = b" ".join(words), max(1, len(words) - shingle + 1)
    starts = np.zeros(len(words) + 1, np.int64)
    np.cumsum([len(w) + 1 for w in words], out=starts[1:])
    begins = starts[:n].tolist()
    ends = (starts[min(shingle, len(words)) :][:n] - 1).tolist()
    of = xxhash.xxh64_intdigest
    return np.fromiter((of(text[a:b], SEED) for a, b in zip(begins, ends)), np.uint64, n)


def fingerprint(data: bytes, shingle: int = SHINGLE) -> int:
    """Bit by bit the majority over all shingle hashes; as a signed long."""
    hashes = shingle_hashes(data, shingle)
    n, ones = len(hashes), np.zeros(BITS, np.int64)
    for at in range(0, n, 65536):
        ones += np.unpackbits(hashes[at : at + 65536].view(np.uint8), bitorder="little").reshape(-1, BITS).sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fp``."""
    return map_rows(
        docs.select(F.col(id_column).cast("long"), utf8(text_column)), "doc_id long, fp long",
        lambda: lambda row: [(row[0], fingerprint(row[1], shingle))],
    )


def bit_counts(prints: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how often each two bits are both set, over all of them; 64 x 64 sums reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            values = np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False))
            for at in range(0, len(values), 65536):
                bits = np.unpackbits(values[at : at + 65536].view(np.uint8), bitorder="little").reshape(-1, BITS).astype(np.float32)
                total += bits.T @ bits
                n += len(bits)
        if n:
            pair = np.append(np.arange(BITS * BITS), BITS * BITS)
            yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(np.append(total.ravel(), n).astype(np.int64))], ["pair", "n"])

    ship_package(prints.sparkSession, "flowlens")
    sums = dict(map(tuple, prints.select("fp").mapInArrow(run, "pair long, n long").groupBy("pair").sum("n").collect()))
    both = np.array([sums.get(i, 0) for i in range(BITS * BITS)], float).reshape(BITS, BITS)
    return sums.get(BITS * BITS, 0), both


def grouped_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Parts of about equal width, each grown around a bit by the strongest remaining correlation."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    related = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(related, 0)
    free, out = set(range(BITS)), []
    for k in range(parts):
        width = len(free) // (parts - k)
        part = [max(sorted(free), key=lambda b: spread[b])]
        free.discard(part[0])
        while len(part) < width:
            part.append(max(sorted(free), key=lambda b: related[b, part].sum()))
            free.discard(part[-1])
        out.append(sorted(part))
    return out


def within(p: np.ndarray, most: int) -> list[float]:
    """Chance that two fingerprints differ in at most 0, 1, ... of the bits set with chances ``p``."""
    exact = np.zeros(most + 1)
    exact[0] = 1
    for q in 2 * p * (1 - p):
        exact[1:] = exact[1:] * (1 - q) + exact[:-1] * q
        exact[0] *= 1 - q
    return np.cumsum(exact).tolist()


def plan(n: int, both: np.ndarray, limit: int = LIMIT) -> list[tuple[list[int], int]]:
    """Parts with their thresholds (-1: not searched) of least estimated work."""
    p = np.diag(both) / max(n, 1)
    best: tuple[float, list] = (math.inf, [])
    for count in range(1, limit + 2):
        parts = grouped_bits(n, both, count)
        # cheapest[s]: least cost so far with thresholds that add up to s, each counted one higher
        cheapest: dict[int, tuple[float, list]] = {0: (0.0, [])}
        for part in parts:
            near, nxt = within(p[part], min(limit, len(part))), {}
            for t in range(-1, min(limit, len(part)) + 1):
                probes = sum(math.comb(len(part), k) for k in range(t + 1))
                cost = 0.0 if t < 0 else 20.0 * n * probes + n * n / 2 * near[t]
                for s, (so_far, chosen) in cheapest.items():
                    new = s + t + 1
                    if new <= limit + 1 and so_far + cost < nxt.get(new, (math.inf,))[0]:
                        nxt[new] = (so_far + cost, [*chosen, (part, t)])
            cheapest = nxt
        if limit + 1 in cheapest and cheapest[limit + 1][0] < best[0]:
            best = cheapest[limit + 1]
    return [(part, t) for part, t in best[1] if t >= 0]


def probes(values: np.ndarray, part: list[int], threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys to look under and which values do: the own key, then larger keys within the threshold.

    Of two keys the smaller one probes, so each two meet once.
    """
    mask = np.uint64(sum(1 << b for b in part))
    own = values & mask
    yield own, np.ones(len(values), bool)
    for k in range(1, threshold + 1):
        for flipped in combinations(part, k):
            key = own ^ np.uint64(sum(1 << b for b in flipped))
            yield key, key > own


def listed(prints: DataFrame, parts: list[tuple[list[int], int]]) -> DataFrame:
    """``part, key, own, fp``: each fingerprint under its own key of each part and under those it probes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signed = np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False))
            for number, (part, threshold) in enumerate(parts):
                for turn, (key, takes) in enumerate(probes(signed.view(np.uint64), part, threshold)):
                    if takes.any():
                        m = int(takes.sum())
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(m, number, np.int32)), pa.array(key[takes].view(np.int64)), pa.array(np.full(m, turn == 0)), pa.array(signed[takes])],
                            ["part", "key", "own", "fp"],
                        )

    ship_package(prints.sparkSession, "flowlens")
    return prints.select("fp").mapInArrow(run, "part int, key long, own boolean, fp long")


class Forest:
    """Union-find over the rows of one bucket."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def bucket_links(values: np.ndarray, own: np.ndarray, limit: int = LIMIT) -> list[tuple[int, int]]:
    """A spanning forest of the links in one bucket, as pairs of positions.

    Values gather around leaders that are more than ``limit`` apart. Values of one
    leader are connected already; those of two leaders are compared only while the
    two are not connected and near enough for a link. Two visitors need no comparison:
    each meets the other's key elsewhere; comparing them does no harm either.
    """
    n = len(values)
    forest, edges = Forest(n), []
    leaders: list[int] = []
    members: dict[int, np.ndarray] = {}
    free = np.arange(n)
    while len(free):
        leader = int(free[0])
        near = np.bitwise_count(values[free] ^ values[leader]) <= limit
        members[leader] = free[near]
        edges += [(leader, int(x)) for x in free[near][1:] if forest.join(leader, int(x))]
        leaders.append(leader)
        free = free[~near]
    heads = values[leaders]
    grown = np.array([len(members[x]) > 1 for x in leaders])
    for i, a in enumerate(leaders):
        far = np.bitwise_count(heads[i + 1 :] ^ heads[i])
        for j in np.flatnonzero(far <= limit + limit * (grown[i].astype(int) + grown[i + 1 :])) + i + 1:
            b = leaders[j]
            if forest.root(a) == forest.root(b):
                continue
            left, right = members[a], members[b]
            for at in range(0, len(left), 1024):
                block = left[at : at + 1024]
                hit = np.argwhere(np.bitwise_count(values[block][:, None] ^ values[right][None, :]) <= limit)
                if len(hit):
                    x, y = int(block[hit[0][0]]), int(right[hit[0][1]])
                    forest.join(x, y)
                    edges.append((x, y))
                    break
    return edges


def links(buckets: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``a, b``: for each bucket a spanning forest of its links. Rows of a bucket lie together and in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            rows = np.stack([np.asarray(batch.column(i).to_numpy(zero_copy_only=False)).astype(np.int64) for i in range(4)], 1)
            if not len(rows):
                continue
            new = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(1))
            first_differs = held and (held[-1][-1, :2] != rows[0, :2]).any()
            if first_differs:
                yield from _bucket_batch(np.concatenate(held), limit)
                held = []
            if len(new):
                cut = int(new[-1]) + 1
                yield from _bucket_batch(np.concatenate([*held, rows[:cut]]), limit)
                held = [rows[cut:]]
            else:
                held.append(rows)
        if held:
            yield from _bucket_batch(np.concatenate(held), limit)

    return buckets.select("part", "key", "own", "fp").mapInArrow(run, "a long, b long")


def _bucket_batch(rows: np.ndarray, limit: int) -> Iterator[pa.RecordBatch]:
    """Links of whole buckets that follow each other."""
    values = np.ascontiguousarray(rows[:, 3]).view(np.uint64)
    own = rows[:, 2].astype(bool)
    starts = np.flatnonzero(np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(1)))
    sizes = np.diff(np.append(starts, len(rows)))
    small = np.repeat(sizes <= SMALL_BUCKET, sizes)
    bucket = np.repeat(np.arange(len(starts)), sizes)
    a, b = [], []
    for offset in range(1, min(SMALL_BUCKET, int(sizes.max()))):
        i = np.flatnonzero((bucket[offset:] == bucket[:-offset]) & small[offset:])
        if not len(i):
            break
        i = i[(own[i] | own[i + offset]) & (np.bitwise_count(values[i] ^ values[i + offset]) <= limit)]
        a.append(values[i])
        b.append(values[i + offset])
    for at, size in zip(starts[sizes > SMALL_BUCKET], sizes[sizes > SMALL_BUCKET]):
        found = np.array(bucket_links(values[at : at + size], own[at : at + size], limit), np.int64).reshape(-1, 2) + at
        a.append(values[found[:, 0]])
        b.append(values[found[:, 1]])
    if a:
        x, y = np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)
        if len(x):
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])


def near_groups(docs: DataFrame, limit: int = LIMIT, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, fp, component_id`` for each row: the smallest id reachable over links."""
    rows = stored(fingerprints(docs, id_column, text_column), "fingerprints")
    distinct = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    parts = plan(*bit_counts(distinct), limit)
    spark = docs.sparkSession
    if parts:
        buckets = listed(distinct, parts).repartition(partitions(spark), "part", "key").sortWithinPartitions("part", "key", F.col("own").desc(), "fp")
        edges = links(buckets, limit)
    else:  # an empty table
        edges = spark.createDataFrame([], "a long, b long")
    named = components(edges)
    # fingerprints without links stay out of the join below
    linked = distinct.join(named, distinct.fp == named.node)
    least = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    of_linked = named.join(least, "component").select(F.col("node").alias("fp"), "component_id")
    of_all = distinct.join(of_linked, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    of_all = stored(of_all, "of_all")
    return rows.join(of_all, "fp").select("doc_id", "fp", "component_id")


def drop_near(docs: DataFrame, limit: int = LIMIT, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One document of each group stays, that with the smallest id; columns as in ``docs``.

    Rows without an id stay where a group has no id at all, and rows that repeat the id
    that stays stay with it: drop exact copies first.
    """
    kept = near_groups(docs, limit, id_column, text_column).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = kept.select(F.col("doc_id").alias("flowlens_kept")).distinct()
    return docs.join(kept, docs[id_column].eqNullSafe(kept["flowlens_kept"]), "left_semi")
