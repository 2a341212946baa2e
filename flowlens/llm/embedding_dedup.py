"""Near-duplicate vectors by sorted projection passes.

In each pass vectors are ordered by label and by the signs of their random
projections, read as one long word; every vector is compared with its next
neighbours in that order. Pairs that are near enough are united over all passes.
Passes only have to *connect* groups: in the end all vectors of a group are compared
in blocks, so links and their numbers are exact within it. The number of passes
follows from the size of the largest label and the recall asked for, as if vectors were spread
evenly. Where they crowd, signs tell them apart less well: this is measured in each
pass, and vectors for which the recall is not met are compared with each other in blocks.

Identical vectors of one label are one node throughout, so copies never meet one
by one. Defined cases: a null label or vector, a zero vector and vectors with null or
non-finite components link with nothing (``n_links`` 0, own component); vectors of
different lengths never link; repeated ids are rows of their own that link like others,
and null ids never name a component unless it has no other; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.session import ship_package

from .common import partitions, stored
from .components import components
from .simhash import Forest

THRESHOLD, WINDOW, RECALL = 0.93, 32, 0.995
WORD_BITS = 63
#: Vectors a block of the sorted order, and of a group when it is compared as a whole.
BLOCK, GROUP_BLOCK = 4096, 1024


def passes(largest: int, threshold: float = THRESHOLD, window: int = WINDOW, recall: float = RECALL) -> int:
    """Passes after which a pair just at the threshold has been neighbours with chance ``recall``.

    To be within the window two vectors need equal leading signs, as many as it takes
    to tell the vectors of a label apart; each is equal with chance 1 - angle / pi.
    """
    bits = max(0.0, math.log2(max(largest, 1) / window))
    chance = (1 - math.acos(threshold) / math.pi) ** bits
    return 1 if chance >= recall else max(2, math.ceil(math.log(1 - recall) / math.log(1 - chance)))


def nodes_of(vectors: DataFrame, id_column: str, vector_column: str, label_column: str) -> tuple[DataFrame, DataFrame]:
    """All rows (``vec_id, label, v``; v is null if it links with nothing) and the distinct vectors (``node, label, v, copies, least``)."""
    double = F.col(vector_column).cast("array<double>")
    usable = (
        F.col(label_column).isNotNull() & double.isNotNull() & F.forall(double, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(double, lambda x: x != 0)
    )
    # -0.0 and 0.0 are the same component
    clean = F.transform(double, lambda x: x + F.lit(0.0))
    rows = vectors.select(
        F.col(id_column).cast("long").alias("vec_id"), F.col(label_column).cast("string").alias("label"), F.when(usable, clean).alias("v"),
    )
    grouped = rows.filter("v is not null").groupBy("label", "v").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    return rows, stored(grouped.withColumn("node", F.monotonically_increasing_id()), "nodes")


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit vectors, one a row, from lists of equal length."""
    m = np.asarray(column.flatten().to_numpy(zero_copy_only=False)).reshape(len(column), -1)
    m = m / np.abs(m).max(1, keepdims=True)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _by_length(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    lengths = np.diff(batch.column(at).offsets.to_numpy())
    for n in np.unique(lengths):
        yield batch if (lengths == n).all() else batch.filter(pa.array(lengths == n))


def codes(nodes: DataFrame, count: int, seed: int = 11) -> DataFrame:
    """``pass, label, size, code, node, v`` for each pass: the signs of WORD_BITS projections as one number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _by_length(whole, 2):
                unit = _matrix(batch.column(2))
                for p in range(count):
                    signs = unit @ np.random.default_rng((seed, p)).standard_normal((unit.shape[1], WORD_BITS)) > 0
                    code = signs @ (np.int64(1) << np.arange(WORD_BITS - 1, -1, -1, dtype=np.int64))
                    n = len(unit)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, p, np.int32)), batch.column(1), pa.array(np.full(n, unit.shape[1], np.int32)), pa.array(code), batch.column(0), batch.column(2)],
                        ["pass", "label", "size", "code", "node", "v"],
                    )

    ship_package(nodes.sparkSession, "flowlens")
    return nodes.select("node", "label", "v").mapInArrow(run, "pass int, label string, size int, code long, node long, v array<double>")


def neighbours(coded: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """The sorted order in blocks: each row with its place, and the first ``window`` rows of a block also at the end of the one before."""
    spark = coded.sparkSession
    keys = ["pass", "label", "size", "code", "node"]
    ordered = coded.repartitionByRange(partitions(spark), *keys).sortWithinPartitions(*keys)
    ordered = stored(ordered.withColumn("row", F.monotonically_increasing_id()), "ordered")
    part = F.shiftrightunsigned("row", 33)
    counts = {r.part: r["count"] for r in ordered.groupBy(part.alias("part")).count().collect()}  # a row per partition
    before, start = 0, {}
    for p in sorted(counts):
        start[p], before = before, before + counts[p]
    starts = spark.createDataFrame(sorted(start.items()) or [(0, 0)], "part long, start long")
    placed = ordered.withColumn("part", part).join(F.broadcast(starts), "part")
    place = F.col("start") + F.col("row").bitwiseAND(F.lit((1 << 33) - 1))
    own = F.floor(place / block)
    blocks = F.when((place % block < window) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    return placed.select("pass", "label", "node", "v", "code", place.alias("place"), F.explode(blocks).alias("block"))


def _blocks(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.Table]:
    """Rows with equal values in column ``at``, which follow each other."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        values = batch.column(at).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if held and held[-1].column(at)[0] != batch.column(at)[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def near_neighbours(blocks: DataFrame, threshold: float = THRESHOLD, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """``a, b``: a spanning forest of the near pairs within the window, block by block.

    Rows without ``b`` say for node ``a`` in a pass with which chance, as a logarithm
    in ``missed``, a vector at the threshold was not among its neighbours: it is among them
    if it shares more leading signs than the vector at the window's end does.
    """
    same_sign = 1 - math.acos(threshold) / math.pi

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _blocks(batches, 4):
            lengths = pa.compute.list_value_length(table["v"]).to_numpy()
            group = np.unique([f"{p} {n} {x}" for p, n, x in zip(table["pass"].to_pylist(), lengths, table["label"].to_pylist())], return_inverse=True)[1]
            node = table["node"].to_numpy()
            unit = np.zeros((len(node), lengths.max()))
            for n in np.unique(lengths):
                mine = lengths == n
                unit[mine, :n] = _matrix(table["v"].filter(pa.array(mine)).combine_chunks())
            forest, edges = Forest(len(node)), []
            for d in range(1, min(window, len(node) - 1) + 1):
                near = (group[d:] == group[:-d]) & (np.einsum("ij,ij->i", unit[d:], unit[:-d]) >= threshold)
                edges += [(node[i], node[i + d]) for i in np.flatnonzero(near) if forest.join(i, i + d)]
            if edges:
                a, b = np.array(edges, np.int64).T
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.float64())], ["a", "b", "missed"])
            # a row at the window's end in either direction says how many signs it takes
            code, most = table["code"].to_numpy(), np.zeros(len(node))
            if len(node) > window:
                differ = code[window:] ^ code[:-window]
                shared = np.where(differ > 0, WORD_BITS - 1 - np.floor(np.log2(np.maximum(differ, 1).astype(float))), WORD_BITS)
                shared = np.where(group[window:] == group[:-window], shared + 1, 0)
                most[:-window], most[window:] = shared, np.maximum(most[window:], shared)
            own = table["place"].to_numpy() // block == table["block"].to_numpy()
            missed = np.log(np.maximum(1 - same_sign ** most[own], 1e-300))
            yield pa.RecordBatch.from_arrays([pa.array(node[own]), pa.nulls(int(own.sum()), pa.int64()), pa.array(missed)], ["a", "b", "missed"])

    spark = blocks.sparkSession
    ordered = blocks.select("pass", "label", "node", "v", "block", "place", "code").repartition(partitions(spark), "block").sortWithinPartitions("block", "place")
    return stored(ordered.mapInArrow(run, "a long, b long, missed double"), "met")


def crowded_links(nodes: DataFrame, met: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, block: int = GROUP_BLOCK) -> DataFrame:
    """``a, b``: links among the vectors whose neighbourhood is too crowded for the windows, by comparing all of a label."""
    missed = met.filter("missed is not null").groupBy("a").agg(F.exp(F.sum("missed")).alias("missed"))
    crowded = missed.filter(F.col("missed") > 1 - recall).select(F.col("a").alias("node"))
    members = stored(nodes.join(crowded, "node").select(F.xxhash64("label", F.size("v")).alias("component"), "label", "node", "copies", "v"), "crowded")
    return _compared(members.select("component", "node", "copies", "v"), _links, "a long, b long", threshold, block)


def _links(unit: np.ndarray, node: np.ndarray, copies: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float) -> pa.RecordBatch:
    """A spanning forest of the links between two blocks."""
    part, edges = np.arange(len(unit)), []
    for at in range(0, len(left), 512):
        for i, near in zip(left[at : at + 512], unit[left[at : at + 512]] @ unit[right].T >= threshold):
            hits = right[near]
            parts, first = np.unique(part[hits], return_index=True)
            new = parts != part[i]
            if new.any():
                edges += [(node[i], node[hits[k]]) for k in first[new]]
                part[np.isin(part, parts[new])] = part[i]
    a, b = np.array(edges, np.int64).reshape(-1, 2).T
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _counts(unit: np.ndarray, node: np.ndarray, copies: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float) -> pa.RecordBatch:
    linked, same = np.zeros(len(unit), np.int64), np.array_equal(left, right)
    for at in range(0, len(left), 512):
        i = left[at : at + 512]
        near = unit[i] @ unit[right].T >= threshold
        if same:
            near[np.arange(len(i)), at + np.arange(len(i))] = False
        linked[i] += near @ copies[right]
        if not same:
            linked[right] += near.T @ copies[i]
    return pa.RecordBatch.from_arrays([pa.array(node), pa.array(linked)], ["node", "linked"])


def counted_links(members: DataFrame, threshold: float = THRESHOLD, block: int = GROUP_BLOCK) -> DataFrame:
    """``node, linked``: rows linked to each node within its group, by comparing every two blocks of a group once.

    ``members``: component, node, copies, v. A node of a group of n blocks is sent to
    n pairs of blocks; nothing is emitted but one count for each.
    """
    counted = _compared(members, _counts, "node long, linked long", threshold, block)
    return counted.groupBy("node").agg(F.sum("linked").alias("linked"))


def _compared(members: DataFrame, each, schema: str, threshold: float, block: int) -> DataFrame:
    """``each`` for every two blocks of a group, once."""
    spark = members.sparkSession
    sizes = members.groupBy("component").agg(F.ceil(F.count("*") / float(block)).cast("int").alias("n"))
    mine = F.pmod(F.xxhash64("node"), F.col("n")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("n") - 1))
    spread = members.join(sizes, "component").withColumn("mine", mine).withColumn("other", other)
    task = F.xxhash64("component", F.least("mine", "other"), F.greatest("mine", "other"))
    keys = ["task", "component", "low", "high", "mine", "node"]
    ordered = spread.select(task.alias("task"), "component", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), "mine", "node", "copies", "v")
    ordered = ordered.repartition(partitions(spark), "task", "component", "low", "high").sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for same in _blocks(batches, 0):
            for whole in _blocks(iter(same.combine_chunks().to_batches()), 1):
                for table in (t for low in _blocks(iter(whole.to_batches()), 2) for t in _blocks(iter(low.to_batches()), 3)):
                    unit, copies = _matrix(table["v"].combine_chunks()), table["copies"].to_numpy()
                    side, low, high = table["mine"].to_numpy(), table["low"][0].as_py(), table["high"][0].as_py()
                    yield each(unit, table["node"].to_numpy(), copies, np.flatnonzero(side == low), np.flatnonzero(side == high), threshold)

    return ordered.mapInArrow(run, schema)


def near_vectors(
    vectors: DataFrame, threshold: float = THRESHOLD, window: int = WINDOW, recall: float = RECALL,
    id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label",
) -> DataFrame:
    """``vec_id, n_links, component_id, kept``: one row per vector."""
    rows, nodes = nodes_of(vectors, id_column, vector_column, label_column)
    largest = nodes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    blocks = neighbours(codes(nodes, passes(largest, threshold, window, recall)), window)
    met = near_neighbours(blocks, threshold, window)
    links = met.filter("b is not null").select("a", "b").union(crowded_links(nodes, met, threshold, recall))
    named = stored(components(links), "named")
    members = stored(nodes.join(named, "node").select("component", "node", "copies", "least", "v"), "members")
    linked = counted_links(members, threshold)
    least = members.groupBy("component").agg(F.min("least").alias("component_id"))
    of_members = members.join(linked, "node").join(least, "component").select("node", "linked", "component_id")
    of_nodes = nodes.join(of_members, "node", "left").select(
        "label", "v", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"),
        F.coalesce("component_id", "least").alias("component_id"),
    )
    joined = rows.join(stored(of_nodes, "of_nodes"), ["label", "v"], "left")
    component = F.coalesce("component_id", "vec_id")
    return joined.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
