"""Vector code compression: product quantisation with an equal-average search.

Vectors of whole numbers are cut into parts; each part has a codebook of its own, and
a vector's code is the number of the nearest entry in each part. Codebooks start as
the parts of the first vectors and are refined by rounds of assigning all vectors and
replacing entries by means; all in whole numbers, so results do not depend on how rows are dealt.

Nearest entries are found by their *sums*: a part and an entry whose component sums
are g apart are at least g * g / dimension apart (squared distance). Entries are sorted by sum and
tried outward from the part's own sum until that bound is strictly beyond the best
distance; ties, which may lie just at the bound, go to the lower index. Parts are sorted by sum
too, so a tile of them expands together.

Tasks send sums and counts of entries, never vectors; the driver holds the codebooks and one
sum per component of them (``ENTRIES`` times the length of a vector), whatever the number of vectors.

Defined cases: a null vector, null or non-finite components, no components or a number
of them that parts do not divide: the row is dropped; so is a vector of another length
than the one with the smallest id. Fewer vectors than ``ENTRIES`` are all entries; rows that
repeat an id are rows of their own (in the order of their components), null ids come last; equal entries:
the lower index is used; null labels are one label; components of any finite size count exactly, and
an error beyond 64 bits is null; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.session import ship_package

from .common import stored

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Parts that expand together, and entries taken in one step to either side.
TILE, STEP = 256, 16


def cells_of(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label", parts: int = PARTS, scale: int = SCALE) -> DataFrame:
    """``vec_id, label, cells``: the usable vectors as whole numbers, held as doubles, which are exact for any size."""
    v = F.col(vector_column).cast("array<double>")
    usable = (F.size(v) > 0) & (F.size(v) % parts == 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    large = float(1 << 53)  # doubles from here on are whole
    whole = F.transform(v, lambda x: F.when(F.abs(x) * scale < large, F.floor(x * scale).cast("double")).otherwise(x * scale))
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(label_column).alias("label"), F.when(usable, whole).alias("cells"))
    return rows.filter("cells is not null")


def exact_type(largest: float, width: int) -> type:
    """Numbers in which all distances, and sums of a part, of such components are exact."""
    bound = (2 * int(largest) * width) ** 2
    return np.float64 if bound < 1 << 53 else np.int64 if bound < 1 << 62 else object


class Book:
    """The codebook of one part, searched by sums."""

    def __init__(self, entries: np.ndarray):
        sums = entries.sum(1)
        self.order = np.lexsort((np.arange(len(entries)), sums))
        self.entries, self.sums, self.width = entries[self.order], sums[self.order], entries.shape[1]
        self.squares = (self.entries * self.entries).sum(1)

    def nearest(self, rows: np.ndarray, tile: int = TILE, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest entry for each row."""
        sums, squares = rows.sum(1), (rows * rows).sum(1)
        which, best = np.zeros(len(rows), np.int64), np.zeros(len(rows), rows.dtype)
        by_sum = np.argsort(sums, kind="stable")
        for at in range(0, len(rows), tile):
            mine = by_sum[at : at + tile]
            which[mine], best[mine] = self._expand(rows[mine], sums[mine], squares[mine], step)
        return which, best

    def _expand(self, rows: np.ndarray, sums: np.ndarray, squares: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
        low = high = int(np.searchsorted(self.sums, sums[len(sums) // 2]))
        which, best = np.full(len(rows), -1), None
        while True:
            a, b = low, high
            if high < len(self.sums) and self._open(self.sums[high] - sums, best):
                high = min(high + step, len(self.sums))
                which, best = self._try(slice(b, high), rows, squares, which, best)
            if low > 0 and self._open(sums - self.sums[low - 1], best):
                low = max(low - step, 0)
                which, best = self._try(slice(low, a), rows, squares, which, best)
            if (a, b) == (low, high):
                return which, best

    def _open(self, gap: np.ndarray, best: np.ndarray | None) -> bool:
        """Whether entries from this one outward can be as near as the best for any row."""
        return best is None or bool(((gap <= 0) | (gap * gap <= best * self.width)).any())

    def _try(self, part: slice, rows, squares, which, best):
        far = squares[:, None] - 2 * (rows @ self.entries[part].T) + self.squares[part]
        least = far.min(1)
        # of equal distances the lowest index
        index = np.where(far == least[:, None], self.order[part], len(self.order)).min(1)
        if best is None:
            return index, least
        better = (least < best) | ((least == best) & (index < which))
        return np.where(better, index, which), np.where(better, least, best)


def _matrix(column: pa.Array, dtype: type) -> np.ndarray:
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False)).reshape(len(column), -1)
    if dtype is object:
        return np.array([int(x) for x in flat.ravel()], object).reshape(flat.shape)
    return flat.astype(dtype)


def _searched(books: list[np.ndarray], column: pa.Array, dtype: type) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Part by part: its number, the rows' parts, and the nearest entries with their distances."""
    rows, width = _matrix(column, dtype), books[0].shape[1]
    for p, book in enumerate(books):
        mine = np.ascontiguousarray(rows[:, p * width : (p + 1) * width])
        yield p, mine, *Book(book.astype(dtype)).nearest(mine)


def entry_sums(cells: DataFrame, books: list[np.ndarray], dtype: type) -> list:
    """For each part and entry in use how many parts it has and their sums; one row each reaches the driver."""
    shared = cells.sparkSession.sparkContext.broadcast(books)
    width, kind = books[0].shape[1], "string" if dtype is object else "long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        counts = np.zeros((len(books), len(books[0])), np.int64)
        sums = np.zeros((*counts.shape, width), object if dtype is object else np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            for p, mine, which, _ in _searched(books, batch.column(0), dtype):
                order = np.argsort(which, kind="stable")
                used, first = np.unique(which[order], return_index=True)
                counts[p] += np.bincount(which, minlength=counts.shape[1])
                sums[p][used] += np.add.reduceat(mine[order], first, axis=0).astype(sums.dtype)
        p, entry = np.nonzero(counts)
        held = [[str(x) if dtype is object else int(x) for x in row] for row in sums[p, entry]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(p, pa.int32()), pa.array(entry, pa.int32()), pa.array(counts[p, entry], pa.int64()), pa.array(held, pa.list_(pa.string() if kind == "string" else pa.int64()))],
            ["part", "entry", "n", "sums"],
        )

    def whole(frame):
        total = [sum(map(int, column)) for column in zip(*frame["sums"])]
        return frame.iloc[:1].assign(n=frame["n"].sum(), sums=[[str(x) for x in total]])

    ship_package(cells.sparkSession, "flowlens")
    schema = f"part int, entry int, n long, sums array<{kind}>"
    partial = cells.select("cells").mapInArrow(run, schema)
    if dtype is object:  # a row from each task and entry at most
        return partial.groupBy("part", "entry").applyInPandas(whole, schema).collect()
    totals = [F.sum(F.col("sums")[i]) for i in range(width)]
    return partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*totals).alias("sums")).collect()


def codebooks(cells: DataFrame, first: list[list[float]], dtype: type, parts: int = PARTS, rounds: int = ROUNDS) -> list[np.ndarray]:
    """A codebook for each part, as Python integers, after ``rounds`` of assigning and averaging."""
    start = np.array([[int(x) for x in row] for row in first], object)
    width = start.shape[1] // parts
    books = [start[:, p * width : (p + 1) * width].copy() for p in range(parts)]
    for _ in range(rounds):
        for r in entry_sums(cells, books, dtype):
            books[r["part"]][r["entry"]] = [int(x) // r["n"] for x in r["sums"]]
    return books


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for book in books for x in book.ravel()).encode()).hexdigest()


def encoded(cells: DataFrame, books: list[np.ndarray], dtype: type) -> DataFrame:
    """``vec_id, label, code, error`` by the given codebooks."""
    shared = cells.sparkSession.sparkContext.broadcast(books)
    label = cells.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            indexes, errors = [], 0
            for *_, which, best in _searched(shared.value, batch.column(2), dtype):
                indexes.append(which)
                errors = errors + best.astype(object if dtype is object else np.int64)
            code = pa.array(["".join(f"{i:02x}" for i in row) for row in np.stack(indexes, 1).tolist()], pa.string())
            held = [x if x < 1 << 63 else None for x in errors.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), code, pa.array(held, pa.int64())], ["vec_id", "label", "code", "error"])

    ship_package(cells.sparkSession, "flowlens")
    return cells.select("vec_id", "label", "cells").mapInArrow(run, f"vec_id long, label {label}, code string, error long")


def compressed(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
    id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label",
) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` for every usable vector."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits for each part: 1 to 256 entries")
    cells = stored(cells_of(vectors, id_column, vector_column, label_column, parts, scale), "cells")
    order = F.struct(F.col("vec_id").isNull(), "vec_id", "cells")
    seen = cells.agg(F.min_by(F.size("cells"), order).alias("length"), F.max(F.array_max(F.transform("cells", F.abs))).alias("largest"), F.count("*").alias("rows")).first()
    cells = cells.filter(F.size("cells") == (seen.length or 0))
    first = [r.cells for r in cells.orderBy(order).select("cells").limit(entries).collect()]
    if not first:
        return cells.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    dtype = exact_type(seen.largest, seen.length // parts)
    if seen.largest * seen.rows >= 1 << 62:
        dtype = object
    books = codebooks(cells, first, dtype, parts, rounds)
    rows = stored(encoded(cells, books, dtype), "codes")
    total = rows.groupBy("label").agg(F.sum(F.col("error").cast("decimal(20,0)")).alias("total"), F.count("error").alias("known"), F.count("*").alias("n"))
    total = total.select(F.col("label").alias("of"), F.when(F.col("known") == F.col("n"), F.expr("try_cast(total AS long)")).alias("label_error"))
    joined = rows.join(total, F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
