"""Helpers shared by the operators of this package."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.session import shared_dir, ship_package

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` below ``spark.checkpoint.dir`` and reads it back, which cuts its lineage.

    Unlike a cached table the copy outlives lost executors. The folder
    (``flowlens-llm/<run>``) is the caller's to remove once the result is written.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession) -> str:
    """One folder per session for what operators store between steps."""
    context = spark.sparkContext
    if not hasattr(context, "_flowlens_scratch"):
        context._flowlens_scratch = f"{shared_dir(spark).rstrip('/')}/flowlens-llm/{uuid.uuid4().hex[:12]}"
    return context._flowlens_scratch


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8(column: str) -> Column:
    """A text as bytes; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")


def bounded_sample(df: DataFrame, rows: int, draw: Column) -> DataFrame:
    """At most ``rows`` rows, drawn by a hash and in its order.

    Rows are thinned to about twice as many where they are read, so that what
    reaches the driver does not grow with the number of partitions.
    """
    total = df.count()
    if total > 2 * rows:
        df = df.filter(F.pmod(F.xxhash64(draw), F.lit(1 << 40)) < int(2 * rows / total * (1 << 40)))
    return df.orderBy(draw).limit(rows)


def map_rows(df: DataFrame, schema: str, make: Callable[[], Callable[[tuple], Iterator[tuple]]], rows: int = 512) -> DataFrame:
    """Runs Python over the rows of each partition, Arrow batch by Arrow batch.

    ``make()`` runs once per task and returns the function that turns a row
    (a tuple in column order) into any number of output tuples. Output leaves in
    batches of ``rows``, so a task holds one input batch and one output batch.
    """
    ship_package(df.sparkSession, "flowlens")
    target = _arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each, out = make(), []
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                for row in zip(*(c.to_pylist() for c in part.columns)):
                    out.extend(each(row))
                    if len(out) >= rows:
                        yield _batch(out, target)
                        out = []
        if out:
            yield _batch(out, target)

    return df.mapInArrow(run, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema)], schema=schema)


def _arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], ddl).schema)


def same(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    """Null-safe equality of columns that both sides have."""
    condition = F.lit(True)
    for n in names:
        condition &= left[n].eqNullSafe(right[n])
    return condition
