"""A training corpus from ``documents``: identified, without copies, mixed to weights, tokenised.

Each stage takes and returns whole rows of ``documents`` (the last one returns token
counts and digests) and works on all that its predecessor kept.

Defined cases: null and empty texts are in no language and go with the first stage; rows
without an id are kept, mixed and encoded like others; of equal or near texts the row named
in the stage stays, ties included; repeated rows are copies of each other; further columns
of ``documents`` pass all stages but the last, whatever their names; an empty table gives
empty results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from flowlens.llm.common import stored
from flowlens.llm.exact_dedup import drop_exact
from flowlens.llm.langid import keep_identified
from flowlens.llm.mixing import repeat_rows
from flowlens.llm.queries import byte_bpe_of
from flowlens.llm.simhash import LIMIT, drop_near

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 4: documents in no language (``und``, those without any letter) go; of other documents the classifier rejects none."""
    return keep_identified(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 6: of equal texts one document stays."""
    return drop_exact(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 3: of each group of near copies (fingerprints over 4-word shingles, at most 4 bits apart) the document with the smallest id stays."""
    return drop_near(docs, LIMIT)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 7: documents are left out, stay or come twice, so that sources have their target numbers of words."""
    return repeat_rows(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 8: every row encoded and decoded again; one row each, so repeated documents are repeated here."""
    return byte_bpe_of(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_codes", language), ("exact_dedup", exact), ("simhash", near), ("mixing", mix), ("byte_bpe", tokens),
]
#: SQL expresses neither the classifiers nor the tokenizer; tests/llm/test_pipeline.py holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are stored as Parquet before the next one reads them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
