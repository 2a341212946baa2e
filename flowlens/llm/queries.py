"""The registered queries of this package and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import round_trip
from .exact_dedup import exact_groups
from .simhash import near_groups
from .warc import archived
from .langid import identified
from .mixing import taken
from .toxicity import toxicity
from .secret_scan import secrets
from .embedding_dedup import near_vectors
from .pii import personal_data
from .quality import quality
from .token_alignment import alignment
from .vector_codes import compressed

Query = Callable[[SparkSession, str], DataFrame]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(_documents(spark, sf_dir)).drop("raw_sha256")


def byte_bpe_of(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe_of(_documents(spark, sf_dir))


def simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_groups(_documents(spark, sf_dir))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def warc_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identified(_documents(spark, sf_dir))


def mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken(_documents(spark, sf_dir))


def toxic_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(_documents(spark, sf_dir))


def near_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def personal_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(_documents(spark, sf_dir))


def quality_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compressed(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES: dict[str, Query] = {
    "op11_attention_quality": quality_of_documents,
    "op12_equal_average_codes": vector_codes,
    "op13_token_alignment": token_alignment,
    "op10_personal_data": personal_spans,
    "op5_sorted_projections": near_embeddings,
    "op1_secrets": secret_spans,
    "op2_toxicity": toxic_documents,
    "op7_mixing": mixing,
    "op4_language_codes": language_codes,
    "op9_warc": warc_captures,
    "op3_simhash": simhash_near_duplicates,
    "op6_exact_dedup": exact_duplicates,
    "op8_byte_bpe": byte_bpe,
}



def _codes_sql() -> str:
    """Four rounds over parts (``x``) and entries (``e0`` to ``e4``), every part against every entry."""
    distance = "list_sum(list_transform(list_zip(x.v, e.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    ranked = "row_number() OVER (PARTITION BY x.rn, x.p ORDER BY {d}, e.k) AS place, {d} AS d"
    near = f"SELECT x.rn, x.p, x.v, e.k, {ranked.format(d=distance)} FROM x JOIN e{{i}} e ON x.p = e.p QUALIFY place = 1"
    rounds = []
    for i in range(4):
        rounds.append(f"""
        a{i} AS MATERIALIZED ({near.format(i=i)}),
        m{i} AS MATERIALIZED (SELECT p, k, list(m ORDER BY c) AS v FROM (
            SELECT p, k, c, CAST(floor(CAST(sum(v[c]) AS DOUBLE) / count(*)) AS BIGINT) AS m FROM a{i}, (SELECT unnest(range(1, 1 + (SELECT w FROM width))) AS c)
            GROUP BY ALL) GROUP BY ALL),
        e{i + 1} AS MATERIALIZED (SELECT e.p, e.k, coalesce(m{i}.v, e.v) AS v FROM e{i} e LEFT JOIN m{i} ON e.p = m{i}.p AND e.k = m{i}.k),""")
    return f"""
        WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(x * 1024.0::DOUBLE) AS BIGINT)) AS v,
                             row_number() OVER (ORDER BY vec_id) - 1 AS rn
                      FROM embeddings
                      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        width AS (SELECT max(len(v)) // 4 AS w FROM kept),
        x AS MATERIALIZED (SELECT rn, p, v[p * w + 1 : (p + 1) * w] AS v FROM kept, width, (SELECT unnest(range(4)) AS p)),
        e0 AS MATERIALIZED (SELECT p, rn AS k, v FROM x WHERE rn < 256),
        {"".join(rounds)}
        a4 AS MATERIALIZED ({near.format(i=4)}),
        coded AS (SELECT rn, string_agg(printf('%02x', k), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a4 GROUP BY rn),
        books AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, k)) AS codebooks_sha256 FROM e4)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
        FROM kept JOIN coded USING (rn), books"""


ORACLES: dict[str, str] = {
    "op12_equal_average_codes": _codes_sql(),
    "op9_warc": r"""
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS digest FROM pages),
             g AS (SELECT *, max(page_id) OVER (PARTITION BY digest) AS last FROM p)
        SELECT page_id, n AS payload_bytes, digest AS payload_digest,
               CASE WHEN n >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 1000 AND page_id < last THEN last END AS refers_to, 2 AS n_company
        FROM g""",
    "op6_exact_dedup": r"""
        WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n,
                          regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents)
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               row_number() OVER w = 1 AS kept, sha256(t) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY t ORDER BY n DESC, doc_id)""",
}
