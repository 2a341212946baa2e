"""Which tokens of two tokenizers stand for the same bytes.

Every text is encoded by both; token ends that both have cut its bytes into groups,
and tokens whose bytes overlap are linked. Most groups are one token on either side, with
the same bytes: an *identity map* from ids of A to the B id of the same bytes is made once, and such groups
are counted in a vector as long as A's vocabulary. Only pairs of other, irregular groups
are shuffled to be counted over the corpus.

A document's links are then weighed by these counts. The vector, the highest count of each B id and the
heavy pairs (a share of all links of 1 / ``HEAVY`` or more each, so ``HEAVY`` at most) are sent to all
tasks; the other pairs of a document meet their counts in a join, in which no key is hot, since each
has less than that share.

Defined cases: a null or empty text, and one that either tokenizer does not give back byte by byte,
has no tokens (zeros and '' as digest); null ids and repeated rows are rows of their own and count as they are; ties for
the highest count are all highest; texts above ``CHUNK`` characters are encoded in parts, cut before single
spaces between letters or digits, where neither tokenizer joins anything; without such a
space they are encoded whole; an empty table gives an empty result; only id and text are read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.session import ship_package

from .common import stored

CHUNK, HEAVY, MOST_PAIRS = 1 << 18, 1 << 16, 1 << 18
#: Characters of texts that are aligned together.
BATCH_CHARS = 1 << 18
_CUT = re.compile(r"(?<=[^\W_]) (?=[^\W_])")


def byte_letters() -> dict[str, int]:
    """The byte each letter of a byte-level vocabulary stands for: itself if printable, else the next free letter from U+0100."""
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}


class Tokenizers:
    """Both tokenizers with the bytes of each of their ids."""

    def __init__(self, a_file: bytes, b_file: bytes):
        import sentencepiece
        import tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.a = tokenizers.Tokenizer.from_buffer(a_file)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_file)
        letters = byte_letters()
        held = json.loads(a_file)
        #: a byte-level vocabulary without a normaliser has every byte and changes none
        cut = held["pre_tokenizer"] or {}
        self.a_keeps_bytes = not held["normalizer"] and cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space")
        special = {t["id"] for t in held["added_tokens"]}
        self.a_bytes = [b""] * self.a.get_vocab_size(with_added_tokens=True)
        for token, i in self.a.get_vocab(with_added_tokens=True).items():
            self.a_bytes[i] = token.encode() if i in special else bytes(letters[c] for c in token)
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        #: for each id of A the B id of the same bytes or -1; pieces go before single bytes
        of = {}
        for i, data in enumerate(self.b_bytes):
            if not (self.b.is_control(i) or self.b.is_unknown(i)) and (data not in of or self.b.is_byte(of[data])):
                of[data] = i
        self.same = np.array([of.get(data, -1) if data else -1 for data in self.a_bytes], np.int64)
        self.a_size = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_size = np.array([len(x) for x in self.b_bytes], np.int64)
        self.names = [f"{i}{end}" for n, ends in ((len(self.a_bytes), ",|"), (len(self.b_bytes), ",;")) for i in range(n) for end in ends]

    def encode(self, texts: list[str]) -> list[tuple[list[int], list[int]]]:
        """Ids of space + text by A, and of the text by B; empty where the bytes are not those of space + text."""
        cut = [chunks(t) for t in texts]
        flat = [c for some in cut for c in some]
        a = self.a.encode_batch_fast([f" {c}" for c in flat], add_special_tokens=False)
        b = self.b.encode(flat, num_threads=1)
        out, at = [], 0
        for text, some in zip(texts, cut):
            if len(some) == 1:
                x, y = a[at].ids, b[at]
            else:
                x = [i for e in a[at : at + len(some)] for i in e.ids]
                y = [i for e in b[at : at + len(some)] for i in e]
            at += len(some)
            data = f" {text}".encode()
            same = text and data == b"".join([self.b_bytes[i] for i in y])
            if same and not self.a_keeps_bytes:
                same = data == b"".join([self.a_bytes[i] for i in x])
            out.append((x, y) if same else ([], []))
        return out


def chunks(text: str, size: int = CHUNK) -> list[str]:
    """The text in parts without the spaces between them."""
    out, at = [], 0
    while len(text) - at > size:
        found = _CUT.search(text, at + size)
        if not found:
            break
        out.append(text[at : found.start()])
        at = found.end()
    return [*out, text[at:]]


_HELD: dict[bytes, Tokenizers] = {}


def tokenizers_of(a_file: bytes, b_file: bytes) -> Tokenizers:
    """One pair of tokenizers for each worker process."""
    key = hashlib.sha256(a_file).digest() + hashlib.sha256(b_file).digest()
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = Tokenizers(a_file, b_file)
    return _HELD[key]


class Alignment:
    """Groups and links of several texts at once, one after the other in one row of bytes."""

    def __init__(self, held: Tokenizers, encoded: list[tuple[list[int], list[int]]]):
        self.n = len(encoded)
        self.n_a, self.n_b = (np.array([len(e[k]) for e in encoded], np.int64) for k in (0, 1))
        self.a, self.b = (np.fromiter(chain.from_iterable(e[k] for e in encoded), np.int64, int(n.sum())) for k, n in ((0, self.n_a), (1, self.n_b)))
        self.doc_a, self.doc_b = np.repeat(np.arange(self.n), self.n_a), np.repeat(np.arange(self.n), self.n_b)
        a_end, b_end = np.cumsum(held.a_size[self.a]), np.cumsum(held.b_size[self.b])
        at = np.searchsorted(b_end, a_end)  # never beyond: both end with the same byte
        a_cut = np.flatnonzero(b_end[at] == a_end) + 1 if len(a_end) else np.zeros(0, np.int64)
        self.a_first, self.b_first = np.append(0, a_cut), np.append(0, at[a_cut - 1] + 1)
        common = a_end[a_cut - 1]
        self.of_a, self.of_b = (np.repeat(np.arange(len(common)), np.diff(f)) for f in (self.a_first, self.b_first))
        self.groups = np.bincount(self.doc_a[self.a_first[:-1]], minlength=self.n) if len(common) else np.zeros(self.n, np.int64)
        # one token on either side with the same bytes, as the map has it
        single = (np.diff(self.a_first) == 1) & (np.diff(self.b_first) == 1)
        single[single] = held.same[self.a[self.a_first[:-1][single]]] == self.b[self.b_first[:-1][single]]
        self.same_at = self.a_first[:-1][single]
        low = np.searchsorted(b_end, a_end - held.a_size[self.a], "right")
        met = np.searchsorted(b_end - held.b_size[self.b], a_end, "left") - low
        self.links = np.bincount(self.doc_a, met, self.n).astype(np.int64)
        met[self.same_at] = 0
        self.left = np.repeat(np.arange(len(self.a)), met)
        self.right = np.repeat(low, met) + np.arange(len(self.left)) - np.repeat(np.cumsum(met) - met, met)

    def digests(self, held: Tokenizers) -> list[str]:
        """Digest of the groups of each text, '' without tokens."""
        last_a, last_b = np.zeros(len(self.a), np.int64), np.zeros(len(self.b), np.int64)
        last_a[self.a_first[1:] - 1] = 1
        last_b[self.b_first[1:] - 1] = 1
        order = np.empty(len(self.a) + len(self.b), np.int64)
        order[np.arange(len(self.a)) + self.b_first[self.of_a]] = 2 * self.a + last_a
        order[np.arange(len(self.b)) + self.a_first[self.of_b + 1]] = 2 * len(held.a_bytes) + 2 * self.b + last_b
        words = [held.names[i] for i in order.tolist()]
        ends = np.cumsum(self.n_a + self.n_b).tolist()
        return [hashlib.sha256("".join(words[a:b])[:-1].encode()).hexdigest() if b > a else "" for a, b in zip([0, *ends], ends)]

    def same_counts(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, A id and number of the groups that the identity map covers."""
        keys, n = np.unique(self.doc_a[self.same_at] * size + self.a[self.same_at], return_counts=True)
        return keys // size, keys % size, n

    def pair_counts(self, a_size: int, b_size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, pair (as one number) and number of links of all other groups."""
        pairs = a_size * b_size
        keys, n = np.unique(self.doc_a[self.left] * pairs + self.a[self.left] * b_size + self.b[self.right], return_counts=True)
        return keys // pairs, keys % pairs, n


DOCUMENT, VECTOR, PAIRS = 0, 1, 2
_FIRST = "kind int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, same array<int>, same_n array<int>, pair_a array<int>, pair_b array<int>, pair_n array<long>"


def _lists(owner: np.ndarray, n: int, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Values as one list for each of ``n`` owners; owners ascend."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)), pa.array(values).cast(kind))


def _tally(kind: int, a: np.ndarray, b: np.ndarray, n: np.ndarray, schema: pa.Schema) -> pa.RecordBatch:
    values = {"kind": [kind], "pair_a": [a.tolist()], "pair_b": [b.tolist()], "pair_n": [n.tolist()]}
    return pa.RecordBatch.from_arrays([pa.array(values.get(f.name, [None]), f.type) for f in schema], schema=schema)


def aligned(docs: DataFrame, a_file: bytes, b_file: bytes, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row for each document with its identity groups and irregular pairs, and for each task its
    vector of identity groups and, some at a time, its irregular pairs with their counts."""
    from .common import _arrow_schema

    spark = docs.sparkSession
    files, schema = spark.sparkContext.broadcast((a_file, b_file)), _arrow_schema(spark, _FIRST)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = tokenizers_of(*files.value)
        a_size, b_size = len(held.a_bytes), len(held.b_bytes)
        vector, pairs = np.zeros(a_size, np.int64), []

        def rows(ids: list, texts: list[str]) -> pa.RecordBatch:
            found = Alignment(held, held.encode(texts))
            of_same, same, same_n = found.same_counts(a_size)
            of_pair, pair, pair_n = found.pair_counts(a_size, b_size)
            np.add.at(vector, same, same_n)
            pairs.append((pair, pair_n))
            n, int32 = len(ids), pa.list_(pa.int32())
            columns = [
                pa.array(np.full(n, DOCUMENT, np.int32)), pa.array(ids, pa.int64()), pa.array(found.n_a), pa.array(found.n_b), pa.array(found.groups), pa.array(found.links),
                pa.array(found.digests(held), pa.string()), _lists(of_same, n, same, pa.int32()), _lists(of_same, n, same_n, pa.int32()),
                _lists(of_pair, n, pair // b_size, pa.int32()), _lists(of_pair, n, pair % b_size, pa.int32()), _lists(of_pair, n, pair_n, pa.int64()),
            ]
            return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys, place = np.unique(np.concatenate([p for p, _ in pairs]), return_inverse=True)
            n = np.zeros(len(keys), np.int64)
            np.add.at(n, place, np.concatenate([c for _, c in pairs]))
            return keys, n

        for batch in batches:
            ids, texts, size = [], [], 0
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(i)
                texts.append(text)
                size += len(text)
                if size >= BATCH_CHARS:
                    yield rows(ids, texts)
                    ids, texts, size = [], [], 0
                    if sum(len(p) for p, _ in pairs) > MOST_PAIRS:
                        keys, n = merged()
                        pairs[:] = [(keys, n)]
                        if len(keys) > MOST_PAIRS // 2:
                            yield _tally(PAIRS, keys // b_size, keys % b_size, n, schema)
                            pairs.clear()
            if ids:
                yield rows(ids, texts)
        if pairs:
            keys, n = merged()
            yield _tally(PAIRS, keys // b_size, keys % b_size, n, schema)
        used = np.flatnonzero(vector)
        if len(used):
            yield _tally(VECTOR, used, held.same[used], vector[used], schema)

    ship_package(spark, "flowlens")
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    found = docs.select(F.col(id_column).cast("long"), text).mapInArrow(run, _FIRST)
    return stored(found.withColumn("row", F.monotonically_increasing_id()), "aligned")


def pair_totals(rows: DataFrame) -> DataFrame:
    """``a, b, n, same``: how many links of the corpus hold each pair, and whether the identity map has it."""

    def counted(kind: int) -> DataFrame:
        listed = rows.filter(F.col("kind") == kind).select(F.explode(F.arrays_zip("pair_a", "pair_b", "pair_n")).alias("p"))
        return listed.groupBy(F.col("p.pair_a").alias("a"), F.col("p.pair_b").alias("b")).agg(F.sum("p.pair_n").alias("n")).withColumn("same", F.lit(kind == VECTOR))

    both = counted(PAIRS).union(counted(VECTOR))
    return stored(both.groupBy("a", "b").agg(F.sum("n").alias("n"), F.max("same").alias("same")), "totals")


def weighed(rows: DataFrame, totals: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """The documents with ``n_best`` and ``count_sum`` of their heavy pairs, and their other pairs listed."""
    spark = rows.sparkSession
    links = totals.agg(F.sum("n")).first()[0] or 0
    best = {r.b: r.n for r in totals.groupBy("b").agg(F.max("n").alias("n")).collect()}  # one for each B id
    sent = totals.filter(F.col("same") | (F.col("n") * heavy >= links)).select("a", "b", "n", "same").collect()
    a, b, n, same = (np.array([r[k] for r in sent], np.int64) for k in range(4))
    width = int(max(best, default=0)) + 1
    highest = np.zeros(width, np.int64)
    highest[list(best)] = list(best.values())
    vector, vector_best = np.zeros(int(a.max(initial=0)) + 1, np.int64), np.zeros(int(a.max(initial=0)) + 1, bool)
    one = same > 0
    vector[a[one]], vector_best[a[one]] = n[one], n[one] == highest[b[one]]
    keys = a * width + b
    order = np.argsort(keys)
    shared = spark.sparkContext.broadcast((vector, vector_best, keys[order], n[order], (n == highest[b])[order], width))

    def per_document(owner: np.ndarray, size: int, values: np.ndarray) -> np.ndarray:
        out = np.zeros(size, np.int64)
        np.add.at(out, owner, values)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vector, vector_best, keys, counts, bests, width = shared.value
        for batch in batches:
            size = batch.num_rows
            flat = {name: batch.column(name).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for name in ("same", "same_n", "pair_a", "pair_b", "pair_n")}
            of_same, of_pair = (np.repeat(np.arange(size), np.diff(batch.column(name).offsets.to_numpy())) for name in ("same", "pair_a"))
            total = per_document(of_same, size, flat["same_n"] * vector[flat["same"]])
            top = per_document(of_same, size, flat["same_n"] * vector_best[flat["same"]])
            key = flat["pair_a"] * width + flat["pair_b"]
            at = np.minimum(np.searchsorted(keys, key), max(len(keys) - 1, 0))
            known = keys[at] == key if len(keys) else np.zeros(len(key), bool)
            total += per_document(of_pair[known], size, flat["pair_n"][known] * counts[at[known]])
            top += per_document(of_pair[known], size, flat["pair_n"][known] * bests[at[known]])
            light = [_lists(of_pair[~known], size, flat[name][~known], kind) for name, kind in (("pair_a", pa.int32()), ("pair_b", pa.int32()), ("pair_n", pa.int64()))]
            own = [batch.column(name) for name in names]
            yield pa.RecordBatch.from_arrays([*own, pa.array(top), pa.array(total), *light], [*names, "n_best", "count_sum", "pair_a", "pair_b", "pair_n"])

    names = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    schema = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long, pair_a array<int>, pair_b array<int>, pair_n array<long>"
    documents = rows.filter(F.col("kind") == DOCUMENT).select(*names, "same", "same_n", "pair_a", "pair_b", "pair_n")
    return stored(documents.mapInArrow(run, schema), "weighed")


def alignment(docs: DataFrame, a_path: str, b_path: str, id_column: str = "doc_id", text_column: str = "text", heavy: int = HEAVY) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` for every document."""
    rows = aligned(docs, open(a_path, "rb").read(), open(b_path, "rb").read(), id_column, text_column)
    totals = pair_totals(rows)
    first = weighed(rows, totals, heavy)
    listed = first.select("row", F.explode(F.arrays_zip("pair_a", "pair_b", "pair_n")).alias("p")).select("row", F.col("p.pair_a").alias("a"), F.col("p.pair_b").alias("b"), F.col("p.pair_n").alias("m"))
    highest = totals.groupBy("b").agg(F.max("n").alias("highest"))  # one row for each B id
    counted = totals.join(F.broadcast(highest), "b").select("a", "b", "n", (F.col("n") == F.col("highest")).alias("best"))
    light = listed.join(counted, ["a", "b"]).groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("m")).otherwise(0)).alias("best"), F.sum(F.col("m") * F.col("n")).alias("total"),
    )
    joined = first.drop("pair_a", "pair_b", "pair_n").join(light, "row", "left")
    return joined.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", (F.col("n_best") + F.coalesce("best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("total", F.lit(0))).alias("count_sum"), "groups_sha256",
    )
