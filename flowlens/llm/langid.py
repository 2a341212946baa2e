"""Language identification with error-correcting output codes.

Every language gets a codeword of bits; a binary classifier per bit is trained on
hashed character n-grams. A text is scored bit by bit from the n-grams of its
whole length, and the codeword of least loss wins, each bit weighted by how well
its classifier does on the training rows. The distance to the runner-up says how
ambiguous the answer is.

The classifiers are fitted on a sample of at most ``sample_rows`` labelled rows, as many
of each language (``LanguageModel.fit``), and so on as many languages at most, the most frequent ones;
prediction reads every row and the whole of every text.

Defined cases: null texts and texts without a letter are ``und`` with score 0;
rows without a language are never learned from; a single language is learned as
such; without any labelled row all texts are ``und``; of codewords with equal loss the first language in
the order of names wins; repeated rows weigh what they are; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.session import ship_package

from .common import map_rows

FEATURES, ORDERS, BITS = 1 << 13, (1, 2, 3), 15
SAMPLE_ROWS, SAMPLE_CHARS = 2000, 4000
UNKNOWN = "und"
#: Scores below this are too close to call.
AMBIGUOUS = 0.55
_PRIMES = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35], np.uint32)


def gram_counts(text: str) -> np.ndarray:
    """Counts of hashed n-grams of a whole lower-case text; what is no letter counts as one blank."""
    counts = np.zeros(FEATURES)
    for at in range(0, max(len(text), 1), 1 << 20):  # long texts pass in blocks that overlap
        block = text[max(0, at - max(ORDERS) + 1) : at + (1 << 20)].lower()
        codes = np.frombuffer(block.encode("utf-32-le"), np.uint32)
        codes = np.where((codes < 128) & ~((codes > 96) & (codes < 123)), np.uint32(32), codes)
        for n in ORDERS:
            if len(codes) < n:
                continue
            key = np.full(len(codes) - n + 1, n, np.uint32)
            for k in range(n):
                key = (key ^ codes[k : len(codes) - n + 1 + k]) * _PRIMES[k]
                key ^= key >> np.uint32(15)
            if at:  # grams that end before the block were counted with the one before
                key = key[max(ORDERS) - n :]
            counts += np.bincount(key & np.uint32(FEATURES - 1), minlength=FEATURES)
    return counts


def features(text: str) -> np.ndarray:
    """Square roots of the counts at unit length."""
    x = np.sqrt(gram_counts(text))
    return x / max(float(np.linalg.norm(x)), 1e-12)


def codewords(n: int, bits: int = BITS, seed: int = 7) -> np.ndarray:
    """n rows of +1 and -1, far apart from each other; columns differ and none is constant."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 4:  # every way to divide so few languages
        columns = [c for c in itertools.product((1, -1), repeat=n) if c[0] == 1 and len(set(c)) == 2]
        return np.array(columns, float).T
    r, best, widest = np.random.default_rng(seed), None, -1.0
    bits = max(bits, int(np.ceil(4 * np.log2(n))))
    for _ in range(200):
        code = np.where(r.random((n, bits)) < 0.5, 1.0, -1.0)
        if (np.abs(code.sum(0)) == n).any():
            continue
        closest = ((bits - code @ code.T) / 2 + np.eye(n) * bits).min()
        if closest > widest:
            best, widest = code, closest
    return best if best is not None else np.where(r.random((n, bits)) < 0.5, 1.0, -1.0)


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    code: np.ndarray  # language x bit
    weights: np.ndarray  # feature x bit
    bias: np.ndarray
    trust: np.ndarray  # per bit

    @classmethod
    def fit(cls, labelled: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS, rounds: int = 120) -> LanguageModel:
        """From ``doc_id, text, lang``. At most ``sample_rows`` rows, as many of each language, of at most ``sample_chars`` each."""
        usable = labelled.filter("text is not null and lang is not null").select(
            F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"),
            F.xxhash64("doc_id", "text").alias("draw"),
        )
        # a sample has no room for more languages than rows
        seen = {r.lang: r["count"] for r in usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(sample_rows).collect()}
        if not seen:
            return cls((), np.ones((0, 1)), np.zeros((FEATURES, 1)), np.zeros(1), np.ones(1))
        each = max(1, sample_rows // len(seen))
        # more than wanted, so that no language goes without; all rows of rare ones
        shares = F.create_map(*[F.lit(x) for lang, n in seen.items() for x in (lang, min(1.0, (2.0 * each + 32) / n))])
        chance = F.pmod(F.xxhash64("draw"), F.lit(1 << 30)) / float(1 << 30)
        drawn = usable.filter(chance < F.coalesce(F.try_element_at(shares, F.col("lang")), F.lit(0.0)))
        place = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "text"))
        drawn = drawn.select(F.substring("text", 1, sample_chars).alias("text"), "lang", "draw").withColumn("place", place)
        rows = drawn.filter(F.col("place") <= each).orderBy("draw", "text", "lang").collect()
        languages = tuple(sorted({r.lang for r in rows}))
        y = np.array([languages.index(r.lang) for r in rows])
        x = np.empty((len(rows), FEATURES), np.float32)  # the one large thing the driver holds
        for i, r in enumerate(rows):
            x[i] = features(r.text)
        code = codewords(len(languages))
        target = (code[y] > 0).astype(np.float32)
        # rows weigh so that each language counts alike
        weight = (1.0 / np.bincount(y, minlength=len(languages)))[y][:, None]
        weight = (weight / weight.sum()).astype(np.float32)
        w, b = np.zeros((FEATURES, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
        speed_w, speed_b = np.zeros_like(w), np.zeros_like(b)
        for _ in range(rounds):  # logistic regression, accelerated gradient descent
            error = (1 / (1 + np.exp(-(x @ w + b))) - target) * weight
            speed_w = 0.9 * speed_w - 4.0 * (x.T @ error + 1e-5 * w)
            speed_b = 0.9 * speed_b - 1.0 * error.sum(0)
            w, b = w + speed_w, b + speed_b
        margin = (x @ w + b) * code[y]
        wrong = ((margin <= 0) * weight).sum(0)
        trust = np.clip(np.log((1 - wrong + 1e-3) / (wrong + 1e-3)), 0.05, None)
        return cls(languages, code, w, b, trust / trust.sum())

    def decode(self, text: str) -> tuple[str, float]:
        """The language whose codeword loses least, and its share among all codewords."""
        if not self.languages or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        bits = features(text) @ self.weights + self.bias
        loss = np.logaddexp(0, -self.code * bits) @ self.trust
        odds = np.exp(-(loss - loss.min()) * self.code.shape[1])
        best = int(np.argmin(loss))
        return self.languages[best], float(odds[best] / odds.sum())


def predict(docs: DataFrame, model: LanguageModel, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score, ambiguous`` for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        learned = shared.value

        def one(row):
            lang, score = learned.decode(row[1])
            yield row[0], lang, score, score < AMBIGUOUS

        return one

    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    return map_rows(docs.select(F.col(id_column).cast("long"), text), "doc_id long, lang_pred string, score double, ambiguous boolean", make)


def held_out(id_column: str = "doc_id", folds: int = 4, fold: int = 2):
    """Whether a row belongs to the fold that is not learned from; rows without an id are."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % folds == fold, F.lit(False))


def identified(docs: DataFrame, **fit) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, ambiguous``: learned from the rows that are not held out, predicted for all."""
    model = LanguageModel.fit(docs.filter(~held_out()), **fit)
    return predict(docs, model).withColumn("held_out", held_out())


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with a language: rows that are ``und`` go. Columns as in ``docs``."""
    model = LanguageModel.fit(docs.filter(~held_out()))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def known(texts):
        return texts.map(lambda t: shared.value.decode(t)[0] != UNKNOWN).astype(bool)

    ship_package(docs.sparkSession, "flowlens")
    return docs.filter(known(F.coalesce(F.col("text").cast("string"), F.lit(""))))
