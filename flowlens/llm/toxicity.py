"""Toxicity by compression distance.

Two zstandard dictionaries are trained from labelled documents: one on ordinary
text, one on the same base followed by what is typical of toxic text. A window of a
few words that compresses better with the second is nearer to toxic text; without
toxic passages the two lengths hardly differ, whatever the language. The strongest
windows of the whole text give the document's score through a logistic curve that
is calibrated on the learning rows; as only words beyond chance enter the toxic
dictionary, these rows are not scored much better than others.

Fitted on at most ``SAMPLE_ROWS`` labelled rows of each kind, of these on ``SAMPLE_CHARS``
characters each, on ``TRAINING_WINDOWS`` ordinary windows spread evenly over all of them and on typical words of
``WORD_BYTES`` bytes, the most surprising first; scoring reads every row and every window of it.

Defined cases: null texts count as empty and get the score of a text without windows;
rows without a label are scored, never learned from; if either kind of label is missing,
every score is the share of toxic rows (0.0 without any); repeated rows count as they
are and get equal scores, and a score of just 0.5 is toxic; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, map_rows, stored, utf8

SAMPLE_ROWS, SAMPLE_CHARS = 2000, 20_000
WINDOW_WORDS, STRIDE_WORDS = 8, 4
BASE_BYTES, TOXIC_BYTES, WORD_BYTES = 32 << 10, 4 << 10, 32 << 10
TRAINING_WINDOWS = 60_000
LEVEL, TOP = 3, 4
CHANCE = 0.05


def words(data: bytes) -> list[bytes]:
    """Lower-case words without the signs around them."""
    return [w.strip(b".,;:!?\"'()|") for w in data.lower().split()]


def windows(data: bytes, stride: int = STRIDE_WORDS) -> list[bytes]:
    """Windows over all words of a text; they overlap unless ``stride`` is their length."""
    listed = words(data)
    last = max(1, len(listed) - WINDOW_WORDS + stride)
    return [b" " + b" ".join(listed[i : i + WINDOW_WORDS]) + b" " for i in range(0, last, stride)] if listed else []


def _trained(samples: list[bytes], size: int) -> bytes:
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: they are the dictionary
        return b"".join(samples)[-size:]


def typical_words(toxic: list[bytes], ordinary: list[bytes]) -> dict[bytes, float]:
    """Words that are typical of toxic texts, and how surprising that is.

    A word is typical if the texts that hold it are toxic so much more often than
    others that chance would not bring about one such word in all the vocabulary.
    Toxic texts that have it after the same word count once: copies prove nothing.
    """
    before = defaultdict(set)
    for text in toxic:
        listed = words(text)
        for w, previous in dict(zip(listed[1:], listed)).items():
            before[w].add(previous)
    of_toxic = {w: len(b) for w, b in before.items()}
    of_ordinary = Counter(w for t in ordinary for w in set(words(t)))
    share = len(toxic) / (len(toxic) + len(ordinary))
    need = math.log(len(of_toxic.keys() | of_ordinary.keys()) / CHANCE)

    def surprise(n: int, others: int) -> float:  # Chernoff's bound on a binomial tail
        total = n + others
        if n / total <= share:
            return 0.0
        rest = others * math.log(others / total / (1 - share)) if others else 0.0
        return n * math.log(n / total / share) + rest

    found = {w: surprise(n, of_ordinary[w]) for w, n in of_toxic.items() if len(w) > 2}
    return {w: s for w, s in found.items() if s >= need}


def excerpts(toxic: list[bytes], ordinary: list[bytes]) -> list[bytes]:
    """Of each toxic text the words that are typical of toxic ones."""
    return picked_words(toxic, typical_words(toxic, ordinary))


def picked_words(toxic: list[bytes], typical: dict[bytes, float]) -> list[bytes]:
    picked = ([w for w in words(t) if w in typical] for t in toxic)
    return [b" " + b" ".join(p) + b" " for p in picked if p]


def each_once(typical: dict[bytes, float], size: int) -> bytes:
    """The typical words, the most surprising ones that ``size`` bytes hold, in alphabetical order."""
    kept, used = [], 0
    for word in sorted(typical, key=lambda w: (-typical[w], w)):
        used += len(word) + 1
        if used > size:
            break
        kept.append(word)
    return b" ".join(sorted(kept))


def evenly(items: list, most: int) -> list:
    """At most ``most`` items, spread evenly over all."""
    return items if len(items) <= most else [items[i * len(items) // most] for i in range(most)]


@dataclass(frozen=True)
class Dictionaries:
    ordinary: bytes
    toxic: bytes

    @classmethod
    def train(cls, toxic: list[bytes], ordinary: list[bytes]) -> Dictionaries:
        typical = typical_words(toxic, ordinary)
        extra = _trained(picked_words(toxic, typical), TOXIC_BYTES) if typical else b""
        # training may leave out rare ones
        extra = extra + b" " + each_once(typical, WORD_BYTES) + b" "
        plain = evenly([w for t in ordinary for w in windows(t, WINDOW_WORDS)], TRAINING_WINDOWS)
        base = _trained(plain, BASE_BYTES)
        # a filler that no text holds keeps lengths equal: the compressor's own tables are then laid out alike
        return cls(base + b"\x01" * len(extra), base + extra)

    def compressors(self):
        return [
            zstandard.ZstdCompressor(
                level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT),
                write_checksum=False, write_content_size=False, write_dict_id=False,
            )
            for d in (self.ordinary, self.toxic)
        ]


class Scorer:
    def __init__(self, dictionaries: Dictionaries):
        self.ordinary, self.toxic = dictionaries.compressors()

    def features(self, data: bytes) -> np.ndarray:
        """Bytes saved by the toxic dictionary: best window and mean of the best few, and how many windows
        there were. Windows that are alike count once."""
        ordinary, toxic = self.ordinary.compress, self.toxic.compress
        saved = np.array([len(ordinary(w)) - len(toxic(w)) for w in dict.fromkeys(windows(data))], float)
        if not len(saved):
            return np.array([1.0, 0.0, 0.0, 0.0])
        best = np.sort(saved)[::-1][:TOP]
        return np.array([1.0, best[0], best.sum() / TOP, np.log1p(len(saved))])


@dataclass(frozen=True)
class ToxicityModel:
    dictionaries: Dictionaries | None
    weights: np.ndarray
    share: float

    @classmethod
    def fit(cls, labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> ToxicityModel:
        """From ``doc_id, text, toxic``; at most ``sample_rows`` rows of either label, at most ``SAMPLE_CHARS`` of each."""
        usable = labelled.filter("text is not null and toxic in (0, 1)").select(F.substring("text", 1, SAMPLE_CHARS).alias("text"), F.col("toxic").cast("int").alias("toxic"), F.xxhash64("doc_id", "text").alias("draw"))
        rows = {}
        for label in (0, 1):
            drawn = bounded_sample(usable.filter(F.col("toxic") == label), sample_rows, F.col("draw"))
            rows[label] = [r.text.encode() for r in drawn.collect()]
        ordinary, toxic = rows[0], rows[1]
        if not ordinary or not toxic:
            return cls(None, np.zeros(4), 1.0 if toxic else 0.0)
        dictionaries = Dictionaries.train(toxic, ordinary)
        scorer = Scorer(dictionaries)
        x = np.array([scorer.features(t) for t in [*ordinary, *toxic]])
        y = np.repeat([0.0, 1.0], [len(ordinary), len(toxic)])
        return cls(dictionaries, logistic(x, y), len(toxic) / len(y))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.01) -> np.ndarray:
    """Weights by Newton's method; both labels weigh alike."""
    weight = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) * len(y)
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - y)) + ridge * w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + (ridge + 1e-9) * np.eye(x.shape[1])
        move = np.linalg.solve(curve, slope)
        w -= move
        if np.abs(move).max() < 1e-8:
            break
    return w


def score(docs: DataFrame, model: ToxicityModel, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, score, predicted`` for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        learned = shared.value
        scorer = Scorer(learned.dictionaries) if learned.dictionaries else None

        def one(row):
            p = learned.share
            if scorer:
                p = float(1 / (1 + np.exp(-np.clip(scorer.features(row[1]) @ learned.weights, -30, 30))))
            yield row[0], p, int(p >= 0.5)

        return one

    return map_rows(docs.select(F.col(id_column).cast("long"), utf8(text_column)), "doc_id long, score double, predicted int", make)


def held_out(id_column: str = "doc_id"):
    """Whether a row's label is not learned from; rows without an id are never held out."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every document; a document with several labels is learned by the highest."""
    return score(docs, ToxicityModel.fit(learning_rows(docs, labels))).withColumn("held_out", held_out())


def learning_rows(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``doc_id, text, toxic`` of a bounded number of labelled documents that are not held out.

    They are drawn by id from the labels of documents that exist, so texts are not
    shuffled: the drawn ids, at most ``2 * sample_rows``, are sent to where the texts are.
    """
    known = labels.filter("toxic in (0, 1) and doc_id is not null").filter(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    there = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    drawn = [bounded_sample(there.filter(F.col("toxic") == x), sample_rows, F.xxhash64("doc_id")) for x in (0, 1)]
    ids = stored(drawn[0].union(drawn[1]), "drawn")
    return stored(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id"), "learned")
