"""Document quality by attention over passages.

A document is a bag of passages, ``PASSAGE_WORDS`` words each, over its whole text; only
the document has a label. Every passage is encoded: how often its kinds of characters
and neighbouring kinds occur, and how its words repeat, through a small layer. A gated
attention (tanh of one projection times the logistic of another) weighs the passages,
and the weighted mean of their codes is scored. All weights are learned together from
document labels by gradient descent.

Fitted on at most ``SAMPLE_ROWS`` labelled documents of either label (where ids repeat, on four times
as many rows at most), of each at most ``SAMPLE_PASSAGES`` passages spread evenly over its text; scoring reads every row and every
passage. Attention is a sum over passages, so long texts pass block by block.

Defined cases: null texts count as empty; a text without words is one passage without
words and is scored like any other; texts of more than ``BLOCK`` characters are cut into
blocks at white space (anywhere, if there is none), which passages do not cross; rows without a label are scored,
never learned from; a document with several labels is learned by the highest; if either label is missing, every
score is the share of label 1 (0.0 without any); null ids are never held out; repeated rows
count as they are and get equal scores; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.session import ship_package

from .common import bounded_sample, stored

SAMPLE_ROWS, SAMPLE_PASSAGES, PASSAGE_WORDS = 1000, 16, 64
CODE, GATES = 16, 8
BLOCK, BATCH_CHARS = 1 << 20, 1 << 18
#: Scores from here on are label 1.
THRESHOLD = 0.3

#: Characters that are a kind of their own, or share one; all others go by what they are in Unicode.
SIGNS = [".", ",", "!", "?", ";:", "'\"`", "()[]{}", "-_/", "|", "#$%&*@^~<>=+\\"]
SPACE, LINE, LOWER, UPPER, LETTER, DIGIT, OTHER, FIRST_SIGN = range(8)
KINDS = FIRST_SIGN + len(SIGNS)
STATISTICS = 6
FEATURES = KINDS + KINDS * KINDS + STATISTICS


def _kind(c: str) -> int:
    if c.isspace():
        return LINE if c == "\n" else SPACE
    if c.isalpha():
        return LOWER if c.islower() else UPPER if c.isupper() else LETTER
    return DIGIT if c.isdigit() else OTHER


def _table() -> np.ndarray:
    kinds = np.array([_kind(chr(c)) for c in range(1 << 16)], np.uint8)
    for k, signs in enumerate(SIGNS):
        kinds[[ord(c) for c in signs]] = FIRST_SIGN + k
    return kinds


_TABLE: list[np.ndarray] = []
_POWERS = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64))


def blocks(text: str, size: int = BLOCK) -> Iterator[str]:
    at = 0
    while len(text) - at > size:
        space = max(text.rfind(" ", at + 1, at + size), text.rfind("\n", at + 1, at + size))
        end = space if space > at else at + size
        yield text[at:end]
        at = end
    yield text[at:]


def passages(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage of every text, a row each, and the text it belongs to; every text has one at least."""
    if not _TABLE:
        _TABLE.append(_table())
    whole = "".join(f" {t}" for t in texts)  # a word begins after white space
    codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = _TABLE[0][np.minimum(codes, 0xFFFF)].astype(np.int64)
    begins = np.cumsum([0, *[len(t) + 1 for t in texts]])[:-1].astype(np.int64)
    blank = kinds <= LINE
    starts = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    first_word = np.searchsorted(starts, begins)
    words = np.diff(np.append(first_word, len(starts)))
    count = np.maximum(1, -(-words // PASSAGE_WORDS))
    first = np.cumsum(count) - count
    total = int(count.sum())
    owner = np.repeat(np.arange(len(texts)), count)
    text_of_word = np.repeat(np.arange(len(texts)), words)
    of_word = first[text_of_word] + (np.arange(len(starts)) - first_word[text_of_word]) // PASSAGE_WORDS

    # the passage of a character is that of the word begun last, or the first of its text
    text_of = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
    begun = np.zeros(len(codes), np.int64)
    begun[starts] = 1
    word = np.cumsum(begun) - 1
    passage = first[text_of]
    inside = word >= first_word[text_of]
    passage[inside] = of_word[word[inside]]

    single = np.bincount(passage * KINDS + kinds, minlength=total * KINDS).reshape(total, KINDS)
    later = np.ones(len(codes), bool)
    later[begins] = False  # nothing before a text's first character
    later = np.flatnonzero(later)
    pairs = np.bincount(passage[later] * KINDS**2 + kinds[later - 1] * KINDS + kinds[later], minlength=total * KINDS**2).reshape(total, -1)
    size = np.maximum(single.sum(1, keepdims=True), 1)

    n = np.bincount(of_word, minlength=total)
    stats = np.zeros((total, STATISTICS))
    if len(starts):
        place = np.arange(len(codes)) - np.repeat(np.append(0, starts), np.diff(np.concatenate([[0], starts, [len(codes)]])))
        weight = np.where(blank, np.uint64(0), (codes.astype(np.uint64) + np.uint64(1)) * _POWERS[place & 63])
        name = np.add.reduceat(weight, starts)
        letters = np.add.reduceat((~blank).astype(np.int64), starts)
        order = np.lexsort((name, of_word))
        new = np.append(True, (name[order][1:] != name[order][:-1]) | (of_word[order][1:] != of_word[order][:-1]))
        distinct = np.bincount(of_word[order], new, total)
        again = (name[1:] == name[:-1]) & (of_word[1:] == of_word[:-1])
        repeated = np.bincount(of_word[1:], again, total)
        mean = np.bincount(of_word, letters, total) / np.maximum(n, 1)
        square = np.bincount(of_word, letters**2, total) / np.maximum(n, 1)
        stats[:, 0] = distinct / np.maximum(n, 1)
        stats[:, 1] = repeated / np.maximum(n, 1)
        stats[:, 2] = np.log1p(mean)
        stats[:, 3] = np.log1p(np.sqrt(np.maximum(square - mean**2, 0)))
    stats[:, 4] = n / PASSAGE_WORDS
    stats[:, 5] = n == 0
    return np.concatenate([single / size, pairs / size, stats], 1).astype(np.float32), owner


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Attention:
    """The learned weights; ``weights`` are: passage layer, its bias, tanh gate, logistic gate, attention, score, its bias."""

    mean: np.ndarray
    spread: np.ndarray
    weights: list[np.ndarray]

    @classmethod
    def new(cls, x: np.ndarray, seed: int = 5) -> Attention:
        r = np.random.default_rng(seed)
        shapes = [(x.shape[1], CODE), (CODE,), (CODE, GATES), (CODE, GATES), (GATES,), (CODE,), ()]
        weights = [r.standard_normal(s) / np.sqrt(s[0]) if len(s) == 2 else r.standard_normal(s) * 0.1 for s in shapes]
        return cls(x.mean(0), np.maximum(x.std(0), 1e-3), weights)

    def codes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Codes of passages, both gates, and attention before it is normalised."""
        layer, bias, turn, gate, attend, *_ = self.weights
        code = np.tanh(np.clip((x - self.mean) / self.spread, -8, 8) @ layer + bias)
        tanh, open_ = np.tanh(code @ turn), _logistic(code @ gate)
        return code, tanh, open_, np.exp((tanh * open_) @ attend)  # bounded by the sum of |attend|

    def sums(self, x: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        """For each of ``n`` texts its attention, and its codes weighed by it; these add up over blocks."""
        code, *_, attention = self.codes(x)
        columns = [np.bincount(owner, attention, n), *(np.bincount(owner, attention * c, n) for c in code.T)]
        return np.stack(columns, 1)

    def score(self, sums: np.ndarray) -> np.ndarray:
        return _logistic(sums[:, 1:] / sums[:, :1] @ self.weights[5] + self.weights[6])

    def gradient(self, x: np.ndarray, owner: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Weighted log loss over documents, and its slope by every weight."""
        layer, bias, turn, gate, attend, score, shift = self.weights
        scaled = np.clip((x - self.mean) / self.spread, -8, 8)
        code, tanh, open_, attention = self.codes(x)
        n = len(y)
        share = attention / np.bincount(owner, attention, n)[owner]
        bag = np.stack([np.bincount(owner, share * c, n) for c in code.T], 1)
        p = _logistic(bag @ score + shift)
        loss = -float((weight * np.log(np.where(y > 0, p, 1 - p) + 1e-12)).sum())
        out = weight * (p - y)
        to_bag = out[:, None] * score
        of_share = (code * to_bag[owner]).sum(1)
        of_attention = share * (of_share - np.bincount(owner, share * of_share, n)[owner])
        of_tanh = of_attention[:, None] * attend * open_ * (1 - tanh**2)
        of_gate = of_attention[:, None] * attend * tanh * open_ * (1 - open_)
        of_code = share[:, None] * to_bag[owner] + of_tanh @ turn.T + of_gate @ gate.T
        of_layer = of_code * (1 - code**2)
        return loss, [
            scaled.T @ of_layer, of_layer.sum(0), code.T @ of_tanh, code.T @ of_gate,
            (tanh * open_).T @ of_attention, bag.T @ out, out.sum(),
        ]

    @classmethod
    def train(cls, x: np.ndarray, owner: np.ndarray, y: np.ndarray, rounds: int = 150, speed: float = 0.02, decay: float = 1e-4) -> Attention:
        """By Adam over all passages; both labels weigh alike."""
        model = cls.new(x)
        weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y == 0).sum(), 1))
        first, second = [np.zeros_like(w) for w in model.weights], [np.zeros_like(w) for w in model.weights]
        for t in range(1, rounds + 1):
            _, slope = model.gradient(x, owner, y, weight)
            for k, g in enumerate(slope):
                g = g + decay * model.weights[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                model.weights[k] = model.weights[k] - speed * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.99**t)) + 1e-8)
        return model


def held_out(id_column: str = "doc_id"):
    """Whether a row's label is not learned from; rows without an id are never held out."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learning_rows(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS) -> DataFrame:
    """``doc_id, text, label`` of at most ``rows`` documents of either label that are not held out.

    Drawn by a hash of the id from the labels of documents that exist; only the drawn ids are sent to where texts are.
    """
    known = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).filter(~held_out()).groupBy("doc_id").agg(F.max(label).alias("label"))
    there = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    drawn = [bounded_sample(there.filter(F.col("label") == x), rows, F.xxhash64("doc_id")) for x in (0, 1)]
    ids = stored(drawn[0].union(drawn[1]), "drawn")
    return docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")


def bags(rows: DataFrame, most: int = SAMPLE_PASSAGES) -> DataFrame:
    """``doc_id, label, bag``: features of at most ``most`` passages of each text, spread evenly over it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column(2).to_pylist()):
                x = np.concatenate([passages([b])[0] for b in blocks(text)])
                picked = x[np.unique(np.linspace(0, len(x) - 1, min(most, len(x))).astype(int))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), pa.array([picked.tobytes()], pa.binary())], ["doc_id", "label", "bag"])

    ship_package(rows.sparkSession, "flowlens")
    return rows.select(F.col("doc_id").cast("long"), F.col("label").cast("int"), "text").mapInArrow(run, "doc_id long, label int, bag binary")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS, most: int = SAMPLE_PASSAGES) -> tuple[Attention | None, float]:
    """The trained weights and the share of label 1 among the learning rows; without both labels there are no weights."""
    held = bags(learning_rows(docs, labels, label, rows), most).orderBy("doc_id", "label", "bag").limit(4 * rows).collect()
    y = np.array([r.label for r in held], float)
    if not len(y) or y.min() == y.max():
        return None, float(y.mean()) if len(y) else 0.0
    each = [np.frombuffer(r.bag, np.float32).reshape(-1, FEATURES) for r in held]
    owner = np.repeat(np.arange(len(each)), [len(x) for x in each])
    return Attention.train(np.concatenate(each).astype(np.float64), owner, y), float(y.mean())


def score(docs: DataFrame, model: Attention | None, share: float, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, score, predicted`` for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scores(texts: list[str]) -> np.ndarray:
        if shared.value is None:
            return np.full(len(texts), share)
        sums = np.zeros((len(texts), 1 + CODE))
        held, of, size = [], [], 0
        for i, text in enumerate(texts):
            for block in blocks(text):
                held.append(block)
                of.append(i)
                size += len(block)
                if size >= BATCH_CHARS:
                    add(sums, held, of)
                    held, of, size = [], [], 0
        if held:
            add(sums, held, of)
        return shared.value.score(sums)

    def add(sums: np.ndarray, held: list[str], of: list[int]) -> None:
        x, owner = passages(held)
        np.add.at(sums, of, shared.value.sums(x, owner, len(held)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                p = scores(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], ["doc_id", "score", "predicted"])

    ship_package(docs.sparkSession, "flowlens")
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    return docs.select(F.col(id_column).cast("long"), text).mapInArrow(run, "doc_id long, score double, predicted int")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every document."""
    return score(docs, *fit(docs, labels)).withColumn("held_out", held_out())
