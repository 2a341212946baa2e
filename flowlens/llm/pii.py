"""Personal data: fixed patterns, and what a trained character tagger adds to them.

The tagger is a bidirectional LSTM with CRF transitions (``tagger.py``). It is trained
on windows drawn from all documents, at most ``EACH_KIND`` with the patterns' own spans of each kind
and ``PLAIN`` without any, and learns what such data look like: neighbours of the patterns that they miss by a character. It reads windows
that overlap by half; where two windows cover a character, the one in whose middle it
lies nearer decides, so each text has one sequence of tags however it is cut. All kinds
hold a digit or an ``@``: a window is read if the half around it has one, and a tagged
stretch without one is no span. Nothing else is left out, in texts of any length.

Positions are code points, ends are exclusive. Defined cases: a null text counts as
empty; a tagged stretch that overlaps a pattern's span is dropped, the pattern's span
stays; without any span to learn from nothing is added; repeated rows give repeated
results; an empty table gives an empty result; only id and text are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.session import ship_package

from .common import stored
from .tagger import DIGIT, PAD, Tagger, classes

#: Kinds in their order, and their patterns. Digits before an address part cannot begin one.
KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NO_DIGIT = re.compile("[^0-9]+")

#: Learning windows of each kind, and without any.
EACH_KIND, PLAIN = 240, 480
WINDOW, STRIDE = 64, 32
TAGS = 1 + 2 * len(KINDS)  # outside; begin and inside of each kind
_AT = classes("@")[0]


def emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @ back over what may stand before it, but not into the last address."""
    low, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            low = domain.end()
        at = text.find("@", max(low, at + 1))


def luhn(digits: str) -> bool:
    twice = (2 * int(d) for d in digits[-2::-2])
    return (sum(map(int, digits[::-2])) + sum(d - 9 if d > 9 else d for d in twice)) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start."""
    out = [(0, a, b) for a, b in emails(text)]
    out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = NO_DIGIT.sub("", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(NO_DIGIT.sub("", m[0])) <= 15]
    return out


def windows(ids: np.ndarray) -> list[int]:
    """Where the windows begin that have a digit or @ in a half of theirs; they lie on a grid of STRIDE."""
    anchors = np.flatnonzero((ids == DIGIT) | (ids == _AT))
    cells = np.unique(anchors // STRIDE)
    starts = np.unique(np.concatenate([cells, np.maximum(cells - 1, 0)]))
    return (starts * STRIDE).tolist()


def filled(ids: np.ndarray, starts: list[int]) -> np.ndarray:
    out = np.full((len(starts), WINDOW), PAD, np.uint8)
    for k, s in enumerate(starts):
        part = ids[s : s + WINDOW]
        out[k, : len(part)] = part
    return out


def tagged(length: int, spans: list[tuple[int, int, int]]) -> np.ndarray:
    tags = np.zeros(length, np.int64)
    for kind, a, b in spans:
        tags[a:b] = 2 * kind + 2
        tags[a] = 2 * kind + 1
    return tags


def reconciled(length: int, starts: list[int], tags: np.ndarray) -> np.ndarray:
    """One tag a character: that of the window whose middle is nearest, the earlier of two as near."""
    out, far = np.zeros(length, np.int8), np.full(length, WINDOW, np.float32)
    distance = np.abs(np.arange(WINDOW) - (WINDOW - 1) / 2)
    for s, row in zip(starts, tags):
        n = min(WINDOW, length - s)
        # the first and the last window of a text have no neighbour on one side
        near = distance[:n] < far[s : s + n]
        out[s : s + n][near] = row[:n][near]
        far[s : s + n][near] = distance[:n][near]
    return out


def added(ids: np.ndarray, tags: np.ndarray, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Tagged stretches that hold a digit or @ and overlap no pattern's span."""
    kind = np.where(tags > 0, (tags - 1) // 2, -1)
    begins = np.flatnonzero((kind >= 0) & ((tags % 2 == 1) | (np.append(-1, kind[:-1]) != kind)))
    taken = np.zeros(len(ids) + 1, bool)
    for _, a, b in base:
        taken[a:b] = True
    anchor = (ids == DIGIT) | (ids == _AT)
    out = []
    for a in begins.tolist():
        b = a + 1
        while b < len(tags) and kind[b] == kind[a] and tags[b] % 2 == 0:
            b += 1
        if anchor[a:b].any() and not taken[a:b].any():
            out.append((int(kind[a]), a, b))
    return out


def drawn_windows(docs: DataFrame, text_column: str, id_column: str, each: int = EACH_KIND, plain: int = PLAIN) -> list:
    """Windows to learn from (``kind, draw, ids, tags``), by a hash over those of all texts: ``each`` for every kind, ``plain`` without any.

    A task keeps the first of each kind while it reads, so little is written and at most that many rows reach the driver.
    """
    bounds = [each] * len(KINDS) + [plain]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[] for _ in bounds]
        limits = [1 << 63] * len(bounds)
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                for text, draw in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    _draw(text, draw, held, limits, bounds)
        rows = [(kind, *row) for kind, mine in enumerate(held) for row in sorted(mine)[: bounds[kind]]]
        if rows:
            types = [pa.int32(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["kind", "draw", "ids", "tags"])

    ship_package(docs.sparkSession, "flowlens")
    text = F.col(text_column).cast("string")
    read = docs.filter(text.rlike("[0-9@]")).select(text.alias("text"), F.xxhash64(F.col(id_column), text).alias("draw"))
    found = stored(read.mapInArrow(run, "kind int, draw long, ids binary, tags binary"), "learning")
    return [r for kind, n in enumerate(bounds) for r in found.filter(F.col("kind") == kind).orderBy("draw", "ids", "tags").limit(n).collect()]


def _draw(text: str, draw: int, held: list[list], limits: list[int], bounds: list[int]) -> None:
    ids = classes(text)
    starts, spans = np.array(windows(ids), np.int64), base_spans(text)
    has = np.zeros((len(bounds), len(starts)), bool)
    for kind, a, b in spans:
        has[kind, np.searchsorted(starts, a - WINDOW, side="right") : np.searchsorted(starts, b)] = True
    has[-1] = ~has.any(0)
    # a number of its own for each window of each text (splitmix64)
    mixed = np.uint64(draw % (1 << 64)) + (starts.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    order, tags = ((mixed ^ (mixed >> np.uint64(31))) >> np.uint64(1)).astype(np.int64), None
    for kind, bound in enumerate(bounds):
        for i in np.flatnonzero(has[kind] & (order < limits[kind])).tolist():
            tags = tagged(len(ids), spans) if tags is None else tags
            s = int(starts[i])
            mine = np.pad(tags[s : s + WINDOW], (0, max(0, s + WINDOW - len(tags))))
            held[kind].append((int(order[i]), filled(ids, [s])[0].tobytes(), mine.astype(np.uint8).tobytes()))
        if len(held[kind]) > 2 * bound:
            held[kind] = sorted(held[kind])[:bound]
            limits[kind] = held[kind][-1][0]


def train(docs: DataFrame, text_column: str = "text", id_column: str = "doc_id") -> Tagger | None:
    """Learns from the patterns' spans; none if no text has one."""
    rows = {(r.draw, bytes(r.ids), bytes(r.tags)) for r in drawn_windows(docs, text_column, id_column)}
    x, y = [], []
    for _, ids, tags in sorted(rows):
        x.append(np.frombuffer(ids, np.uint8))
        y.append(np.frombuffer(tags, np.uint8).astype(np.int64))
    if not any(t.any() for t in y):
        return None
    tagger = Tagger(TAGS)
    tagger.fit(np.array(x), np.array(y))
    return tagger


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def personal_data(docs: DataFrame, tagger: Tagger | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added``; counts are of the patterns' spans."""
    tagger = tagger or train(docs, text_column, id_column)
    shared = docs.sparkSession.sparkContext.broadcast(tagger)
    ship_package(docs.sparkSession, "flowlens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                part = whole.slice(at, 128)
                yield _rows(part.column(0).to_pylist(), part.column(1).to_pylist(), shared.value)

    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return docs.select(F.col(id_column).cast("long"), text).mapInArrow(run, f"doc_id long, {counts}, base_sha256 string, spans string, n_added long")


def _rows(doc_ids: list, texts: list[str], tagger: Tagger | None, batch: int = 512) -> pa.RecordBatch:
    read, out = [], {k: [] for k in ("doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added")}
    for text in texts:
        ids = classes(text)
        starts = windows(ids) if tagger else []
        read.append((ids, starts, base_spans(text) if starts or not tagger else []))
    tags = iter(())
    if tagger:
        tags = _decoded(tagger, ((ids, s) for ids, starts, _ in read for s in starts), batch)
    for doc_id, (ids, starts, base) in zip(doc_ids, read):
        mine = np.array([next(tags) for _ in starts]).reshape(-1, WINDOW)
        more = added(ids, reconciled(len(ids), starts, mine), base) if starts else []
        for kind, name in enumerate(KINDS):
            out[f"n_{name}"].append(sum(k == kind for k, _, _ in base))
        out["doc_id"].append(doc_id)
        out["base_sha256"].append(hashlib.sha256(written(base).encode()).hexdigest())
        out["spans"].append(written(base + more))
        out["n_added"].append(len(more))
    types = {"base_sha256": pa.string(), "spans": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array(v, types.get(k, pa.int64())) for k, v in out.items()], list(out))


def _decoded(tagger: Tagger, pieces: Iterator[tuple[np.ndarray, int]], batch: int) -> Iterator[np.ndarray]:
    """Tags of window after window, decoded many at a time."""
    held: list[np.ndarray] = []
    for ids, start in pieces:
        held.append(filled(ids, [start])[0])
        if len(held) == batch:
            yield from tagger.decode(np.array(held))
            held = []
    if held:
        yield from tagger.decode(np.array(held))
