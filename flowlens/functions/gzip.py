"""Length of the gzip form of texts that arrive in pieces.

Spark has no built-in gzip function, so this is the one place where text
leaves the JVM, in Arrow batches. The compressor is fed piece by piece and
holds a fixed 32 KB window, so a text of any length passes through without
being assembled in memory.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Default level, and the window setting that adds gzip framing
LEVEL = 6
GZIP_WINDOW = 31


def compressor():
    return zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP_WINDOW)


class RunningLength:
    """Number, length and gzip length of codes that come one by one.

    A copy of the compressor's state is finished after each code, so a code costs the
    same however long the text has become.
    """

    def __init__(self):
        self._state, self._size, self.codes, self.text_len = compressor(), 0, 0, 0
        self.gzip_len = len(self._state.copy().flush())

    def add(self, code: str | None) -> None:
        if code is not None:
            piece = code.encode("utf-8")
            self._size += len(self._state.compress(piece))
            self.codes, self.text_len = self.codes + 1, self.text_len + len(piece)
            self.gzip_len = self._size + len(self._state.copy().flush())


def gzip_size(text: str) -> int:
    c = compressor()
    return len(c.compress(text.encode("utf-8"))) + len(c.flush())


@F.pandas_udf(T.IntegerType())
def gzip_length(texts: pd.Series) -> pd.Series:
    """Gzip length of one text per row, for texts that are rows already (stream windows)."""
    return texts.map(lambda t: None if t is None else gzip_size(t)).astype("Int32")


def gzip_length_of_groups(
    pieces: DataFrame, group: list[str], order: str, text: str = "text", carry: tuple[str, ...] = ()
) -> DataFrame:
    """One row per group, ``group..., carry..., gzip_len``, over the pieces joined in ``order``.

    ``carry`` names columns that are constant within a group. Pieces of a group
    are brought together sorted and streamed through one compressor. Deflate is
    sequential by definition, so a group's text has to pass through one task,
    but only its codes do, never its packets.
    """
    keep = [*group, *carry]
    fields = ", ".join(f"`{c}` {pieces.schema[c].dataType.simpleString()}" for c in keep)
    schema = f"{fields}, gzip_len bigint"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state, size = None, None, 0
        for batch in batches:
            done = []
            for *row, piece in zip(*(batch[c] for c in keep), batch[text]):
                if row != current:
                    if current is not None:
                        done.append((*current, size + len(state.flush())))
                    current, state, size = row, compressor(), 0
                size += len(state.compress(piece.encode("utf-8")))
            if done:
                yield pd.DataFrame(done, columns=[*keep, "gzip_len"])
        if current is not None:
            yield pd.DataFrame([(*current, size + len(state.flush()))], columns=[*keep, "gzip_len"])

    together = pieces.select(*keep, order, text).repartition(*group).sortWithinPartitions(*group, order)
    return together.select(*keep, text).mapInPandas(run, schema)


def gzip_lengths_of_overlapping(pieces: DataFrame, key: str, windows: int) -> DataFrame:
    """One row per ``key`` and window ``no`` over the pieces of all windows, each piece stored and moved few times only.

    Input rows are ``key, piece, first_no, last_no, lead, usable, text`` and counts: a piece
    belongs to the windows ``first_no`` to ``last_no``, and ``lead`` bytes of it refer to what lies
    before it; a window leaves them out in its first piece with ``usable`` packets. Up to
    ``windows`` neighbouring windows are packed together by one task, which has a compressor for each that is
    open, so a piece goes to one or two tasks where it used to go to all its windows.
    """
    counts = ["packets", "codes", "first_ts", "last_ts", "last_rn"]
    kind = pieces.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, no bigint, {', '.join(f'{c} bigint' for c in counts)}, text_len bigint, gzip_len bigint"
    chunks = F.sequence(F.floor(F.col("first_no") / windows), F.floor(F.col("last_no") / windows))
    spread = pieces.where("first_no <= last_no").withColumn("chunk", F.explode(chunks))
    names = [key, "chunk", "piece", "first_no", "last_no", "lead", "usable", "text", *counts]
    together = spread.select(*names).repartition(key, "chunk").sortWithinPartitions(key, "chunk", "piece")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, open_, done = None, {}, []

        def close(numbers: list[int]) -> None:
            for no in numbers:
                w = open_.pop(no)
                done.append((current[0], no, *w.counts, w.text_len, w.size + len(w.state.flush())))

        for batch in batches:
            for row in batch.itertuples(index=False, name=None):
                if row[:2] != current:
                    close(list(open_))
                    current = row[:2]
                _, chunk, _, first, last, lead, usable, text, packets, codes, first_ts, last_ts, last_rn = row
                close([no for no in open_ if no < first])
                data = text.encode("utf-8")
                for no in range(max(first, chunk * windows), min(last, (chunk + 1) * windows - 1) + 1):
                    w = open_.get(no)
                    if w is None:
                        w = open_[no] = _Open()
                    w.add(data, lead, usable, packets, codes, first_ts, last_ts, last_rn)
            if done:
                yield pd.DataFrame(done, columns=[key, "no", *counts, "text_len", "gzip_len"])
                done.clear()
        if current is not None:
            close(list(open_))
        if done:
            yield pd.DataFrame(done, columns=[key, "no", *counts, "text_len", "gzip_len"])

    return together.mapInPandas(run, schema)


class _Open:
    """A window that is being packed."""

    def __init__(self):
        self.state, self.size, self.text_len, self.begun, self.counts = compressor(), 0, 0, False, None

    def add(self, data: bytes, lead: int, usable: int, packets: int, codes: int, first_ts: int, last_ts: int, last_rn: int) -> None:
        if usable and not self.begun:
            self.begun = True
            data, codes = data[lead:], codes - (lead > 0)
        self.size += len(self.state.compress(data))
        self.text_len += len(data)
        if self.counts is None:
            self.counts = (packets, codes, first_ts, last_ts, last_rn)
        else:
            p, c, a, b, r = self.counts
            self.counts = (p + packets, c + codes, min(a, first_ts), max(b, last_ts), max(r, last_rn))


def running_gzip_lengths(coded: DataFrame) -> DataFrame:
    """Code count, text length and gzip length after every packet of a flow.

    Input rows are ``flow_key, ts_ms, seq, packets, code``; see :class:`RunningLength`.
    """
    schema = (
        "flow_key string, ts_ms bigint, seq bigint, packets bigint, "
        "codes bigint, text_len bigint, gzip_len bigint"
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        flow, state = None, None
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if row.flow_key != flow:
                    flow, state = row.flow_key, RunningLength()
                state.add(row.code)
                out.append((row.flow_key, row.ts_ms, row.seq, row.packets, state.codes, state.text_len, state.gzip_len))
            yield pd.DataFrame(out, columns=[f.split()[0] for f in schema.split(", ")])

    return (
        coded.select("flow_key", "ts_ms", "seq", "packets", "code")
        .repartition("flow_key").sortWithinPartitions("flow_key", "ts_ms", "seq")
        .mapInPandas(run, schema)
    )


def score(text_len: Column, gzip_len: Column) -> Column:
    return F.when(gzip_len > 0, text_len / gzip_len)
