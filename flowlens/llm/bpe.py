"""Byte-level BPE as a lazily determinised transducer, and its streaming inverse.

Greedy merging is local: a sequence of tokens is *the* encoding of its bytes if
every two neighbours, encoded together, stay these two tokens. So the last token
of each prefix follows from the last tokens of shorter prefixes, which lets bytes
be read one by one. What still matters is the token emitted last and the bytes read
since. A token leaves as soon as every way to go on agrees on it; no
state holds more bytes than a few of the longest tokens. States and their
moves come into being when first used and are forgotten when too many; a worker
process keeps them from task to task.

Defined cases: a null text counts as empty and has no tokens; a text that is one
piece of millions of bytes passes byte by byte in bounded memory; nothing is cut;
null ids and repeated rows are rows like others, in the order of the input; an empty
table gives an empty result; only id and text are read.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import struct
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, utf8


#: Letters and numbers that came after Unicode 16.0, first and last of each range. The tokenizer's
#: pattern was made before them and takes them for neither; the pattern engine at hand knows them already.
NEWER = (
    "558 558 58B 58C 88F 88F C5C C5C CDC CDC 208F 208F 209D 209F A7CE A7CF A7D2 A7D2 A7D4 A7D4 A7DD A7DD A7E2 A7E2 "
    "A7F1 A7F1 AB6C AB6D 107BB 107BF 10940 10959 10EC5 10EC7 10ED9 10EEE 11B0A 11B0A 11DB0 11DDB 11DE0 11DE9 "
    "11DF1 11DF1 1246F 1246F 12475 1247F 12550 12686 16EA0 16EB8 16EBB 16ED3 16FF2 16FF6 187F8 187FF 18CD6 18CDA "
    "18D09 18D20 18D80 18DF2 18E00 19191 191A0 191D2 1B123 1B128 1B168 1B168 1D6A6 1D6A6 1DF1F 1DF24 1DF2B 1DF81 "
    "1DF90 1DF96 1DFCD 1DFFF 1E6C0 1E6DE 1E6E0 1E6E2 1E6E4 1E6E5 1E6E7 1E6ED 1E6F0 1E6F4 1E6FE 1E6FF 2B73A 2B73F "
    "2B81E 2B81E 2CEA2 2CEAD 323B0 33479 3D000 3FC3F"
)


def read_ranks(lines: Iterable[bytes]) -> dict[bytes, int]:
    """A rank file: one base64 token and its rank a line."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Transducer:
    """Turns one piece, as the pre-tokenising pattern cuts it, into token ids.

    A state is the *live* prefixes: those behind which a token has begun, each with
    that beginning (a node of the tree of tokens) and the tokens that lead to it since
    the last one emitted. Tokens that lead to all of them are emitted. The token emitted
    last is a register beside the state: only the first live prefix borders on it, so a
    move has at most one condition on it (may this token follow that one?) and an outcome
    for either answer. States, moves and answers come into being when first used and are
    forgotten when there are more than ``most`` of a kind, which then hold some 200 MB. Of the
    pieces met those that do not come again are forgotten.
    """

    START = 0
    #: An outcome is one number: the number of the tokens emitted and, in these low bits, the next state.
    STATE_BITS = 24

    def __init__(self, ranks: dict[bytes, int], most: int = 150_000):
        self.ranks, self.most = ranks, most
        self.tokens = {rank: token for token, rank in ranks.items()}
        # a tree over the bytes of all tokens: children by node and byte, and the token that ends at a node
        self.child: dict[int, int] = {}
        self.ending, self.inner = array("i", [-1]), bytearray(1)
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                self.inner[node] = 1
                way = node << 8 | byte
                node = self.child.get(way, 0)
                if not node:
                    node = self.child[way] = len(self.ending)
                    self.ending.append(-1)
                    self.inner.append(0)
            self.ending[node] = rank
        self._sides: dict[int, tuple[list, list]] = {}
        self._fits: dict[int, bool] = {}
        self.pieces: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}
        self._forget()

    def _forget(self) -> None:
        start = ((0, ()),)
        self._names, self._states = {start: self.START}, [start]
        #: by state and byte the outcome, or below zero the place in ``_guarded``
        self._moves: dict[int, int] = {}
        #: the token whose fit decides, and the outcomes (None: there is none) if it fits and if not
        self._guarded: list[tuple[int, int | None, int | None]] = []
        self._emitted, self._emissions = [()], {(): 0}

    def _named(self, live: tuple) -> int:
        name = self._names.setdefault(live, len(self._states))
        if name == len(self._states):
            self._states.append(live)
        return name

    def edges(self, token: int) -> tuple[list[tuple[bytes, int, float]], list[tuple[bytes, int, float]]]:
        """What stands at the left and the right end of a token while it is merged: part, and the ranks between which it is there."""
        if token not in self._sides:
            if len(self._sides) > self.most:
                self._sides.clear()
            data = self.tokens[token]
            parts = [data[i : i + 1] for i in range(len(data))]
            sides = ([[parts[0], -1, float("inf")]], [[parts[-1], -1, float("inf")]])
            while len(parts) > 1:
                best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], float("inf")))
                pair = parts[best] + parts[best + 1]
                if pair not in self.ranks:
                    break
                parts[best : best + 2] = [pair]
                for side, at in zip(sides, (0, len(parts) - 1)):
                    if best == at:
                        side[-1][2] = self.ranks[pair]
                        side.append([pair, self.ranks[pair], float("inf")])
            self._sides[token] = sides if len(parts) == 1 else ([], [])  # merging never makes this token
        return self._sides[token]

    def fits(self, before: int, token: int) -> bool:
        """Whether ``token`` can follow ``before`` (-1 at the start): no merge across their border comes before those inside."""
        key = before << 32 | token
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) > 2 * self.most:
                self._fits.clear()
            known = self._fits[key] = self._holds(before, token)
        return known

    def _holds(self, before: int, token: int) -> bool:
        right = self.edges(token)[0]
        if before < 0 or not right:
            return bool(right)
        for a, a_from, a_to in self.edges(before)[1]:
            for b, b_from, b_to in right:
                rank = self.ranks.get(a + b)
                # of equal ranks the merge further left comes first
                if rank is not None and max(rank, b_from) < a_to and max(rank, a_from) <= b_to:
                    return False
        return True

    def _move(self, state: int, byte: int) -> int:
        guard, yes, no, live = -1, None, None, []
        for node, path in self._states[state]:  # the longest beginning first
            node = self.child.get(node << 8 | byte)
            if node is None:
                continue
            token = self.ending[node]
            if token >= 0 and no is None:
                if not path:
                    guard, yes = token, (token,)
                elif self.fits(path[-1], token):
                    no = path + (token,)
            if self.inner[node]:
                live.append((node, path))
        yes, no = (self._outcome(found, live) if found else None for found in (yes, no))
        if guard < 0 and no is not None:
            move = no
        else:
            self._guarded.append((guard, yes, no))
            move = -len(self._guarded)
        self._moves[state << 8 | byte] = move
        return move

    def _outcome(self, found: tuple[int, ...], live: list) -> int:
        sure = 0
        for agreed in zip(found, *(path for _, path in live)):
            if agreed.count(agreed[0]) < len(agreed):
                break
            sure += 1
        left = tuple((node, path[sure:]) for node, path in live)
        emitted = self._emissions.setdefault(found[:sure], len(self._emitted))
        if emitted == len(self._emitted):
            self._emitted.append(found[:sure])
        return emitted << self.STATE_BITS | self._named((*left, (0, found[sure:])))

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        out: list[int] = []
        state, before, low = self.START, -1, (1 << self.STATE_BITS) - 1
        moves, fits, emitted = self._moves, self._fits, self._emitted
        for byte in piece:
            move = moves.get(state << 8 | byte)
            if move is None:
                if len(self._states) > self.most or len(moves) > 2 * self.most:
                    held = self._states[state]
                    self._forget()
                    moves, emitted, state = self._moves, self._emitted, self._named(held)
                move = self._move(state, byte)
            if move < 0:
                guard, move, otherwise = self._guarded[-move - 1]
                known = fits.get(before << 32 | guard)
                if not (self.fits(before, guard) if known is None else known):
                    move = otherwise
                if move is None:
                    raise ValueError(f"no token for byte {byte}")
            state = move & low
            if move > low:
                tokens = emitted[move >> self.STATE_BITS]
                out += tokens
                before = tokens[-1]
        out += self._states[state][-1][1]  # the prefix that ends here
        return out

    def ids(self, piece: str) -> bytes:
        """As ``encode``, as little-endian 32-bit numbers; short pieces are remembered in ``pieces``."""
        packed = self._older.get(piece)
        if packed is None:
            ids = self.encode(piece.encode())
            packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= 64:
            if len(self.pieces) >= 2 * self.most:
                self._older = self.pieces.copy()
                self.pieces.clear()  # not a new one: callers hold it
            self.pieces[piece] = packed
        return packed


class Utf8:
    """An incremental UTF-8 state machine over byte chunks that may end inside a character.

    A state is the number of continuation bytes still due with the range the next
    one may lie in (shortest forms only, no surrogates, nothing above U+10FFFF).
    """

    ACCEPT, REJECT = (0, 0x80, 0xBF), (-1, 0, 0)

    def step(self, state: tuple[int, int, int], byte: int) -> tuple[int, int, int]:
        due, low, high = state
        if due < 0:
            return self.REJECT
        if due:
            return (due - 1, 0x80, 0xBF) if low <= byte <= high else self.REJECT
        if byte < 0x80:
            return self.ACCEPT
        if 0xC2 <= byte <= 0xDF:
            return 1, 0x80, 0xBF
        if 0xE0 <= byte <= 0xEF:
            return 2, 0xA0 if byte == 0xE0 else 0x80, 0x9F if byte == 0xED else 0xBF
        if 0xF0 <= byte <= 0xF4:
            return 3, 0x90 if byte == 0xF0 else 0x80, 0x8F if byte == 0xF4 else 0xBF
        return self.REJECT

    def over(self, state: tuple[int, int, int], chunk: bytes) -> tuple[int, int, int]:
        for byte in chunk:
            state = self.step(state, byte)
        return state


class Decoder:
    """Tokens back to bytes. Tokens of whole characters leave the state machine where it is and are only joined."""

    def __init__(self, ranks: dict[bytes, int]):
        self.machine, self.tokens = Utf8(), {rank: token for token, rank in ranks.items()}
        self.whole = np.zeros(max(self.tokens, default=0) + 1, bool)
        for rank, token in self.tokens.items():
            self.whole[rank] = self.machine.over(Utf8.ACCEPT, token) == Utf8.ACCEPT

    def stream(self, ids: np.ndarray, size: int = 8192) -> Iterator[bytes]:
        """The bytes of ``ids``, some thousand tokens at a time; raises if they are not UTF-8."""
        state = Utf8.ACCEPT
        for start in range(0, len(ids), size):
            block = ids[start : start + size]
            chunks = [self.tokens[i] for i in block.tolist()]
            at = 0
            for opens in [0, *np.flatnonzero(~self.whole[block]).tolist()]:
                at = max(at, opens)
                while at < len(chunks) and (state != Utf8.ACCEPT or at == opens):
                    state = self.machine.over(state, chunks[at])
                    if state[0] < 0:
                        raise ValueError("the tokens do not spell UTF-8")
                    at += 1
            yield b"".join(chunks)
        if state != Utf8.ACCEPT:
            raise ValueError("the tokens end inside a character")


class Encoder:
    """Whole texts to token ids (``<u4``), and the decoder of the same ranks."""

    #: Characters of a text whose pieces are listed at once.
    BLOCK = 1 << 20

    def __init__(self, rank_file: bytes, pattern: str):
        import regex

        self.transducer, self.cut = Transducer(read_ranks(rank_file.splitlines())), regex.compile(pattern)
        self.decoder = Decoder(self.transducer.ranks)
        ends = [chr(int(x, 16)) for x in NEWER.split()]
        self.newer = regex.compile("[" + "".join(f"{a}-{b}" for a, b in zip(ends[::2], ends[1::2])) + "]")

    def pieces(self, text: str) -> Iterator[list[str]]:
        plain = text
        if not text.isascii() and self.newer.search(text):
            plain = self.newer.sub("\uf8ff", text)  # neither letter nor number
        if plain is text and len(text) <= self.BLOCK:
            yield self.cut.findall(text)
        else:
            for some in itertools.batched(self.cut.finditer(plain), 1 << 16):
                yield [text[m.start() : m.end()] for m in some]

    def __call__(self, text: str) -> np.ndarray:
        known, of = self.transducer.pieces.get, self.transducer.ids
        return np.frombuffer(b"".join([known(p) or of(p) for some in self.pieces(text) for p in some]), "<u4")


_ENCODERS: dict[tuple[bytes, str], Encoder] = {}


def encoder(rank_file: bytes, pattern: str) -> Encoder:
    """One encoder for each worker process, so that its states outlast a task; another rank file takes its place."""
    key = hashlib.sha256(rank_file).digest(), pattern
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(rank_file, pattern)
    return _ENCODERS[key]


def encode_texts(docs: DataFrame, rank_path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, ids``: token ids of every text (array of int), in the order of the input."""
    rank_file = docs.sparkSession.sparkContext.broadcast(open(rank_path, "rb").read())

    def make():
        encode = encoder(rank_file.value, pattern)
        return lambda row: [(row[0], encode(row[1]).astype(np.int32))]

    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    return map_rows(docs.select(id_column, text), "doc_id long, ids array<int>", make, rows=128)


def decode_ids(encoded: DataFrame, rank_path: str, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """``doc_id, text`` from token ids; null ids give null."""
    rank_file = encoded.sparkSession.sparkContext.broadcast(open(rank_path, "rb").read())

    def make():
        decoder = Decoder(read_ranks(rank_file.value.splitlines()))

        def one(row):
            yield row[0], None if row[1] is None else b"".join(decoder.stream(np.array(row[1], np.int64))).decode()

        return one

    return map_rows(encoded.select(id_column, ids_column), "doc_id long, text string", make, rows=128)


def round_trip(docs: DataFrame, rank_path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: every text encoded and its ids decoded again."""
    rank_file = docs.sparkSession.sparkContext.broadcast(open(rank_path, "rb").read())

    def make():
        encode = encoder(rank_file.value, pattern)
        decoder = encode.decoder

        def one(row):
            ids, digest = encode(row[1]), hashlib.sha256()
            for piece in decoder.stream(ids):
                digest.update(piece)
            yield row[0], len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), digest.hexdigest()

        return one

    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    return map_rows(docs.select(id_column, text), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", make)
