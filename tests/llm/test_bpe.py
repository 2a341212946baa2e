import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from flowlens.llm import bpe as B

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
RAW = open(PATH, "rb").read()
RANKS = B.read_ranks(RAW.splitlines())
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def texts():
    r = random.Random(1)
    alphabets = ["ab", "the quick brown fox ", "aáéñß漢字😀 \n\t", "0123456789 .", "ABCdef_-+/=", "  \n", "l'sre 've"]
    out = [None, "", " ", "\n\n a", "<|endoftext|>", "a" * 20_000, "-" * 5000 + "=" * 3000, " " * 10_000, "漢" * 3000, "loremipsum" * 2000]
    for _ in range(500):
        out.append("".join(r.choice(r.choice(alphabets)) for _ in range(r.choice([1, 5, 20, 200]))))
    for _ in range(200):
        out.append("".join(chr(r.choice([r.randrange(32, 0xD7FF), r.randrange(0xE000, 0x10FFFF)])) for _ in range(r.choice([1, 20, 200]))))
    newer = [chr(int(x, 16)) for x in B.NEWER.split()]
    return out + ["".join(r.choice(newer + list("a1 漢")) for _ in range(12)) for _ in range(200)]


def test_same_ids_as_the_library():
    encode = B.encoder(RAW, public_tokenizers.PATTERN)
    assert B.encoder(RAW, public_tokenizers.PATTERN) is encode
    assert [encode(t or "").tolist() for t in texts()] == LIBRARY.encode_ordinary_batch([t or "" for t in texts()])


def test_forgetting_states_changes_nothing():
    transducer = B.Transducer(RANKS, most=20)
    for text in [t for t in texts() if t and len(t) < 300][:150]:
        for piece in text.split():
            assert np.frombuffer(transducer.ids(piece), "<u4").tolist() == transducer.encode(piece.encode())
            assert transducer.encode(piece.encode()) == LIBRARY._core_bpe.encode_single_piece(piece.encode())


def test_long_texts_pass_in_blocks():
    encode = B.Encoder(RAW, public_tokenizers.PATTERN)
    encode.BLOCK = 10
    some = [t for t in texts() if t and len(t) < 300]
    assert [encode(t).tolist() for t in some] == LIBRARY.encode_ordinary_batch(some)


def test_decoder_is_incremental():
    decoder = B.Decoder(RANKS)
    text = "aé漢😀" * 50
    ids = np.array(LIBRARY.encode_ordinary(text), np.int64)
    for size in (1, 2, 3, 7, 1000):
        assert b"".join(decoder.stream(ids, size)).decode() == text
    single = np.array([RANKS[bytes([b])] for b in text.encode()])
    for size in (1, 2, 5):
        assert b"".join(decoder.stream(single, size)).decode() == text
    for wrong in (b"\xff", b"\xc0\x80", b"\xed\xa0\x80", b"\xe6\xbc", b"\xf4\x90\x80\x80", b"\x80"):
        with pytest.raises(ValueError):
            list(decoder.stream(np.array([RANKS[bytes([b])] for b in wrong])))


def test_queries_against_the_library(spark):
    rows = [(i, t, 1) for i, t in enumerate(texts())] + [(0, "again", 1), (None, "no id", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = B.round_trip(docs, PATH, public_tokenizers.PATTERN).collect()
    assert [g.doc_id for g in got] == [i for i, *_ in rows]
    for g, (_, t, _) in zip(got, rows):
        ids = LIBRARY.encode_ordinary(t or "")
        assert g.n_tokens == len(ids)
        assert g.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert g.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    encoded = B.encode_texts(docs, PATH, public_tokenizers.PATTERN)
    assert [r.text for r in B.decode_ids(encoded, PATH).collect()] == [t or "" for _, t, _ in rows]
    assert B.round_trip(docs.limit(0), PATH, public_tokenizers.PATTERN).collect() == []
