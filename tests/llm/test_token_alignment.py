import hashlib
import random
from collections import Counter

import public_tokenizers as P
import sentencepiece
import tokenizers

from flowlens.llm import token_alignment as T

A_PATH, B_PATH = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def brute(texts):
    """Token by token, with every pair of tokens compared by their byte ranges."""
    a = tokenizers.Tokenizer.from_file(A_PATH)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    letters = T.byte_letters()
    out, links = [], []
    for text in texts:
        data = f" {text}".encode() if text else b""
        x = a.encode(f" {text}", add_special_tokens=False).ids if text else []
        y = b.encode(text) if text else []
        x_bytes = [bytes(letters[c] for c in a.id_to_token(i)) for i in x]
        y_bytes = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
        if b"".join(x_bytes) != data or b"".join(y_bytes) != data:
            x = y = []
        spans = []
        for ids, parts in ((x, x_bytes), (y, y_bytes)):
            at, some = 0, []
            for i, part in zip(ids, parts):
                some.append((at, at + len(part), i))
                at += len(part)
            spans.append(some)
        ends = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups = [[[i for s, e, i in some if lo < e <= hi] for some in spans] for lo, hi in zip([0, *ends], ends)]
        said = ";".join("|".join(",".join(map(str, ids)) for ids in g) for g in groups)
        mine = [(i, j) for s, e, i in spans[0] for u, v, j in spans[1] if s < v and u < e]
        links.append(mine)
        out.append([len(x), len(y), len(groups), len(mine), hashlib.sha256(said.encode()).hexdigest() if x else ""])
    count = Counter(p for mine in links for p in mine)
    best = {}
    for (_, j), n in count.items():
        best[j] = max(best.get(j, 0), n)
    return [(*o[:4], sum(count[p] == best[p[1]] for p in mine), sum(count[p] for p in mine), o[4]) for o, mine in zip(out, links)]


def texts():
    r = random.Random(5)
    out = [None, "", " ", "  a", "a▁b", "<|endoftext|> </s> <unk> <0x41>", "ﬁ Ⅳ é́", "\x00\t\r\n", "don't  stop", "漢字😀 ñandú", "a" * 300, "word " * 60]
    for _ in range(150):
        out.append("".join(r.choice(["the ", "tion", "é", "ß", " ", "\n", "12", ".", "漢", "Ab", "'s", "zq"]) for _ in range(r.choice([2, 10, 60]))))
    return out + out[12:40]


def result(spark, listed, **settings):
    docs = spark.createDataFrame([(None if i == 13 else i, t, 1) for i, t in enumerate(listed)], "doc_id long, text string, n_links int").repartition(3)
    got = {r.doc_id: tuple(r)[1:] for r in T.alignment(docs, A_PATH, B_PATH, **settings).collect()}
    return [got[None if i == 13 else i] for i in range(len(listed))]


def test_against_brute_force(spark):
    listed = texts()
    expected = brute(listed)
    assert sum(e[0] > 0 for e in expected) > 150
    assert result(spark, listed) == expected
    assert result(spark, listed, heavy=1) == expected  # hardly any pair is heavy
    assert result(spark, listed, heavy=10**9) == expected  # all are


def test_parts_of_long_texts(spark, monkeypatch):
    held = T.tokenizers_of(open(A_PATH, "rb").read(), open(B_PATH, "rb").read())
    listed = [t for t in texts() if t]
    whole = held.encode(listed)
    for size in (1, 5, 40):
        monkeypatch.setattr(T.chunks, "__defaults__", (size,))
        assert any(len(T.chunks(t)) > 1 for t in listed)
        assert held.encode(listed) == whole


def test_tallies_in_parts(spark, data, monkeypatch):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    listed = [r.text for r in docs.orderBy("doc_id").collect() if len(r.text or "") < 1500]
    some = docs.filter("text is null or length(text) < 1500")
    expected = brute(listed)
    got = T.alignment(some, A_PATH, B_PATH, heavy=40).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == expected


def test_defined_cases(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert T.alignment(empty, A_PATH, B_PATH).collect() == []
    nothing = spark.createDataFrame([(1, None), (1, ""), (None, "a▁b")], "doc_id long, text string")
    assert {tuple(r)[1:] for r in T.alignment(nothing, A_PATH, B_PATH).collect()} == {(0, 0, 0, 0, 0, 0, "")}
