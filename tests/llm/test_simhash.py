import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from flowlens.llm import simhash as S


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(prints, ids, limit=4):
    distinct = sorted(set(prints))
    values = np.array(distinct, np.uint64)
    label = {f: min((i for p, i in zip(prints, ids) if p == f and i is not None), default=10**18) for f in distinct}
    links = np.argwhere(np.bitwise_count(values[:, None] ^ values[None, :]) <= limit)
    links = [(distinct[a], distinct[b]) for a, b in links if a < b]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(label[a], label[b])
            if (label[a], label[b]) != (m, m):
                label[a] = label[b] = m
                changed = True
    return [label[p] if label[p] < 10**18 else None for p in prints]


def unsigned(fp):
    return fp & (2**64 - 1)


def test_fingerprints_match_definition(spark):
    texts = [None, "", " \n\t", "One", "a b c", "a b c d", "ÄB c D e f g h", "x " * 5000, "the Quick brown fox " * 3]
    rows = list(enumerate(texts))
    got = {r.doc_id: unsigned(r.fp) for r in S.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: brute_fingerprint(t) for i, t in rows}


def test_spark_hash_is_the_same(spark):
    row = spark.range(1).select(F.xxhash64(F.lit("a bé c d")).alias("h")).first()
    assert unsigned(row.h) == xxhash.xxh64_intdigest("a bé c d".encode(), 42)


def near(r, base, most):
    for b in r.sample(range(64), r.randint(0, most)):
        base ^= 1 << b
    return base


def test_links_against_brute_force():
    for seed in range(6):
        r = random.Random(seed)
        prints = [r.getrandbits(64) for _ in range(150)]
        for _ in range(10):
            centre = r.getrandbits(64)
            prints += [near(r, centre, r.choice([2, 4, 6])) for _ in range(r.choice([3, 40]))]
        chain = r.getrandbits(64)
        for k in range(12):
            prints.append(chain)
            chain = chain ^ sum(1 << (4 * k + j) % 64 for j in range(4))
        distinct = np.array(sorted(set(prints)), np.uint64)
        edges = S.bucket_links(distinct, np.ones(len(distinct), bool))
        assert all((int(distinct[a]) ^ int(distinct[b])).bit_count() <= 4 for a, b in edges)
        forest = S.Forest(len(distinct))
        for a, b in edges:
            assert forest.join(a, b)
        true = brute_components([int(x) for x in distinct], list(range(len(distinct))))
        assert [forest.root(i) for i in range(len(distinct))] == true


def test_plan_satisfies_the_pigeonhole():
    r = np.random.default_rng(0)
    for n in (1, 100, 10**6, 10**9):
        bits = (r.random((500, 64)) < 0.5).astype(float)
        parts = S.plan(n, bits.T @ bits * n / 500)
        assert sum(t + 1 for _, t in parts) == 5
        used = [b for part, _ in parts for b in part]
        assert len(used) == len(set(used))


def test_groups_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(S, "SMALL_BUCKET", 8)
    r = random.Random(7)
    words = [f"w{i}" for i in range(300)]
    texts = [None, "", " ", "one", "One"]
    for k in range(60):
        base = [r.choice(words) for _ in range(r.choice([4, 30, 400]))]
        texts.append(" ".join(base))
        for _ in range(r.choice([0, 0, 3, 30]) if k < 8 else 0):
            edited = list(base)
            edited[r.randrange(len(edited))] = r.choice(words)
            texts.append(" ".join(edited))
    ids = list(range(len(texts)))
    r.shuffle(ids)
    ids[3] = None
    rows = [(i, t, "x", "y") for i, t in zip(ids, texts)] + [(ids[10], texts[10], "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id string")
    got = sorted((x.doc_id is None, x.doc_id or 0, unsigned(x.fp), x.component_id) for x in S.near_groups(docs).collect())
    prints = [brute_fingerprint(t) for _, t, *_ in rows]
    want = brute_components(prints, [i for i, *_ in rows])
    assert got == sorted((i is None, i or 0, p, c) for (i, *_), p, c in zip(rows, prints, want))
    kept = S.drop_near(docs)
    assert kept.columns == docs.columns
    assert {x.doc_id for x in kept.collect()} - {None} == {c for c in want if c is not None}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert S.near_groups(docs).collect() == []
