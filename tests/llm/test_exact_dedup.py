import hashlib
import random
import re

from flowlens.llm import exact_dedup as D


def brute(rows):
    groups = {}
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    for i, t in rows:
        groups.setdefault(norm(t), []).append((-len(t or ""), i is None, i or 0))
    out = []
    for i, t in rows:
        group = groups[norm(t)]
        best = min(group)
        keep = None if best[1] else best[2]
        out.append((i, keep, len(group), hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=str)


def rows():
    r = random.Random(1)
    long = "".join(r.choice("abcdefgh é\n") for _ in range(120_000))
    texts = [None, "", " \t\n", "a b", "ab", "a  b", "é x", "é x", long, long + " ", long[:-1] + "z", "q" * 60_000, "q" * 59_999 + " q", long[5:]]
    out = [(i, r.choice(texts)) for i in range(120)]
    return out + [(None, "ab"), (None, None), (7, out[7][1]), (7, out[7][1])]


def check(spark, **options):
    data = rows()
    docs = spark.createDataFrame([(i, t, "x") for i, t in data], "doc_id long, text string, kept string")
    got = D.exact_groups(docs, **options).collect()
    assert sorted(((x.doc_id, x.keep_id, x.group_size, x.text_sha256) for x in got), key=str) == brute(data)
    groups = {}
    for x in got:
        groups.setdefault(x.text_sha256, []).append(x.kept)
    assert all(sum(k) == 1 for k in groups.values())
    return docs, len(groups)


def test_groups_and_stage_against_brute_force(spark):
    docs, groups = check(spark)
    kept = D.drop_exact(docs)
    assert kept.columns == docs.columns and kept.count() == groups


def test_weak_digests_are_noticed(spark):
    check(spark, digests=(lambda b: hashlib.sha256(b).digest()[:1], *D.DIGESTS))


def test_cuts_depend_on_content():
    r = random.Random(2)
    data = bytes(r.randrange(97, 123) for _ in range(200_000))
    chunks = D.cut(data)
    assert b"".join(chunks) == data and max(map(len, chunks)) <= D.MAX_CHUNK
    moved = D.cut(b"some words in front" + data)
    assert len(set(chunks) & set(moved)) > 0.9 * len(chunks)
    assert D.cut(b"") == [] and D.cut(b"x" * 50_000)[0] == b"x" * D.MAX_CHUNK


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert D.exact_groups(docs).collect() == [] and D.drop_exact(docs).collect() == []
