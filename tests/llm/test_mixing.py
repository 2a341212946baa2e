import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from flowlens.llm import mixing as M


def brute_targets(rows):
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in sizes if s not in fixed]
        rest = total - sum(fixed.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        above = [s for s in free if share[s] > 2 * sizes[s]]
        if not above:
            return sizes, fixed | share
        fixed |= {s: 2.0 * sizes[s] for s in above}


def documents(seed=1):
    r = random.Random(seed)
    names = ["a", "B", "é", "😀", "zz", None, "", "hot", "hot", "hot"]
    rows = []
    for i in range(3000):
        size = 0 if i % 50 == 0 else int(r.paretovariate(1.5) * 5) % 3000
        rows.append((i, "\n" + " \t".join(["w"] * size) if size else r.choice([None, "", "  "]), r.choice(names)))
    return rows + [(7, rows[7][1], rows[7][2])] * 40 + [(None, "x y z", "a"), (None, "x y z", "a")]


def frame(spark, rows):
    return spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, source string, target int")


def test_mix_against_brute_force(spark):
    rows = documents()
    docs = frame(spark, rows)
    got = M.taken(docs).collect()
    assert len(got) == len(rows)
    sizes, targets = brute_targets(rows)
    of = {i: s for i, _, s in rows}
    sums, biggest = defaultdict(int), defaultdict(int)
    for r in got:
        source = "a" if r.doc_id is None else of[r.doc_id]
        assert r.source_size == sizes[source] and abs(r.target - targets[source]) < 1e-6 * max(1, targets[source])
        assert 0 <= r.taken <= 2 * r.size and r.taken % max(r.size, 1) == 0
        sums[source] += r.taken
        biggest[source] = max(biggest[source], r.size)
    for s in sizes:
        assert abs(sums[s] - targets[s]) <= 2 * biggest[s] + 0.02 * targets[s]


def test_reruns_agree_however_rows_are_dealt(spark):
    docs = frame(spark, documents(2))
    key = ["doc_id", "size", "taken"]
    a = sorted(map(str, M.taken(docs).select(key).collect()))
    b = sorted(map(str, M.taken(docs.repartition(7, F.rand(3))).select(key).collect()))
    assert a == b


def test_pivotal_rounding_keeps_the_sum(spark):
    rows = [("s", i, i % 97, 0.3, 1000) for i in range(1000)] + [("t", i, 5, 0.75, 10) for i in range(10)]
    parts = spark.createDataFrame(rows, "source string, doc_id long, size long, p double, units long")
    got = M.rounded(parts).collect()
    assert len(got) == len(rows) == len({(r.source, r.doc_id) for r in got})
    up = sum(r.up for r in got if r.source == "s")
    assert abs(up - 300) <= 1 and sum(r.up for r in got if r.source == "t") in (7, 8)
    # larger and smaller documents are taken alike
    assert abs(sum(r.size for r in got if r.up and r.source == "s") - 0.3 * sum(i % 97 for i in range(1000))) < 300


def test_repeated_rows_in_the_stage(spark):
    docs = frame(spark, documents(3))
    out = M.repeat_rows(docs)
    assert out.columns == docs.columns
    want = M.taken(docs).agg(F.sum("copies")).first()[0]
    assert out.count() == want


def test_sources_in_ranges(spark):
    rows = [(i, "a b", f"s{i:04d}") for i in range(500)]
    units = M.sized(frame(spark, rows))
    got = {r.source: r.weight for r in M.ranked_sources(units).collect()}
    assert got == {f"s{i:04d}": float((5, 2, 1)[i % 3]) for i in range(500)}


def test_empty_tables_and_no_python(spark):
    docs = frame(spark, [])
    assert M.taken(docs).collect() == []
    zero = frame(spark, [(1, None, "a"), (2, "", None)])
    assert [(r.target, r.taken) for r in M.taken(zero).collect()] == [(0.0, 0), (0.0, 0)]
