import hashlib
import math
import random

import numpy as np

from flowlens.llm import vector_codes as V


def brute(rows, parts=V.PARTS, entries=V.ENTRIES, rounds=V.ROUNDS):
    """Every part against every entry, in Python integers."""
    usable = [(i, v, label) for i, v, label in rows if v and len(v) % parts == 0 and all(x is not None and math.isfinite(x) for x in v)]
    usable = [(i, [math.floor(x * 1024) for x in v], label) for i, v, label in usable]
    usable.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    usable = [r for r in usable if len(r[1]) == len(usable[0][1])]
    width = len(usable[0][1]) // parts
    cut = lambda v: [v[p * width : (p + 1) * width] for p in range(parts)]
    books = [[cut(v)[p] for _, v, _ in usable[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            mine = {}
            for _, v, _ in usable:
                x = cut(v)[p]
                mine.setdefault(nearest(x, books[p])[1], []).append(x)
            for k, xs in mine.items():
                books[p][k] = [sum(c) // len(xs) for c in zip(*xs)]
    out, totals = [], {}
    for i, v, label in usable:
        found = [nearest(x, books[p]) for p, x in enumerate(cut(v))]
        error = sum(d for d, _ in found)
        out.append((i, "".join(f"{k:02x}" for _, k in found), error, label))
        totals[label] = totals.get(label, 0) + error
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    fit = lambda x: x if x < 1 << 63 else None
    whole = {label: all(r[2] < 1 << 63 for r in out if r[3] == label) for label in totals}
    return sorted(
        ((i, c, fit(e), fit(totals[label]) if whole[label] else None, digest) for i, c, e, label in out), key=str
    )


def run(spark, rows, **settings):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    return sorted((tuple(r) for r in V.compressed(df.selectExpr("*", "1 as code", "2 as cells"), **settings).collect()), key=str)


def test_search_against_all_entries():
    r = np.random.default_rng(4)
    for dtype in (np.float64, np.int64, object):
        for m in (1, 3, 40, 256):
            book, rows = r.integers(-30, 30, (m, 8)), r.integers(-40, 40, (300, 8))
            book[m // 2] = book[0]
            cast = lambda x: np.array(x.tolist(), dtype)
            far = ((rows[:, None] - book[None]) ** 2).sum(2)
            for tile, step in ((1, 1), (7, 3), (256, 16)):
                which, best = V.Book(cast(book)).nearest(cast(rows), tile, step)
                assert (which == far.argmin(1)).all() and (best == far.min(1)).all()


def test_against_brute_force(spark):
    r = random.Random(1)
    rows = [(i, [r.gauss(0, 0.1) for _ in range(8)], r.choice([1, 2, None])) for i in range(400)]
    rows += [(500, None, 1), (501, [None] * 8, 1), (502, [float("nan")] + [0.0] * 7, 1), (503, [float("inf")] * 8, 1), (504, [], 1), (505, [1.0] * 7, 1), (506, [1.0] * 16, 1)]
    rows += [(3, rows[3][1], 2), (3, [0.5] * 8, 2), (None, rows[9][1], 1), (None, [-0.3] * 8, 1), rows[20], rows[20]]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, entries=16, rounds=2) == brute(rows, entries=16, rounds=2)
    assert run(spark, rows[:5]) == brute(rows[:5])
    assert run(spark, []) == [] and run(spark, rows[400:403]) == []


def test_large_components(spark):
    r = random.Random(6)
    for size in (1e5, 1e9, 1e30):
        rows = [(i, [r.uniform(-size, size) for _ in range(8)], r.choice([1, 2])) for i in range(40)]
        assert run(spark, rows, entries=6) == brute(rows, entries=6)


def test_copies_in_one_place(spark):
    rows = [(i, [0.25] * 8, 1) for i in range(300)] + [(1000 + i, [0.001 * i] * 8, 2) for i in range(30)]
    assert run(spark, rows) == brute(rows)
