import numpy as np

from flowlens.llm import embedding_dedup as E


def brute(rows, threshold=0.93):
    """Links and components by all pairs."""
    n = len(rows)
    unit, usable = [], []
    for _, v, label in rows:
        ok = label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(x for x in v)
        usable.append(ok)
        unit.append(np.array(v, float) / np.linalg.norm(v) if ok else None)
    links = [set() for _ in rows]
    for i in range(n):
        for j in range(i):
            if usable[i] and usable[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold:
                links[i].add(j)
                links[j].add(i)
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        component = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((rows[i][0], len(links[i]), component, rows[i][0] == component))
    return sorted(out, key=str)


def clustered(seed=1):
    r = np.random.default_rng(seed)
    rows = []
    for k in range(12):
        centre = r.standard_normal(24)
        for _ in range([1, 2, 5, 60][k % 4]):
            rows.append((centre + r.standard_normal(24) * 0.05 * (1 + k % 3)).astype(np.float32).tolist())
    rows += r.standard_normal((150, 24)).astype(np.float32).tolist()
    rows += [rows[0]] * 5
    return [(i, v, i % 2 if i > 100 else 0) for i, v in enumerate(rows)]


def spark_rows(spark, rows):
    return spark.createDataFrame([(i, v, x, 7) for i, v, x in rows], "vec_id long, embedding array<float>, label int, n_links int")


def test_links_against_brute_force(spark, monkeypatch):
    rows = clustered()
    rows += [
        (900, None, 0), (901, [0.0] * 24, 0), (902, [float("nan")] * 24, 0), (903, [1.0] + [None] * 23, 0), (904, rows[0][1], None),
        (905, [float("inf")] + [1.0] * 23, 0), (906, [1.0, 2.0], 0), (907, [2.0, 4.0], 0), (908, [], 0), (3, rows[3][1], 0), (None, rows[4][1], 0),
    ]
    got = sorted(map(tuple, E.near_vectors(spark_rows(spark, rows)).collect()), key=str)
    assert got == brute(rows)


def test_small_windows_and_blocks(spark, monkeypatch):
    rows = clustered(2)
    vectors, nodes = E.nodes_of(spark_rows(spark, rows), "vec_id", "embedding", "label")
    blocks = E.neighbours(E.codes(nodes, 2), window=4, block=16)
    places = [(r.place, r.block) for r in blocks.collect()]
    total = 2 * nodes.count()
    assert sorted(p for p, b in places if p // 16 == b) == list(range(total))
    assert sorted(p for p, b in places if p // 16 == b + 1) == [p for p in range(16, total) if p % 16 < 4]
    members = nodes.selectExpr("cast(0 as long) component", "node", "copies", "v").filter("label = '0'")
    linked = {r.node: r.linked for r in E.counted_links(members, block=20).collect()}
    every = {r.node: (np.array(r.v) / np.linalg.norm(r.v), r.copies) for r in members.collect()}
    for a, (va, _) in every.items():
        assert linked[a] == sum(n for b, (vb, n) in every.items() if b != a and va @ vb >= 0.93)


def test_passes_grow_with_the_label():
    assert E.passes(10) == 1
    assert E.passes(1000) < E.passes(10**6) < E.passes(10**9)


def test_crowded_cone_against_brute_force(spark):
    r = np.random.default_rng(5)
    axis = r.standard_normal(32)
    axis /= np.linalg.norm(axis)

    def cone(x):
        return np.sqrt(0.85) * axis + np.sqrt(0.15) * x / np.linalg.norm(x)

    rows = []
    for _ in range(1200):
        x = r.standard_normal(32)
        rows += [cone(x), cone(x + 0.5 * np.linalg.norm(x) * r.standard_normal(32) / np.sqrt(32))]
    rows = [(i, v.astype(np.float32).tolist(), 0) for i, v in enumerate(rows)]
    unit = np.array([v for _, v, _ in rows], float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.93).sum(1) - 1
    got = {x.vec_id: x.n_links for x in E.near_vectors(spark_rows(spark, rows)).collect()}
    found = sum(min(got[i], n) for i, n in enumerate(want))
    assert want.sum() > 1000 and found >= 0.995 * want.sum()


def test_empty_table(spark):
    assert E.near_vectors(spark_rows(spark, [])).collect() == []
