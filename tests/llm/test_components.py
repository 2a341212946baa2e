import random

from flowlens.llm.components import components


def brute(edges):
    label = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(label[a], label[b])
            if label[a] != m or label[b] != m:
                label[a] = label[b] = m
                changed = True
    return label


def test_against_brute_force(spark):
    r = random.Random(3)
    edges = [(r.randrange(-300, 300), r.randrange(-300, 300)) for _ in range(250)]
    edges += [(1000, 1000 + i) for i in range(1, 300)] + [(2000 + i, 2001 + i) for i in range(60)] + edges[:20]
    want = {k: v for k, v in brute([e for e in edges if e[0] != e[1]]).items()}
    got = components(spark.createDataFrame(edges + [(5000, 5000), (None, 3)], "a long, b long")).collect()
    assert len(got) == len(want) and dict(map(tuple, got)) == want


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
