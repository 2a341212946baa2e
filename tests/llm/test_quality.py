import random

import numpy as np

from flowlens.llm import quality as Q


def plain_features(text):
    """Word by word and character by character."""
    marked, out = f" {text}", []
    starts = [i for i in range(1, len(marked)) if marked[i - 1].isspace() and not marked[i].isspace()]
    groups = [starts[i : i + Q.PASSAGE_WORDS] for i in range(0, len(starts), Q.PASSAGE_WORDS)] or [[]]
    kinds = [next((Q.FIRST_SIGN + k for k, s in enumerate(Q.SIGNS) if c in s), None) or Q._kind(c) for c in marked]
    for g, group in enumerate(groups):
        a = 0 if g == 0 else group[0]
        b = groups[g + 1][0] if g + 1 < len(groups) else len(marked)
        single, pairs = np.zeros(Q.KINDS), np.zeros((Q.KINDS, Q.KINDS))
        for i in range(a, b):
            single[kinds[i]] += 1
            if i:
                pairs[kinds[i - 1], kinds[i]] += 1
        words = [marked[i:].split(None, 1)[0] for i in group]
        n = len(words)
        sizes = [len(w) for w in words] or [0]
        stats = [
            len(set(words)) / max(n, 1), sum(x == y for x, y in zip(words, words[1:])) / max(n, 1),
            np.log1p(np.mean(sizes)), np.log1p(np.std(sizes)), n / Q.PASSAGE_WORDS, n == 0,
        ]
        out.append(np.concatenate([single / max(b - a, 1), pairs.ravel() / max(b - a, 1), stats]))
    return np.array(out)


def texts():
    r = random.Random(3)
    some = ["", " ", "\n\n", "a", "  two words ", "é!É 漢字 x😀 9", "same " * 200, "no_space" * 500]
    return some + ["".join(r.choice("ab cD.!|\n é9#") for _ in range(r.choice([5, 50, 900]))) for _ in range(60)]


def test_passages_against_plain_features():
    listed = texts()
    x, owner = Q.passages(listed)
    for i, text in enumerate(listed):
        assert np.allclose(x[owner == i], plain_features(text), atol=1e-5), repr(text)
    assert Q.passages([""])[0].shape == (1, Q.FEATURES)


def test_blocks_hold_the_whole_text():
    for text in texts():
        for size in (3, 10, 1000):
            cut = list(Q.blocks(text, size))
            assert "".join(cut) == text and all(len(b) <= size for b in cut)


def test_gradient():
    r = np.random.default_rng(1)
    x, owner = r.standard_normal((23, 9)), np.sort(np.append(r.integers(0, 6, 17), np.arange(6)))
    y, weight = np.array([1.0, 0, 1, 0, 0, 1]), r.random(6)
    model = Q.Attention.new(x)
    _, slope = model.gradient(x, owner, y, weight)
    for k, w in enumerate(model.weights):
        for at in [()] if np.ndim(w) == 0 else [tuple(r.integers(0, s) for s in w.shape) for _ in range(6)]:
            values = []
            for step in (1e-5, -1e-5):
                moved = np.array(w, float)
                moved[at] += step
                held, model.weights[k] = model.weights[k], moved
                values.append(model.gradient(x, owner, y, weight)[0])
                model.weights[k] = held
            assert abs((values[0] - values[1]) / 2e-5 - np.asarray(slope[k])[at]) < 1e-6


def test_scores_against_plain_attention(spark, data):
    """The query's scores, text by text from the learned weights."""
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    model, share = Q.fit(docs, labels)
    got = {r.doc_id: r for r in Q.score(docs, model, share).collect()}
    layer, bias, turn, gate, attend, out, shift = model.weights
    for r in docs.collect():
        x = np.clip((plain_features(r.text or "") - model.mean) / model.spread, -8, 8)
        code = np.tanh(x @ layer + bias)
        a = np.exp((np.tanh(code @ turn) / (1 + np.exp(-(code @ gate)))) @ attend)
        p = 1 / (1 + np.exp(-((a / a.sum()) @ code @ out + shift)))
        assert abs(got[r.doc_id].score - p) < 1e-4
        assert got[r.doc_id].predicted == int(got[r.doc_id].score >= 0.3)


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    scored = Q.quality(docs, labels).join(labels.drop("toxic"), "doc_id").filter("held_out").collect()
    good = [r.predicted for r in scored if r.quality == 1]
    bad = [r.predicted for r in scored if r.quality == 0]
    assert len(good) > 500 and np.mean(good) > 0.97 and np.mean(bad) < 0.1


def test_defined_cases(spark):
    r = random.Random(2)
    good = [" ".join(r.choice(["river", "stone", "walks", "under"]) for _ in range(90)) for _ in range(40)]
    bad = ["$$ ## " * r.randrange(5, 90) for _ in range(40)]
    rows = [(i, t, 7) for i, t in enumerate(good + bad)] + [(500, None, 1), (501, "", 1), (502, " \n", 1), (None, good[0], 1), (0, good[0], 7), (503, "x" * 3_000_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int")
    labels = spark.createDataFrame(
        [(i, 1, 0) for i in range(40)] + [(i, 0, 0) for i in range(40, 80)] + [(0, 0, 0), (None, 1, 0), (3, None, 0), (999, 1, 1)],
        "doc_id long, quality int, score int",
    )
    got = Q.quality(docs, labels).collect()
    assert [g.doc_id for g in got] == [x[0] for x in rows] and all(0 <= g.score <= 1 for g in got)
    assert all(g.predicted == 1 for g in got[:40]) and all(g.predicted == 0 for g in got[40:80])
    assert got[0].score == got[84].score == got[83].score and not got[83].held_out
    assert got[80].score == got[81].score
    none = Q.quality(docs, labels.filter("quality = 1")).collect()
    assert {g.score for g in none} == {1.0}
    assert {g.score for g in Q.quality(docs, labels.limit(0)).collect()} == {0.0}
    assert Q.quality(docs.limit(0), labels).collect() == []
