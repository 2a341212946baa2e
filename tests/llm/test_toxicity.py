import random

import numpy as np

from flowlens.llm import toxicity as X

WORDS = ["stone", "river", "green", "walk", "paper", "music", "table", "cloud", "light", "market", "garden", "winter"]
BAD = ["vilescum", "trashfool", "hatefulrat"]


def documents(n=900, seed=1):
    r = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(r.choice("abcdefgh") for _ in range(3)) + r.choice(WORDS) if r.random() < 0.3 else r.choice(WORDS) for _ in range(r.randint(15, 200))]
        toxic = i % 3 == 0
        for _ in range(3 if toxic else 0):
            words.insert(r.randrange(len(words)), r.choice(BAD))
        rows.append((i, " ".join(words).capitalize() + "."))
        labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_accuracy_and_cases(spark):
    rows, labels = documents()
    truth = dict(labels)
    odd = [(5000, None), (5001, ""), (None, "Some text"), (5002, "stone " * 50_000 + "vilescum trashfool " * 3), (0, rows[0][1])]
    docs = spark.createDataFrame([(*x, 1, 2) for x in rows + odd], "doc_id long, text string, score int, toxic int")
    given = spark.createDataFrame([(*x, "x") for x in labels] + [(5001, None, "x"), (None, 1, "x"), (1, 0, "x")], "doc_id long, toxic int, text string")
    got = X.toxicity(docs, given).collect()
    assert len(got) == len(rows) + len(odd)
    held = [x for x in got if x.held_out and x.doc_id in truth]
    assert np.mean([x.predicted == truth[x.doc_id] for x in held]) > 0.97
    assert all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5) for x in got)
    assert all(x.predicted == 0 for x in got if x.doc_id in (5000, 5001))
    assert X.toxicity(docs.limit(0), given).collect() == []


def test_missing_labels(spark):
    rows, labels = documents(30)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    only = spark.createDataFrame([(i, 1) for i, _ in labels], "doc_id long, toxic int")
    assert {x.score for x in X.toxicity(docs, only).collect()} == {1.0}
    assert {x.score for x in X.toxicity(docs, only.limit(0)).collect()} == {0.0}


def test_windows_hold_every_word():
    for n in (1, 3, 8, 9, 12, 13, 100):
        text = " ".join(f"w{i}" for i in range(n)).encode()
        windows = X.windows(text)
        assert {w for x in windows for w in x.split()} == set(text.split())
        assert b" ".join(X.windows(text, X.WINDOW_WORDS)).split() == text.split()
    assert X.windows(b"") == [] and X.windows(b" . ") == [b"  "]


def test_copies_do_not_make_words_typical():
    ordinary = [f"stone river number{i} walk".encode() for i in range(200)]
    copied = [b"music garden singular table"] * 60
    varied = [f"ord{i} vilescum walk".encode() for i in range(60)]
    words = {w for e in X.excerpts(copied + varied, ordinary) for w in e.split()}
    assert words == {b"vilescum"}


def test_scores_against_plain_windows(spark):
    """Every window of every text, one after the other, by the same fitted model."""
    import zstandard

    rows, labels = documents(300)
    odd = [(7000, None), (7001, "one"), (7002, "stone " * 500 + "vilescum")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string")
    model = X.ToxicityModel.fit(X.learning_rows(docs, spark.createDataFrame(labels, "doc_id long, toxic int")))
    got = {r.doc_id: r for r in X.score(docs, model).collect()}

    def size(data, dictionary):
        held = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        packer = zstandard.ZstdCompressor(level=X.LEVEL, dict_data=held, write_checksum=False, write_content_size=False, write_dict_id=False)
        return len(packer.compress(data))

    for i, text in (rows + odd)[::7] + odd:
        listed = [w.strip(".,;:!?\"'()|") for w in (text or "").lower().split()]
        spans, at = [], 0
        while listed and (at == 0 or at + X.STRIDE_WORDS < len(listed)):
            spans.append(f" {' '.join(listed[at : at + X.WINDOW_WORDS])} ".encode())
            at += X.STRIDE_WORDS
        saved = sorted((size(s, model.dictionaries.ordinary) - size(s, model.dictionaries.toxic) for s in set(spans)), reverse=True)
        x = [1.0, saved[0], sum(saved[: X.TOP]) / X.TOP, np.log1p(len(saved))] if saved else [1.0, 0, 0, 0]
        p = 1 / (1 + np.exp(-np.dot(x, model.weights)))
        assert abs(got[i].score - p) < 1e-9 and got[i].predicted == int(p >= 0.5)


def test_bounds_keep_the_strongest_and_spread_evenly():
    typical = {b"w%04d" % i: float(i) for i in range(3000)}
    kept = X.each_once(typical, 1200).split()
    assert kept == sorted(typical, key=typical.get)[-200:]
    assert X.each_once(typical, 10**6).split() == sorted(typical)
    assert X.evenly(list(range(10)), 10) == list(range(10))
    some = X.evenly(list(range(1000)), 7)
    assert len(some) == 7 and some[-1] > 800 and max(b - a for a, b in zip(some, some[1:])) < 150


def test_late_words_are_learned(spark):
    """Typical words at the end of the alphabet, and more of them than a small dictionary holds."""
    r = random.Random(4)
    bad = [c + "".join(r.choice("bcdfghjk") for _ in range(60)) for c in "az" for _ in range(45)]
    assert sum(map(len, bad)) > X.TOXIC_BYTES
    rows, labels = [], []
    for i in range(1600):
        words = [r.choice(WORDS) for _ in range(60)]
        if i % 2:
            at = r.randrange(len(words))
            words[at:at] = r.sample(bad, 3)
        rows.append((i, " ".join(words)))
        labels.append((i, i % 2))
    late = [(9000 + i, " ".join([r.choice(WORDS) for _ in range(30)] + r.sample(bad[45:], 3))) for i in range(40)]
    docs = spark.createDataFrame(rows + late, "doc_id long, text string")
    got = {g.doc_id: g.predicted for g in X.toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert np.mean([got[i] for i, _ in late]) > 0.9
