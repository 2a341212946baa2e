import random
import tracemalloc

import numpy as np

from flowlens.llm import langid as L

SYLLABLES = {
    "en": ["the", "ing", "tion", "and", "er", "ly", "th"], "de": ["sch", "ung", "der", "ei", "ß", "ü", "keit"],
    "es": ["ción", "os", "ñ", "que", "ado", "ll", "la"], "fr": ["eau", "é", "ç", "tion", "le", "oi", "ê"], "xx": ["кот", "да", "не", "ши", "я", "пр"],
}


def text(r, lang, words=40):
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 3))) for _ in range(words))


def documents(langs=tuple(SYLLABLES), n=300, seed=1):
    r = random.Random(seed)
    return [(i, text(r, (lang := langs[i % len(langs)])), lang) for i in range(n)]


def test_codewords_are_apart():
    for n in (2, 3, 4, 5, 9, 30):
        code = L.codewords(n)
        distance = (code[:, None, :] != code[None]).sum(-1) + np.eye(n) * 99
        assert distance.min() >= (1 if n == 2 else 2)
        assert all(len(set(c)) == 2 for c in code.T)


def test_gram_counts_do_not_depend_on_blocks():
    r = random.Random(2)
    long = text(r, "fr", 260_000)
    assert len(long) > 1 << 20
    codes = long.lower()
    assert L.gram_counts(long).sum() == sum(len(codes) - n + 1 for n in L.ORDERS)
    assert (L.gram_counts("") == 0).all() and L.gram_counts("a").sum() == 1


def test_held_out_accuracy_and_cases(spark):
    rows = documents()
    odd = [(1000, None, "en"), (1001, "", "de"), (1002, "123 456 !", None), (None, text(random.Random(5), "de"), "de"), (5, rows[5][1], rows[5][2]), (1003, text(random.Random(3), "fr"), None)]
    docs = spark.createDataFrame([(*x, "s", 0.5) for x in rows + odd], "doc_id long, text string, lang string, source string, score double")
    got = L.identified(docs).collect()
    assert len(got) == len(rows) + len(odd)
    want = {i: lang for i, _, lang in rows} | {1003: "fr"}
    right = [x.lang_pred == want[x.doc_id] for x in got if x.doc_id in want]
    assert np.mean(right) > 0.98
    assert {x.held_out for x in got} == {True, False} and all(0 <= x.score <= 1 for x in got)
    assert all(x.lang_pred == "und" and x.score == 0 for x in got if x.doc_id in (1000, 1001, 1002))
    kept = L.keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows) + len(odd) - 3


def test_folds_follow_crc32(spark):
    import zlib

    got = spark.range(200).select("id", L.held_out("id").alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in got)


def test_few_labels(spark):
    schema = "doc_id long, text string, lang string"
    one = spark.createDataFrame(documents(("en",), 20), schema)
    assert {x.lang_pred for x in L.identified(one).collect()} == {"en"}
    none = spark.createDataFrame([(i, t, None) for i, t, _ in documents(("en",), 5)], schema)
    assert {x.lang_pred for x in L.identified(none).collect()} == {"und"}
    assert L.identified(none.limit(0)).collect() == []


def test_no_language_is_lost(spark):
    """Two rows of one language among thousands of others, and as many languages as the sample has room for."""
    r = random.Random(5)
    rows = [(i, text(r, "en", 10), "en") for i in range(3000)] + [(5000 + i, text(r, "xx", 10), "xx") for i in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert L.LanguageModel.fit(docs, sample_rows=40, rounds=2).languages == ("en", "xx")
    many = spark.createDataFrame([(i, f"word {i % 1200}", f"l{i % 1200:04d}") for i in range(2400)], "doc_id long, text string, lang string")
    assert len(L.LanguageModel.fit(many, rounds=1).languages) == 1200


def test_predictions_against_plain_scores(spark):
    """Gram by gram and language by language, by the same fitted model."""
    rows = documents(n=100) + [(900, "", "en"), (901, "12 34", "en"), (902, "Ça va, straße?", "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.LanguageModel.fit(docs)
    got = {g.doc_id: g for g in L.predict(docs, model).collect()}
    primes = [0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35]
    for i, content, _ in rows[::5] + rows[-3:]:
        codes = [ord(c) if ord(c) >= 128 or "a" <= c <= "z" else 32 for c in content.lower()]
        counts = [0] * L.FEATURES
        for n in L.ORDERS:
            for at in range(len(codes) - n + 1):
                key = n
                for k in range(n):
                    key = ((key ^ codes[at + k]) * primes[k]) % 2**32
                    key ^= key >> 15
                counts[key % L.FEATURES] += 1
        x = [c**0.5 for c in counts]
        length = max(sum(v * v for v in x) ** 0.5, 1e-12)
        used = [k for k, v in enumerate(x) if v]
        bits = [sum(x[k] / length * model.weights[k, b] for k in used) + model.bias[b] for b in range(model.code.shape[1])]
        loss = [sum(t * np.log1p(np.exp(-c * v)) for t, c, v in zip(model.trust, word, bits)) for word in model.code]
        odds = [np.exp(-(value - min(loss)) * len(bits)) for value in loss]
        letter = any(c.isalpha() for c in content)
        assert got[i].lang_pred == (model.languages[int(np.argmin(loss))] if letter else "und")
        assert abs(got[i].score - (max(odds) / sum(odds) if letter else 0.0)) < 1e-5


def test_fitting_holds_one_matrix(spark):
    """What the driver takes while it learns is the sample's features once, in single precision."""
    rows = [(i, " ".join(f"{w}{(i * 7 + k) % 50}" for k, w in enumerate(("the", "der", "les", "una") * 9)), "ab"[i % 2]) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    L.LanguageModel.fit(docs, rounds=1)  # what is loaded once is not counted
    tracemalloc.start()
    try:
        L.LanguageModel.fit(docs, rounds=2)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 1.5 * len(rows) * L.FEATURES * 4
