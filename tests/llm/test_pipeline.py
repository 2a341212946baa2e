import hashlib
import re
from collections import Counter

import __spark_entry__ as entry
import corpus_pipeline as C
import public_tokenizers
import tiktoken

from flowlens.llm.bpe import read_ranks
from test_simhash import brute_components, brute_fingerprint


def test_stages_against_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    before, kept = {r.doc_id: r for r in docs.collect()}, {}
    rows = docs
    for name, stage in C.STAGES[:-1]:
        rows = C.stored(stage(spark, rows, data), name)
        assert rows.columns == docs.columns
        kept[name] = Counter(r.doc_id for r in rows.collect())
        assert all(before[r.doc_id] == r for r in rows.collect())
    assert set(kept["language_codes"]) == {i for i, r in before.items() if any(map(str.isalpha, r.text or ""))}
    groups = {}
    for i in kept["language_codes"]:
        text = before[i].text
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text), []).append((-len(text), i))
    assert set(kept["exact_dedup"]) == {min(g)[1] for g in groups.values()}
    ids = sorted(kept["exact_dedup"])
    component = brute_components([brute_fingerprint(before[i].text) for i in ids], ids)
    assert set(kept["simhash"]) == set(component)
    assert set(kept["mixing"]) <= set(kept["simhash"]) and max(kept["mixing"].values()) <= 2
    words = lambda i: len(re.findall(r"[^\x20\x09-\x0D]+", before[i].text))
    total = sum(map(words, kept["simhash"]))
    assert abs(sum(n * words(i) for i, n in kept["mixing"].items()) - 1.5 * total) < 0.25 * total
    last = C.STAGES[-1][1](spark, rows, data).collect()
    ranks = read_ranks(open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read().splitlines())
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert Counter(r.doc_id for r in last) == kept["mixing"]
    for r in last[:100]:
        assert r.n_tokens == len(library.encode_ordinary(before[r.doc_id].text))
        assert r.decoded_sha256 == hashlib.sha256(before[r.doc_id].text.encode()).hexdigest()
    whole = Counter(r.doc_id for r in C.run(spark, data).collect())
    assert whole == kept["mixing"]


def test_registered():
    names = entry.queries()
    assert "pipeline" in names and {f"op{n}" for n in range(1, 14)} == {k.split("_")[0] for k in names if re.match(r"op\d+_", k)}
