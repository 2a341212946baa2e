import gzip
import hashlib
import random

import pytest

from flowlens.llm import warc as W


def test_record_ids_carry_page_ids():
    for page in (0, 1, -1, 2**63 - 1, -(2**63), 123456789012, None):
        for kind in W.KINDS:
            assert W.page_of(W.record_id(page, 2**52 - 1, kind)) == page
    assert len({W.record_id(p, m, k) for p in (None, 0, 1) for m in (0, 1) for k in W.KINDS}) == 18


def brute(pages):
    payloads = [(p, (h or "").encode()) for p, _, h in pages]
    out = []
    for page, data in payloads:
        ids = [p for p, d in payloads if d == data and p is not None]
        last = max(ids, default=None)
        revisit = len(data) >= 1000 and page != last and sum(d == data for _, d in payloads) > 1
        out.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", last if revisit else None, 2))
    return sorted(out, key=str)


def test_round_trip_against_brute_force(spark):
    r = random.Random(3)
    big = ["<p>%s</p>\r\n\r\nWARC/1.1\r\n" % ("é" * n) for n in (480, 500, 2000)] + ["x" * 999, "y" * 1000, "", None, "z" * 300_000]
    pages = [(i, f"http://h/{i}\n" if i % 3 else None, r.choice(big)) for i in range(200)]
    pages += [(None, "u", big[2]), (None, None, "w" * 1500), (5, "u", big[4]), (-7, "u", "only" * 400), *[(500, "u", big[2])] * 2]
    rows = [(p, u, h, "x") for p, u, h in pages]
    got = W.archived(spark.createDataFrame(rows, "page_id long, url string, html string, payload string")).collect()
    assert sorted(map(tuple, got), key=str) == brute(pages)


def test_files_are_plain_gzip_and_roll(spark):
    pages = spark.createDataFrame([(i, "u", f"{i}" * 2000) for i in range(40)], "page_id long, url string, html string")
    manifest = W.write_warc(pages.coalesce(1), roll_bytes=2000).collect()
    assert len(manifest) > 1
    total = 0
    for path, records in manifest:
        data = gzip.open(path.removeprefix("file://")).read()
        found = list(W.parse(data))
        assert len(found) == records
        total += records - 1
    assert total == 120


def test_transactions_link_both_ways(spark):
    def row(rid, kind, to=()):
        return (rid, kind, list(to), None, None, None, None, 0, "", None)

    records = [
        row("c1", "response"), row("q1", "request", ["c1"]), row("m1", "metadata", ["q1"]), row("m2", "metadata", ["c1"]),
        row("c2", "response", ["q2"]), row("q2", "request"), row("c3", "revisit"), row("q9", "request", ["gone"]),
    ]
    got = W.transactions(spark.createDataFrame(records, W.RECORD)).collect()
    seen = {x.capture.record_id: (x.request and x.request.record_id, [m.record_id for m in x.metadata or []]) for x in got}
    assert seen == {"c1": ("q1", ["m1", "m2"]), "c2": ("q2", []), "c3": (None, [])}


def test_broken_archives_are_refused():
    with pytest.raises(ValueError):
        list(W.parse(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n"))
    with pytest.raises(ValueError):
        list(W.parse(b"HTTP/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"))


def test_empty_table(spark):
    assert W.archived(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
