import hashlib
from collections import Counter

import numpy as np
import pytest

from lectern.llm import line_dedup as ld
from lectern.llm.common import ASCII_SPACE


def slow(rows, min_docs=10, min_chars=1):
    keys = [[line.strip(ASCII_SPACE).lower() for line in (t or "").encode().split(b"\n")] for _, t in rows]
    df = Counter(k for ks in keys for k in set(ks) if len(k.decode()) >= min_chars)
    out = []
    for (i, t), ks in zip(rows, keys, strict=True):
        kept = [line for line, k in zip((t or "").encode().split(b"\n"), ks, strict=True) if df[k] < min_docs]
        out.append((str(i), len(ks), len(ks) - len(kept), hashlib.sha256(b"\n".join(kept)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("send", [ld.SEND_BYTES, -1])
def test_query_against_brute_force(spark, odd_docs, no_docs, data, send):
    docs = odd_docs.select("doc_id", "text").union(spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.kept_sha256) for r in ld.line_digests(docs, send_bytes=send).collect())
    assert got == slow(rows)
    assert sum(r[2] for r in got) > 12
    assert ld.line_digests(no_docs, send_bytes=send).collect() == []


def test_longer_keys_and_fewer_documents(spark):
    rows = [(k, f"ää\nlonger {k % 3}\n\x0b\nend") for k in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.kept_sha256) for r in ld.line_digests(docs, 3, 3).collect())
    assert got == slow(rows, 3, 3)


@pytest.mark.parametrize("send", [ld.SEND_BYTES, -1])
def test_hashes_that_keys_share_only_cost_traffic(spark, odd_docs, send):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()] + [(1000 + k, f"a {k % 30}\nb {k}\nc {k % 7}") for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.kept_sha256) for r in ld.line_digests(docs, bits=6, send_bytes=send).collect())
    assert got == slow(rows)


def segment(lines_of_parcels, bits=None):
    held = []
    for lines in lines_of_parcels:
        h, n = np.unique(ld.hashes_of(lines)[1], return_counts=True)
        held.append((0, ld.steps(h), ld.planes(n.astype(np.uint32))))
    return ld.Segment(held, bits)


@pytest.mark.parametrize("bits", [None, 1 << 6])
def test_filters_have_no_false_negatives_and_counts_are_exact(bits):
    parcels = [[b"line %d" % k for k in range(500)], [b"only %d" % k for k in range(1000)], [b"line %d" % k for k in range(250)], [b"twice", b"twice"]]
    found = segment(parcels, bits)
    h, n = found.suspected(2)
    assert dict(zip(h.tolist(), n.tolist(), strict=True)) == {ld.hashes_of([x])[1].item(): 2 for x in [b"line %d" % k for k in range(250)] + [b"twice"]}
    again = ld._get(found.twice, ld.places(ld.hashes_of([b"only %d" % k for k in range(1000)])[1], found.bits))
    assert again.mean() < 0.05 if bits is None else again.all()


def test_segments_follow_the_lines(spark, monkeypatch):
    monkeypatch.setattr(ld, "SEGMENT", 20)
    monkeypatch.setattr(ld, "LEAST_SEGMENTS", 1)
    rows = [(k, f"line {k % 50}\nonly {k}") for k in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert -(-ld.line_count(docs) // ld.SEGMENT) == 100
    for send in (ld.SEND_BYTES, -1):
        assert sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.kept_sha256) for r in ld.line_digests(docs, send_bytes=send).collect()) == slow(rows)


@pytest.mark.parametrize("send", [ld.SEND_BYTES, -1])
def test_first_occurrences_may_stay(spark, send):
    rows = [(k, f"Shared\nown {k}\nshared \nodd {k % 2}") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.text for r in ld.without_shared_lines(docs, keep_first=True, send_bytes=send).collect()}
    assert got == {k: "Shared\nown 0\nodd 0" if k == 0 else "own 1\nodd 1" if k == 1 else f"own {k}" for k in range(40)}


@pytest.mark.parametrize("send", [ld.SEND_BYTES, -1])
def test_rows_and_columns_stay(odd_docs, send):
    odd_docs = odd_docs.withColumnRenamed("fp", "place").withColumnRenamed("label", "gone")
    kept = ld.without_shared_lines(odd_docs, send_bytes=send)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()
    by = {r.doc_id: r for r in kept.collect()}
    assert by[100].text == " doc 0\nmore".replace("\nmore", "") and by[100].n_chars == len(by[100].text)
    assert by[0].text is None
