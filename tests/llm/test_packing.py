import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from lectern.llm import packing
from lectern.llm.queries import WORD_BPE


def check(rows, max_tokens):
    """Sequences are gapless from 0 and within the capacity; returns pieces by sequence."""
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= max_tokens
    return by


def test_pieces_equal_the_library_and_sequences_hold(odd_docs, no_docs):
    library = Tokenizer.from_file(WORD_BPE)
    rows = packing.pack_documents(odd_docs, WORD_BPE).collect()
    check(rows, 2048)
    want = []
    for r in odd_docs.collect():
        ids = np.array(library.encode(r.text or "", add_special_tokens=False).ids + [0], "<u4")
        want += [(str(r.doc_id), k, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())) for k, a in enumerate(range(0, len(ids), 2048))]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    assert packing.pack_documents(no_docs, WORD_BPE).collect() == []


def test_groups_of_any_size_give_valid_dense_sequences(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = packing.pack_documents(docs, WORD_BPE, group=16).collect()
    by = check(rows, 2048)
    assert sum(r.length for r in rows) / 2048 / len(by) > 0.9
    whole = packing.pack_documents(docs, WORD_BPE).collect()
    assert len(check(whole, 2048)) <= -(-sum(r.length for r in whole) // 2048) + 1


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_capacity_holds(rule):
    lengths = np.random.default_rng(1).integers(1, 400, 500)
    bins, offsets, n = packing.best_fit(lengths, 1000, 4, 200_000, rule=rule)
    for b in range(n):
        own = lengths[bins == b]
        assert own.sum() <= 1000 and len(own) <= 4 and (own**2).sum() <= 200_000 and len(own)
        assert sorted(zip(offsets[bins == b], own))[0][0] == 0
    lower = max(lengths.sum() / 1000, len(lengths) / 4, (lengths**2).sum() / 200_000)
    assert n <= 1.25 * lower + 1


def test_capacities_reach_the_operator(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = packing.pack_documents(docs, WORD_BPE, max_docs=2).collect()
    assert max(len(x) for x in check(rows, 2048).values()) <= 2


def test_pieces_that_no_sequence_can_hold(spark):
    for lengths, limits in (([100, 20], (1000, 9, 1000)), ([1001], (1000, 9, 10**7)), ([1], (1000, 0, 1000))):
        with pytest.raises(ValueError, match="can hold"):
            packing.best_fit(np.array(lengths), *limits)
    docs = spark.createDataFrame([(1, "some words " * 200), (2, "few words")], "doc_id long, text string")
    rows = packing.pack_documents(docs, WORD_BPE, max_cost=1000).collect()
    cost = defaultdict(int)
    for r in rows:
        cost[r.sequence_id] += r.length**2
    assert max(cost.values()) <= 1000 and max(r.length for r in rows) == 31
    check(rows, 2048)


def test_equal_rows_spread_over_all_groups(spark):
    docs = spark.createDataFrame([(None, "")] * 3000 + [(5, "same text")] * 3000, "doc_id long, text string").repartition(4)
    pieces = packing.cut_documents(docs, WORD_BPE)
    rows = packing.pack_pieces(packing.checkpointed(pieces), group=500).collect()
    check(rows, 2048)
    tasks = defaultdict(int)
    for r in rows:
        tasks[r.sequence_id >> 35] += 1
    assert len(rows) == 6000 and len(tasks) == 12 and max(tasks.values()) < 600
