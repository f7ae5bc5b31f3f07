import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
from lectern.llm import quality_model, quality_rules, queries
from lectern.llm.common import table
from tokenizers import Tokenizer

from . import slow
from .test_simhash import components, slow_fingerprint


def test_stages_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents")
    folded, bias = quality_model.fit(docs, table(spark, sf, "labels"))  # held against brute force in test_classifiers
    common = {lang: words.split() for lang, words in quality_rules.COMMON.items()}
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    refs = slow.references([t for _, t in rows], common, quality_rules.UNITS)
    rows = [(i, t) for i, t in rows if slow.kept(t, refs, common, quality_rules.CLASS_LIMIT, quality_rules.WORD_LIMIT)]
    rows = [(i, t) for i, t in rows if slow.score(t.encode(), folded, bias) >= 0.3]
    key = lambda line: re.sub("^[\x20\x09-\x0d]+|[\x20\x09-\x0d]+$", "", line).encode().lower()
    df = Counter(k for _, t in rows for k in {key(x) for x in t.split("\n")} if k)
    rows = [(i, "\n".join(x for x in t.split("\n") if df[key(x)] < 10)) for i, t in rows]
    of = components(slow_fingerprint(t) for _, t in rows)
    first: dict = {}
    for i, t in rows:
        c = of[slow_fingerprint(t)]
        first[c] = min(first.get(c, i), i)
    kept = set(first.values())
    packed = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in packed} == kept and len(kept) > 300
    library = Tokenizer.from_file(queries.WORD_BPE)
    want = []
    for i, t in rows:
        if i in kept:
            ids = np.array(library.encode(t, add_special_tokens=False).ids + [0], "<u4")
            want += [(i, k, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())) for k, a in enumerate(range(0, len(ids), 2048))]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == sorted(want)
    placed = defaultdict(list)
    for r in packed:
        placed[r.sequence_id].append((r.offset, r.length))
    for parts in placed.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 2048
    assert len(placed) <= -(-sum(w[3] for w in want) // 2048) + 1


def test_stages_keep_the_columns_and_take_odd_rows(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        out = docs
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, out, "/root/testdata/sf0.001")
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.dtypes == docs.dtypes
        out.collect()


def test_every_operator_has_one_query():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 14))
    assert set(queries.ORACLES) <= set(queries.QUERIES)
