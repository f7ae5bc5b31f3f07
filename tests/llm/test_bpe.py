import hashlib
import random

import pytest
from tokenizers import Tokenizer

from lectern.llm import bpe
from lectern.llm.queries import BYTE_BPE


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTE_BPE)


def test_ids_and_texts_equal_the_library(library):
    rnd = random.Random(3)
    texts = ["", "a" * 3000, "ab" * 500, "aaa aaaa", "<|endoftext|>x<|endoftext|>", "it's 12's", " \n\n  z ", " \x85 "]
    texts += ["".join(rnd.choice("aab eit\n's0!é漢😀") for _ in range(rnd.randint(1, 80))) for _ in range(1500)]
    texts += ["".join(chr(rnd.choice([rnd.randint(1, 0xD7FF), rnd.randint(0xE000, 0x1FFFF)])) for _ in range(40)) for _ in range(150)]
    codec = bpe.codec(BYTE_BPE)
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert codec.encode(text) == want.ids
        assert codec.decode(want.ids) == library.decode(want.ids, skip_special_tokens=False) == text


def test_every_token_encodes_as_itself_and_merges_are_ordered():
    codec = bpe.codec(BYTE_BPE)
    assert all(codec.rank[a] < r and codec.rank[b] < r for (a, b), r in codec.merge.items())
    assert all(codec.encode_bytes(codec.bytes_of[i]) == (i,) for i in range(0, 50256, 7))


def test_digests_of_odd_rows(odd_docs, no_docs, library):
    got = sorted((r.doc_id is None, r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip_digests(odd_docs, BYTE_BPE).collect())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for r in odd_docs.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id is None, r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(r.text or "")))
    assert got == sorted(want)
    assert bpe.round_trip_digests(no_docs, BYTE_BPE).collect() == []


def test_encode_then_decode(odd_docs):
    encoded = bpe.encode_documents(odd_docs, BYTE_BPE)
    assert sorted(r.text for r in bpe.decode_ids(encoded, BYTE_BPE).collect()) == sorted(r.text or "" for r in odd_docs.collect())


def test_memo_forgets_but_never_lies():
    memo = bpe.Remembered(lambda x: x * 2, 10)
    assert all(memo[k % 37] == 2 * (k % 37) for k in range(500))
    assert len(memo) <= 10


def test_long_pieces_are_not_remembered():
    memo = bpe.Remembered(len, 4, bpe.LONG)
    assert memo["x" * 1000] == 1000 and not memo
    for k in range(9):
        assert memo["y" * k] == k
    assert len(memo) + len(memo.old) <= 4
