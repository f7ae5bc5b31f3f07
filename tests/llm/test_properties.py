"""Properties over generated inputs."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import bpe, html_text, lm, packing, quality_rules, simhash
from lectern.llm.queries import BYTE_BPE, WORD_BPE

from .test_quality_rules import slow
from .test_simhash import slow_fingerprint

texts = st.text(st.one_of(st.sampled_from("ab \n\t.,'!0é漢😀Σ<|>endoftxt"), st.characters(exclude_categories=["Cs"])), max_size=80)
fast = settings(max_examples=150, deadline=None)


@fast
@given(texts)
def test_bpe_equals_the_library_and_decodes(text):
    codec, library = bpe.codec(BYTE_BPE), bpe._library(BYTE_BPE)
    ids = codec.encode(text)
    assert ids == library.encode(text, add_special_tokens=False).ids
    assert codec.decode(ids) == text


@fast
@given(texts)
def test_word_ids_equal_the_library(text):
    ids = packing.word_ids(WORD_BPE)
    assert np.frombuffer(ids(text), "<u4").tolist() == ids.library.encode(text, add_special_tokens=False).ids


@fast
@given(texts)
def test_measures_and_fingerprints_equal_brute_force(text):
    assert quality_rules.measures(text.encode(), len(text)) == slow(text)
    assert simhash.fingerprint(text.encode().lower().split()) == slow_fingerprint(text)


@fast
@given(st.text(st.sampled_from("<>/ap =\"'brlitdu\n &;!-"), max_size=200))
def test_any_markup_renders(page):
    out = html_text.visible_text(page)
    assert out == out.rstrip("\n") or "<pre" in page


@fast
@given(st.lists(st.integers(0, (1 << 63) - 1), max_size=300), st.lists(st.integers(0, (1 << 63) - 1), max_size=30))
def test_elias_fano(values, others):
    kept = sorted(set(values))
    level = lm.EliasFano(np.array(kept, np.uint64), (kept[-1] if kept else 0) + 1)
    asked = [x for x in kept + others]
    place = {v: k for k, v in enumerate(kept)}
    assert level.find(np.array(asked, np.uint64)).tolist() == [place.get(x, -1) for x in asked]


@fast
@given(st.lists(st.integers(1, 100), min_size=1, max_size=60), st.integers(1, 8))
def test_bins_hold_their_capacities(lengths, most):
    a = np.array(lengths)
    bins, offsets, n = packing.best_fit(a, 100, most, 100**2)
    for b in range(n):
        own = sorted(zip(offsets[bins == b].tolist(), a[bins == b].tolist()))
        assert len(own) <= most and sum(x for _, x in own) <= 100
        assert [o for o, _ in own] == [sum(x for _, x in own[:k]) for k in range(len(own))]
