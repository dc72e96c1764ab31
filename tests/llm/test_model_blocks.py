"""The language model's products in blocks against plain sums, and the memory that they take."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sievework.llm import gru_lm


def zipf_language(words: int) -> gru_lm.Vocabulary:
    counts = 40_000 // np.arange(1, words + 1) + 5
    kinds = np.arange(words) % gru_lm.TAIL_CLASSES
    return gru_lm.Vocabulary(np.arange(words, dtype=np.uint64) * np.uint64(7919), kinds, counts, 2 * np.bincount(kinds, counts).astype(int), 3 * np.bincount(kinds))


def slow_likelihoods(model, vocabulary, states, ids):
    m = {k: v.astype(float) for k, v in model.items()}
    out = []
    for i, state in zip(ids.tolist(), states.astype(float), strict=True):
        kind = int(vocabulary.class_of[i])
        logits = state @ m["class"] + m["class_shift"]
        found = logits[kind] - np.logaddexp.reduce(logits)
        if i < vocabulary.head:
            own = np.flatnonzero(vocabulary.word_class == kind)
            logits = m["word"][own] @ state + m["word_shift"][own]
            found += logits[i - own[0]] - np.logaddexp.reduce(logits)
        out.append(found)
    return np.array(out)


@pytest.mark.parametrize("scale", [1, 300])
@pytest.mark.parametrize("small, logits", [(1_000_000, 1 << 17), (3000, 64)])
def test_blocks_give_the_likelihoods_and_gradients_of_all_at_once(monkeypatch, scale, small, logits):
    """Also where logits are beyond what exponentials in single precision hold."""
    monkeypatch.setattr(gru_lm, "SMALL", small)
    monkeypatch.setattr(gru_lm, "LOGITS", logits)
    vocabulary = zipf_language(2000)
    model = gru_lm.fresh_model(vocabulary)
    for k in ("class", "word"):
        model[k] *= scale
    rng = np.random.default_rng(5)
    states, ids = np.tanh(rng.standard_normal((700, gru_lm.HIDDEN))).astype(np.float32), np.where(rng.random(700) < 0.7, (rng.random(700) ** 3 * vocabulary.head).astype(int), vocabulary.room + rng.integers(0, gru_lm.TAIL_CLASSES, 700))
    assert gru_lm._output_tables(model)[2] == (scale == 1)
    expected = slow_likelihoods(model, vocabulary, states, ids)
    assert gru_lm._log_likelihoods(model, vocabulary, states, ids)[0] == pytest.approx(expected, rel=1e-4, abs=1e-3)
    grads = {k: np.full_like(model[k], 9) for k in ("class", "class_shift", "word", "word_shift")}
    found, by_state = gru_lm._log_likelihoods(model, vocabulary, states, ids, grads)
    assert found == pytest.approx(expected, rel=1e-4, abs=1e-3)
    if scale > 1:
        return
    loss = lambda m, s: -slow_likelihoods(m, vocabulary, s, ids).sum()
    for k, grad in grads.items():
        for place in np.argsort(-np.abs(grad), axis=None)[:2].tolist():
            up, down = ({**model, k: model[k].astype(float)} for _ in range(2))
            up[k].flat[place] += 1e-3
            down[k].flat[place] -= 1e-3
            assert grad.flat[place] == pytest.approx((loss(up, states) - loss(down, states)) / 2e-3, rel=1e-3), (k, place)
    for i in (0, 699):
        step = np.zeros(states.shape)
        step[i, 3] = 1e-3
        assert by_state[i, 3] == pytest.approx((loss(model, states + step) - loss(model, states - step)) / 2e-3, rel=1e-3, abs=1e-5)


def test_logits_are_never_all_in_memory():
    """Logits of 65,536 tokens' classes alone would take 25 MB."""
    vocabulary = zipf_language(2000)
    model = gru_lm.fresh_model(vocabulary)
    states, ids = np.zeros((1 << 16, gru_lm.HIDDEN), np.float32), np.full(1 << 16, vocabulary.room)
    tracemalloc.start()
    gru_lm._log_likelihoods(model, vocabulary, states, ids)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 25 << 20


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 3000))
def test_blocks_cover_all_places(n, most):
    parts = gru_lm._blocks(n, most)
    assert [i for p in parts for i in range(n)[p]] == list(range(n)) and all(0 < len(range(n)[p]) <= max(most, 1) for p in parts)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=1, max_size=200))
def test_rows_are_summed_by_word(which):
    which = np.array(which, np.uint16)
    rows = np.random.default_rng(1).standard_normal((len(which), 5)).astype(np.float32)
    words, sums = gru_lm._sums(which, rows)
    assert sorted(words.tolist()) == sorted(set(which.tolist()))
    for w, found in zip(words.tolist(), sums, strict=True):
        assert found == pytest.approx(rows[which == w].sum(axis=0), abs=1e-4)
