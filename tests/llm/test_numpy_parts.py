"""The numpy parts against brute force: tokens, packing, pointers, gradients, alignment."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sievework.llm import arrow_text, gru_lm, jaccard_join, license_scan, packing, quality_cnn, shingles, suffix_dedup, tokenise

TEXTS = ["", "  ", "a b", "It's I'LL  x y", "é ́z  9 12 a1b2", "ẞİ ΣΣ", "x\x1cy\x85z", "a<|endoftext|>b c", "\U0001f600 ab​c", " \n\t\x0b\x0c\r lead", "The the. THE, the!!", "Été ÀÉÎõÜßÞÿ×÷ naïve. café!a a!b --x É", "<|ENDOFTEXT|> don't E.G. (x) 3rd"]


def laid(texts):
    return arrow_text.utf8(pa.array(texts, pa.string()))


def test_slices_cover_all_rows():
    batch = pa.record_batch([pa.array(["abc", None, "", "x" * 50, "d"])], names=["text"])
    parts = [(rows.num_rows, bytes(data), ends.tolist()) for rows, data, ends in arrow_text.slices([batch, batch.slice(0, 0), batch.slice(2)], "text", 10)]
    assert sum(p[0] for p in parts) == 8 and b"".join(p[1] for p in parts) == b"abc" + b"x" * 50 + b"d" + b"x" * 50 + b"d"
    assert all(p[2][-1] == len(p[1]) for p in parts)


def test_word_encoder_is_the_tokenizer():
    from tokenizers import Tokenizer

    vocabulary = tokenise.tokenizer_file()
    whole, encoder = Tokenizer.from_str(vocabulary), tokenise.WordEncoder(vocabulary, 2, limit=5)
    for texts in (TEXTS, TEXTS[::-1], [None, "a"]):
        ids, ends = encoder.encode(*laid(texts))
        for i, text in enumerate(texts):
            assert list(ids[ends[i] : ends[i + 1]]) == [*whole.encode(text or "", add_special_tokens=False).ids, 2]


def test_shingle_sets():
    data, ends = laid(["A b c d e f", "a B C D E", "f a b", "F A B", "", None, "a b c d e f a b c d e"])
    sets, at = shingles.shingle_sets(data, ends)
    own = [set(sets[a:b].tolist()) for a, b in zip(at[:-1], at[1:], strict=True)]
    assert [len(x) for x in own] == [2, 1, 1, 1, 0, 0, 6]
    assert own[1] < own[0] and own[2] == own[3] and own[1] < own[6] and not own[2] & own[0]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 300), max_size=40), st.sampled_from([16, 64, 100]))
def test_packing_round_trip(counts, window):
    counts = np.array(counts, np.int64)
    found = packing.pack_group(counts, window)
    covered, filled = {}, {}
    for t, s, n, q, o in zip(*(found[k].tolist() for k in ("text", "start", "length", "sequence", "offset")), strict=True):
        assert s == covered.get(t, 0) and n > 0
        covered[t] = s + n
        filled.setdefault(q, []).append((o, n))
    assert covered == {i: c for i, c in enumerate(counts.tolist())}
    for parts in filled.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= window and (at >= packing.FULL * window or at & (at - 1) == 0)


def test_best_fit_takes_the_tightest_window():
    place, offset, used = packing.best_fit(np.array([6, 7, 3, 4]), 10)
    assert used == 2 and place.tolist() == [1, 0, 0, 1] and offset.tolist() == [0, 0, 7, 6]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=40), st.sampled_from([50, 64]))
def test_best_fit_is_the_naive_one(sizes, window):
    """Each piece, largest first, goes into the open window with the least room that holds it."""
    place, offset, used = packing.best_fit(np.array(sizes, np.int64), window)
    room: list[int] = []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        fits = [r for r in room if r >= sizes[i]]
        if int(place[i]) == len(room):
            assert not fits
            room.append(window)
        assert room[place[i]] == min(fits, default=window) and offset[i] == window - room[place[i]]
        room[place[i]] -= sizes[i]
    assert used == len(room)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text("ab", max_size=60), max_size=5), st.integers(1, 30))
def test_bucket_pointers(texts, length):
    data, ends = laid(texts)
    pointer = suffix_dedup.bucket_pointers(data, np.repeat(ends[1:], np.diff(ends)), length)
    strings = {}
    for i, text in enumerate(texts):
        for k in range(len(text)):
            p = pointer[ends[i] + k]
            if k + length <= len(text):
                strings.setdefault(int(p), set()).add(text[k : k + length])
            else:
                assert p == -1
    assert all(len(x) == 1 for x in strings.values()) and len({next(iter(x)) for x in strings.values()}) == len(strings)


def test_equal_strings_have_equal_anchors():
    rng = np.random.default_rng(5)
    passage = "".join(rng.choice(list("abcdefgh "), 400))
    texts = ["".join(rng.choice(list("abcdefgh "), n)) + passage + "".join(rng.choice(list("abcdefgh "), m)) for n, m in ((30, 500), (777, 0), (0, 12))] + ["", "ab" * 400, "x"]
    data, ends = laid(texts)
    text, place, anchor, _ = suffix_dedup.segments(data, ends, 200)
    of, strings = {}, {}
    for t, p, a in zip(text.tolist(), place.tolist(), anchor.tolist(), strict=True):
        for start in range(p >> 14, (p >> 14) + (p & 8191)):
            of.setdefault(texts[t][start : start + 200], set()).add(a)
            strings[t, start] = a
    assert all(len(x) == 1 for x in of.values()) and len(strings) == sum(max(len(t) - 199, 0) for t in texts)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.sets(st.integers(1, 40), min_size=1, max_size=25), min_size=2, max_size=6), st.integers(0, 10))
def test_prefixes_lose_no_pair(found, hot):
    sets = [np.array(sorted(x), np.uint64) for x in found]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    frequent, counts = np.arange(1, hot + 1, dtype=np.uint64), np.arange(9, 9 + hot)
    prefix = {i: (m, set(p.tolist())) for i, m, p in jaccard_join.prefixes(np.concatenate(sets), offsets, 75, frequent, counts)}
    for i, a in enumerate(found):
        for j, b in enumerate(found[:i]):
            if 100 * len(a & b) >= 75 * len(a | b):
                assert len(prefix[i][1] & prefix[j][1]) >= min(prefix[i][0], prefix[j][0])


def numeric(loss, array, at, step=1e-2):
    old = array[at]
    array[at] = old + step
    up = loss()
    array[at] = old - step
    down = loss()
    array[at] = old
    return (up - down) / (2 * step)


def test_network_gradients():
    model = quality_cnn.fresh_model(2)
    data, ends = laid(["hello there general", "x" * 700, "some words, more words. " * 30])
    truth = np.array([1, 0, 1], np.float32)
    grads = quality_cnn._gradients(model, data, ends, truth)

    def loss():
        p = quality_cnn.score_texts(model, data, ends)
        return -(truth * np.log(p) + (1 - truth) * np.log(1 - p)).mean()

    for name, at in (("dense", (3, 2)), ("out", (4,)), ("out_shift", (0,)), ("dense_shift", (1,))):
        assert grads[name][at] == pytest.approx(numeric(loss, model[name], at), rel=0.05, abs=2e-4)


def test_language_model_gradients_and_probabilities():
    texts = ["the cat sat on the mat " * 6, "a dog ran to the cat " * 9, "the the the"] * 3
    words, kinds, at = gru_lm.tokens(*laid(texts))
    value, first, times = np.unique(words, return_index=True, return_counts=True)
    order = np.argsort(-times, kind="stable")
    vocabulary = gru_lm.Vocabulary(value[order], kinds[first][order], times[order], np.bincount(kinds[first], times, gru_lm.TAIL_CLASSES).astype(int), np.bincount(kinds[first], minlength=gru_lm.TAIL_CLASSES))
    ids, counts = vocabulary.place(words, kinds)
    assert (counts > 0).all() and vocabulary.train_tokens == len(words)
    model = gru_lm.fresh_model(vocabulary)
    states = np.random.default_rng(1).standard_normal((5, gru_lm.HIDDEN)).astype(np.float32)
    total = np.zeros(5)
    for c in range(gru_lm.HEAD_CLASSES):
        for w in range(vocabulary.bounds[c], vocabulary.bounds[c + 1]):
            total += np.exp(gru_lm._log_likelihoods(model, vocabulary, states, np.full(5, w))[0])
    for k in range(gru_lm.TAIL_CLASSES):
        total += np.exp(gru_lm._log_likelihoods(model, vocabulary, states, np.full(5, gru_lm.HEAD + k))[0])
    used = np.unique(vocabulary.word_class)
    logits = states @ model["class"] + model["class_shift"]
    shares = np.exp(logits) / np.exp(logits).sum(axis=1, keepdims=True)
    empty = [c for c in range(gru_lm.HEAD_CLASSES) if c not in used]
    assert total + shares[:, empty].sum(axis=1) == pytest.approx(np.ones(5), abs=1e-4)
    before = gru_lm.score_tokens(model, vocabulary, ids, at).sum()
    trainer = gru_lm.Trainer(model, vocabulary, 0.01)
    for k in range(20):
        trainer.learn(ids, at, k)
    assert gru_lm.score_tokens(trainer.model, vocabulary, ids, at).sum() > before + 50
    copy = gru_lm.unpack_model(gru_lm.pack_model(model), model)
    assert all((copy[k] == model[k]).all() for k in model)


def test_head_grows_with_distinct_words():
    n = 3 * gru_lm.HEAD * gru_lm.PER_HEAD
    words, counts = np.arange(n, dtype=np.uint64) * np.uint64(7919), np.full(n, 5)
    kinds = np.arange(n) % gru_lm.TAIL_CLASSES
    vocabulary = gru_lm.Vocabulary(words, kinds, counts, np.bincount(kinds, counts).astype(int), np.bincount(kinds))
    head = 3 * gru_lm.HEAD
    ids, _ = vocabulary.place(words, kinds)
    assert vocabulary.head == head and (ids[:head] == np.arange(head)).all() and (ids[head:] == vocabulary.room + kinds[head:]).all()
    model = gru_lm.fresh_model(vocabulary)
    states = np.random.default_rng(1).standard_normal((1, gru_lm.HIDDEN)).astype(np.float32)
    every = np.concatenate([np.arange(head), vocabulary.room + np.arange(gru_lm.TAIL_CLASSES)])
    found = np.exp(gru_lm._log_likelihoods(model, vocabulary, np.repeat(states, len(every), axis=0), every)[0])
    assert found.sum() == pytest.approx(1, abs=1e-3) and len(model["embed"]) == vocabulary.room + gru_lm.TAIL_CLASSES


def small_language(texts):
    words, kinds, at = gru_lm.tokens(*laid(texts))
    value, first, times = np.unique(words, return_index=True, return_counts=True)
    order = np.argsort(-times, kind="stable")
    vocabulary = gru_lm.Vocabulary(value[order], kinds[first][order], times[order], np.bincount(kinds[first], times, gru_lm.TAIL_CLASSES).astype(int), np.bincount(kinds[first], minlength=gru_lm.TAIL_CLASSES))
    ids, _ = vocabulary.place(words, kinds)
    return vocabulary, gru_lm.fresh_model(vocabulary), ids, at


def slow_score(model, vocabulary, ids):
    """ln of a text's classes and head words, a token at a time in double precision."""
    m = {k: v.astype(float) for k, v in model.items()}
    h, total, state = gru_lm.HIDDEN, 0.0, np.zeros(gru_lm.HIDDEN)
    for i in ids.tolist():
        kind = int(vocabulary.class_of[i])
        logits = state @ m["class"] + m["class_shift"]
        total += logits[kind] - np.log(np.exp(logits).sum())
        if i < vocabulary.head:
            own = np.flatnonzero(vocabulary.word_class == kind)
            logits = m["word"][own] @ state + m["word_shift"][own]
            total += logits[i - own[0]] - np.log(np.exp(logits).sum())
        x, y = m["embed"][i] @ m["input"] + m["shift"], state @ m["recur"]
        z, r = (1 / (1 + np.exp(-x[k * h : k * h + h] - y[k * h : k * h + h])) for k in (0, 1))
        state = (1 - z) * state + z * np.tanh(x[2 * h :] + r * y[2 * h :])
    return total


@pytest.mark.parametrize("streams", [2, 512])
def test_scores_are_those_of_a_slow_network(monkeypatch, streams):
    """Texts share streams and windows, long ones go through many; each is scored from its start to its end."""
    monkeypatch.setattr(gru_lm, "STREAMS", streams)
    texts = ["the cat sat on the mat and then " * 40, "a dog", "", "the dog and the cat ran " * 9, None, "sat " * 70, "mat"] * 2
    vocabulary, model, ids, at = small_language(["the cat sat on the mat and then a dog ran " * 5] + texts)
    trainer = gru_lm.Trainer(model, vocabulary, 0.01)
    trainer.learn(ids, at)
    found = gru_lm.score_tokens(trainer.model, vocabulary, ids, at)
    expected = [slow_score(trainer.model, vocabulary, ids[a:b]) / np.log(10) for a, b in zip(at[:-1], at[1:], strict=True)]
    assert found == pytest.approx(np.array(expected), rel=1e-4)


@pytest.mark.parametrize("streams", [1, 512])
def test_language_model_gradients(monkeypatch, streams):
    """Of every array, against differences, with texts that share a stream and texts of unequal length."""
    monkeypatch.setattr(gru_lm, "STREAMS", streams)
    texts = ["the cat sat", "a dog ran to the cat", "", "the the"] if streams > 1 else ["the cat sat", "a dog ran", "the the"]
    vocabulary, model, ids, at = small_language(["the the the cat cat dog dog ran sat a to " * 6])
    words, kinds, at = gru_lm.tokens(*laid(texts))
    ids, _ = vocabulary.place(words, kinds)
    caught = {}

    def keep(self, words, by_word, n):
        caught.update({k: v.copy() for k, v in self.grads.items()})
        caught["embed"] = np.zeros_like(model["embed"])
        caught["embed"][words] = by_word

    monkeypatch.setattr(gru_lm.Trainer, "_adam", keep)
    gru_lm.Trainer(model, vocabulary, 0.01).learn(ids, at)
    loss = lambda: -gru_lm.score_tokens(model, vocabulary, ids, at).sum() * np.log(10)
    rng = np.random.default_rng(4)
    for name, grad in caught.items():
        largest = np.argsort(-np.abs(grad), axis=None)[:6].tolist() + rng.integers(0, grad.size, 4).tolist()
        for place in largest:
            where = np.unravel_index(place, grad.shape)
            assert grad[where] == pytest.approx(numeric(loss, model[name], where), rel=0.05, abs=5e-3), (name, where)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 70), min_size=1, max_size=30), st.integers(1, 9), st.sampled_from([None, 3]))
def test_windows_hold_each_token_once(sizes, streams, seed):
    ends = np.concatenate([[0], np.cumsum(sizes)])
    old, gru_lm.STREAMS = gru_lm.STREAMS, streams
    try:
        windows = list(gru_lm._windows(ends, 4, seed))
    finally:
        gru_lm.STREAMS = old
    assert sorted(np.concatenate([at[mask] for at, mask, _ in windows]).tolist()) == list(range(int(ends[-1])))
    for k in range(streams):
        run = [(a, b) for at, mask, begins in windows if k < at.shape[1] for a, m, b in zip(at[:, k].tolist(), mask[:, k], begins[:, k], strict=True) if m]
        assert all(b == (a in ends) for a, b in run) and all(b or a == run[i][0] + 1 for i, (a, b) in enumerate(run[1:]))


def test_listed_words_are_found():
    rng = np.random.default_rng(6)
    words = rng.integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2)
    words = np.unique(np.concatenate([words, words[:9] >> np.uint64(40), np.arange(50, dtype=np.uint64)]))
    vocabulary = gru_lm.Vocabulary(words, np.zeros(len(words), int), np.arange(len(words))[::-1] + 1, np.full(gru_lm.TAIL_CLASSES, 1 << 30), np.full(gru_lm.TAIL_CLASSES, 1 << 20))
    assert (vocabulary.find(words) == np.arange(len(words))).all() and (vocabulary.find(words + np.uint64(1))[50:] == -1).all()
    none = gru_lm.Vocabulary(words[:0], np.zeros(0, int), np.zeros(0, int), np.zeros(gru_lm.TAIL_CLASSES, int), np.zeros(gru_lm.TAIL_CLASSES, int))
    assert (none.find(words) == -1).all() and (none.place(words[:3], np.zeros(3, int))[1] == -1).all()


def test_word_hashes_go_by_lowered_bytes():
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abAB"), n)) for n in [*range(1, 40), 1023, 1024, 1025, 1033, 3000]] * 2 + ["é" * 700, "a" * 1032 + "b", "a" * 1032 + "c"]
    data, ends = laid([" ".join(words)])
    found = shingles.word_hashes(data, ends)[0].tolist()
    assert len(set(zip(found, [w.lower() for w in words], strict=True))) == len(set(found)) == len({w.lower() for w in words})


def test_alignment_counts_matches():
    words = lambda s: np.array([hash(w) & 0xFFFF for w in s.split()], np.uint64)
    pairs = license_scan.align(words("a b c d e"), words("x a b z c d e y"), 1, 3)
    assert [j for _, j in pairs] == [1, 2, 4, 5, 6]
