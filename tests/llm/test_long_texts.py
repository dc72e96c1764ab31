"""A text of some 6 MB through the operators on documents, beside short ones."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from sievework.llm import host_rules, jaccard_join, mixing, packing, quality_cnn, string_kernel, suffix_dedup
from sievework.llm.tokenise import tokenizer_file


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(8)
    letters = np.frombuffer(b"etaoinshrdlucmfwypvbgkjqxz", np.uint8)
    lengths = rng.integers(2, 9, 1_000_000)
    data = letters[np.minimum(rng.geometric(0.12, int(lengths.sum())) - 1, 25)]
    ends = np.cumsum(lengths)
    words = [data[a:b].tobytes().decode() for a, b in zip(ends - lengths, ends, strict=True)]
    long = " ".join(words)
    return {1: long, 2: "before it " + long[3_000_000:3_000_450] + " and behind", 3: "a short text of its own.", 4: None}


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, f"s{i % 2}", "en") for i, t in texts.items()], "doc_id long, text string, source string, lang string").cache()


def test_repeats(docs, texts):
    found = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs).collect()}
    assert found[1].n_bytes == len(texts[1]) and found[3].n_removed == 0
    assert found[1].n_removed == found[2].n_removed >= 450 and [(s.start, s.stop) for s in found[1].spans][0][0] <= 3_000_000


def test_packing(docs, texts):
    pieces = sorted(packing.pack(docs).where("doc_id = 1").select("start", "length", "doc_tokens", "ids").collect(), key=lambda r: r.start)
    assert sum(r.length for r in pieces) == pieces[0].doc_tokens and [r.start for r in pieces] == np.concatenate([[0], np.cumsum([r.length for r in pieces])[:-1]]).tolist()
    whole = np.concatenate([np.frombuffer(r.ids, "<u4") for r in pieces])
    from tokenizers import Tokenizer

    expected = Tokenizer.from_str(tokenizer_file()).encode(texts[1][:200_000], add_special_tokens=False).ids
    assert whole[: len(expected) - 5].tolist() == expected[:-5] and whole[-1] == packing.END


def test_words(docs, texts):
    words = texts[1].split()
    mixed = {r[0]: r.size for r in mixing.mix(docs).collect()}
    assert mixed[1] == len(words) and mixed[4] == 0
    judged = {r[0]: r for r in host_rules.measures(docs).collect()}
    windows = {}
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i : i + 3]), []).append(i)
    again = {i + k for places in windows.values() if len(places) > 1 for i in places for k in range(3)}
    assert (judged[1].n_words, judged[1].n_repeat_words, judged[1].word_chars) == (len(words), len(again), sum(map(len, words)))


def test_shingles(docs, texts):
    words = texts[1].split()
    expected = len({tuple(words[i : i + 5]) for i in range(len(words) - 4)})
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs).collect()}
    assert found[1] == (expected, 1) and found[2][1] == 2 and found[4] == (0, 4)


def test_scores(docs, texts):
    model = quality_cnn.fresh_model(3)
    found = {r.doc_id: r.score for r in quality_cnn.score(docs, model, keep=["doc_id"]).collect()}
    data = np.frombuffer(texts[1].encode(), np.uint8)
    assert found[1] == pytest.approx(float(quality_cnn.score_texts(model, data, np.array([0, len(data)]))[0]), abs=1e-6)
    language = string_kernel.train(pa.array([texts[1][i : i + 500] for i in range(0, 20_000, 500)] + ["der die das und ist nicht ein eine " * 9] * 40), ["en"] * 40 + ["de"] * 40)
    assert {r.doc_id: r.lang_pred for r in string_kernel.predict(docs, language, keep=["doc_id"]).collect()} == {1: "en", 2: "en", 3: "en", 4: "und"}
