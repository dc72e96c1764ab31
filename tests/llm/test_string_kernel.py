"""The language classifier against kernels from Python sets, ridge in explicit features, and held-out documents."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import pytest

from sievework.llm import string_kernel as sk
from sievework.llm.arrow_text import utf8

TEXTS = ["", "a", "ab", "the cat sat on the mat", "le chat est ici, là-bas", "die Katze saß auf der Matte", "the the the the", "ça va très bien", "und der Hund", "zzz\x00\x01", "the cat sat on the mat"]


def sets(text: str) -> list[set]:
    raw = text.encode()
    return [{raw[i : i + p] for i in range(len(raw) - p + 1)} for p in sk.ORDERS]


def kernel(a: str, b: str) -> float:
    return sum(len(x & y) / math.sqrt(len(x) * len(y)) if x and y else 0.0 for x, y in zip(sets(a), sets(b), strict=True)) / len(sk.ORDERS)


def explicit(texts: list[str], grams: list) -> np.ndarray:
    place = {g: i for i, g in enumerate(grams)}
    out = np.zeros((len(texts), len(grams)))
    for r, text in enumerate(texts):
        for found in sets(text):
            for g in found & place.keys():
                out[r, place[g]] = 1 / math.sqrt(len(sk.ORDERS) * len(found))
    return out


@pytest.mark.parametrize("cells", [1, 100, 1 << 21])
def test_products_are_the_kernel(monkeypatch, cells):
    monkeypatch.setattr(sk, "CELLS", cells)
    marks = TEXTS[3:7]
    grams = sk.presence(*utf8(pa.array(marks)))
    vocabulary = np.unique(grams.codes)
    right = np.zeros((len(vocabulary), len(marks)))
    right[np.searchsorted(vocabulary, grams.codes), grams.rows] = grams.weights()
    found = sk.products(sk.presence(*utf8(pa.array(TEXTS))), vocabulary, right)
    assert np.allclose(found, [[kernel(a, b) for b in marks] for a in TEXTS])


def test_a_long_text_goes_by_pieces(monkeypatch):
    text = " ".join(f"word{i % 977} {i * i}" for i in range(3000))
    whole = sk.presence(*utf8(pa.array([text])))
    monkeypatch.setattr(sk, "PIECE", 101)
    parts = sk.presence(*utf8(pa.array([text])))
    assert (whole.codes == parts.codes).all() and (whole.sizes == parts.sizes).all()
    assert [len(s) for s in sets(text)] == whole.sizes[0].tolist()


def test_scores_are_ridge_in_explicit_features():
    rng = np.random.default_rng(2)
    pools = {"en": "the cat dog sat and with mat of".split(), "de": "der die das und Hund Katze nicht ist".split(), "fr": "le la chat est ici très ça du".split()}
    texts, languages = zip(*[(" ".join(rng.choice(pools[k], 12)), k) for k in list(pools) * 14], strict=True)
    model = sk.train(pa.array(texts), languages, landmarks=14, strength=1e-3)
    grams = sorted(set().union(*[s for t in texts for s in sets(t)]))
    x = explicit(list(texts), grams)
    y = np.array([[1.0 if k == name else -1.0 for name in sorted(pools)] for k in languages])
    centred = x - x.mean(axis=0)
    w = centred.T @ np.linalg.solve(centred @ centred.T + 1e-3 * len(y) * np.eye(len(y)), y - y.mean(axis=0))
    asked = TEXTS + ["der Hund ist nicht"]
    expected = (explicit(asked, grams) - x.mean(axis=0)) @ w + y.mean(axis=0)
    assert model.languages == ["de", "en", "fr"]
    assert np.allclose(model.scores(sk.presence(*utf8(pa.array(asked)))), expected, atol=2e-3)


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(4)
    pools = {"en": "the cat dog sat and with mat of".split(), "de": "der die das und Hund Katze nicht ist".split()}
    rows = [(i, " ".join(rng.choice(pools[k], 20)), k) for i in range(80) for k in [["en", "en", "de"][i % 3]]]
    rows += [(100, None, "en"), (101, "", "de"), (102, "123 !? 4", "en"), (None, rows[0][1], "en"), (103, rows[2][1], None), (104, "der die das " * 150_000, "de"), (0, *rows[0][1:]), (105, "é", None)]
    return spark.createDataFrame([(*r, "x", 1, 2.0, "y") for r in rows], "doc_id long, text string, lang string, source string, c0 int, score double, lang_pred string")


def test_edges(spark, docs):
    model = sk.fit(docs, usable=sk.fold("doc_id", 4) != 2, landmarks=5)
    found = sk.predict(docs, model)
    assert found.columns == ["doc_id", "text", "lang", "source", "c0", "lang_pred", "score"]
    rows = found.collect()
    assert len(rows) == 88
    by_id = {r.doc_id: r for r in rows}
    assert all((by_id[i].lang_pred, by_id[i].score) == ("und", 0.0) for i in (100, 101, 102))
    assert by_id[103].lang_pred == "de" and by_id[104].lang_pred == "de" and by_id[105].lang_pred in ("de", "en")
    assert all(r.lang_pred == r.lang for r in rows if r.lang and r.text and len(r.text) > 20) and all(0 <= r.score <= 1 for r in rows)
    none = sk.fit(docs.where("lang = 'xx'"))
    assert {(r.lang_pred, r.score) for r in sk.predict(docs, none, keep=["doc_id"]).collect()} == {("und", 0.0)}
    assert sk.predict(docs.limit(0), model).count() == 0
    one = sk.fit(docs.where("lang = 'de'"))
    assert {r.lang_pred for r in sk.predict(docs, one).where("text like 'd%'").collect()} == {"de"}


def test_held_out_accuracy(spark):
    data = "/root/testdata/sf0.01"
    found = sk.op11_language_id(spark, data).toPandas().merge(spark.read.parquet(f"{data}/documents.parquet").toPandas(), on="doc_id")
    assert len(found) == 1000 and (found.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in found.doc_id]).all()
    held = found[found.held_out & (found.lang_pred != "und")]
    assert (held.lang == held.lang_pred).mean() > 0.95
