"""The pipeline's stages over null, empty, repeated and copied rows, each against a slow version of its own input."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from sievework.llm import quality_cnn
from sievework.llm.tokenise import tokenizer_file

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"{a}{b}{c}" for a in "bdfglmnprst" for b in "aeiou" for c in ("", "n", "rt", "st")]


def prose(seed, n):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


def rows():
    shared = prose(1000, 60)
    out = [(i, prose(i, 60 + i % 40) + (" " + shared if i % 9 == 0 else ""), "en", f"s{i % 3}") for i in range(80)]
    out += [(100 + i, prose(i, 60 + i % 40) + (" " + shared if i % 9 == 0 else "") + " tail", "en", "s1") for i in range(12)]
    out += [(200, prose(5, 65), "de", "s2"), (200, prose(777, 70), "en", "s2"), (None, prose(778, 70), None, None), (None, prose(778, 70) + " x", "en", None), (None, None, "en", "s1")]
    out += [(300, "", "en", "s1"), (300, "", "en", "s1"), (301, None, None, "s0"), (302, "  \n", "en", "s0"), (303, prose(9, 3000), "en", "s0")]
    out += [(400 + i, "!! ## " * 50 + str(i), "en", "s1") for i in range(40)]
    return [(*r, len(r[1]) if r[1] else 0) for r in out]


@pytest.fixture(scope="module")
def place(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    extra = spark.createDataFrame([(*r, 1, "z") for r in rows()], SCHEMA + ", `key` int, score string")
    extra.repartition(4).write.parquet(f"{folder}/documents.parquet")
    labels = [(r[0], int(r[0] < 400)) for r in rows() if r[0] is not None] + [(None, 1), (7, None)]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    return folder


@pytest.fixture(scope="module")
def stages(spark, place, tmp_path_factory):
    """The input of each stage, and the last one's result."""
    folder, docs, out = str(tmp_path_factory.mktemp("stages")), spark.read.parquet(f"{place}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out.append(docs)
        stage(spark, docs, place).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return [*out, docs]


def split(text):
    for c in "\t\n\x0b\x0c\r":
        text = (text or "").replace(c, " ")
    return [w for w in text.split(" ") if w]


def table_of(frame):
    return [tuple(r) for r in frame.select(corpus_pipeline.COLUMNS).collect()]


def test_rejected_documents_go(spark, place, stages):
    model = quality_cnn.quality_model(stages[0], spark.read.parquet(f"{place}/labels.parquet"))
    scored = quality_cnn.score(stages[0].select(corpus_pipeline.COLUMNS), model, out="p").collect()
    assert sorted(map(repr, table_of(stages[1]))) == sorted(repr(tuple(r)[:-1]) for r in scored if r.p >= 0.5)
    kept = {r[0] for r in table_of(stages[1])}
    assert len(kept & set(range(80))) > 76 and len(kept & set(range(400, 440))) < 4


def test_one_document_of_each_group_stays(spark):
    frame = spark.createDataFrame([r for r in rows() if r[0] is None or r[0] < 400], SCHEMA)
    before, after = table_of(frame), table_of(corpus_pipeline.drop_near_copies(spark, frame, ""))
    different = sorted(set(before), key=repr)
    sets = []
    for r in different:
        w = split((r[1] or "").lower())
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    group = list(range(len(sets)))
    for i, x in enumerate(sets):
        for j in range(i):
            if x and 100 * len(x & sets[j]) >= 75 * len(x | sets[j]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    assert Counter(group[different.index(r)] for r in after) == Counter(set(group))
    for r in after:
        ids = [q[0] for q, g in zip(different, group, strict=True) if g == group[different.index(r)]]
        assert r[0] == min((i for i in ids if i is not None), default=None)
    assert {5, 200} <= {r[0] for r in after} and sum(r[0] is None for r in after) == 2


def test_repeats_are_cut(stages):
    texts = [(r[0], (r[1] or "").encode()) for r in table_of(stages[2])]
    strings = Counter(t[k : k + 200] for _, t in texts for k in range(len(t) - 199))
    expected = []
    for i, t in texts:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - 199):
            if strings[t[k : k + 200]] > 1:
                gone[k : k + 200] = True
        if not len(t) or not gone.all():
            expected.append((i, bytes(np.frombuffer(t, np.uint8)[~gone]).decode("utf-8", "ignore")))
    assert sorted(((r[0], r[1]) for r in table_of(stages[3])), key=repr) == sorted(expected, key=repr)
    assert any(len(r[1]) < len(dict(texts)[r[0]]) for r in table_of(stages[3]) if r[0] is not None)


def test_the_mix_takes_its_targets(stages):
    size, taken = Counter(), Counter()
    for r in table_of(stages[3]):
        size[r[3]] += len(split(r[1]))
    for r in table_of(stages[4]):
        taken[r[3]] += len(split(r[1]))
        assert r[4] == len(r[1])
    assert abs(sum(taken.values()) - 1.5 * sum(size.values())) <= len(size) and all(taken[s] <= 2 * size[s] + 1 for s in size)
    before = {r[0]: split(r[1]) for r in table_of(stages[3]) if r[0] is not None}
    assert all(split(r[1]) == before[r[0]][: len(split(r[1]))] for r in table_of(stages[4]) if r[0] is not None)


def test_all_ids_are_packed(stages):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_str(tokenizer_file())
    found: dict = {}
    for r in stages[5].collect():
        found.setdefault((r.doc_id, r.doc_tokens), Counter()).update(np.frombuffer(r.ids, "<u4").tolist())
    expected: dict = {}
    for r in table_of(stages[4]):
        ids = [*whole.encode(r[1] or "", add_special_tokens=False).ids, 2]
        expected.setdefault((r[0], len(ids)), Counter()).update(ids)
    assert found == expected


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
