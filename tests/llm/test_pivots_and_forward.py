"""Pivots and rings of the metric join as shipped, a slow pass of the quality network, and columns with clashing names."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.llm import metric_join, quality_cnn, suffix_dedup


def clustered(seed: int, n: int, dims: int, spread: float) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 6, dims))
    return centres[rng.integers(0, len(centres), n)] + rng.normal(size=(n, dims)) * spread


def linked_slowly(rows, least=0.98):
    """{id: (links, component)} by all pairs."""
    out, parent = {}, {i: i for i, _, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for group in {g for _, _, g in rows}:
        own = [(i, v) for i, v, g in rows if g == group]
        unit = np.array([v for _, v in own])
        unit /= np.sqrt((unit**2).sum(axis=1, keepdims=True))
        near = unit @ unit.T >= least
        for a, row in enumerate(near):
            out[own[a][0]] = int(row.sum()) - 1
            for b in np.flatnonzero(row[:a]):
                x, y = sorted((find(own[a][0]), find(own[b][0])))
                parent[y] = x
    return {i: (n, find(i)) for i, n in out.items()}


@pytest.mark.parametrize("dims,chunk,cell", [(4, None, None), (24, None, None), (3, 20, 150)])
def test_links_through_pivots(spark, monkeypatch, dims, chunk, cell):
    """With the shipped constants every group has several cells; with small chunks cells have rings."""
    if chunk:
        monkeypatch.setattr(metric_join, "CHUNK", chunk)
        monkeypatch.setattr(metric_join, "CELL", cell)
    rows = [(i, v.tolist(), i % 2) for i, v in enumerate(clustered(dims, 700, dims, 0.08))] + [(900 + i, v.tolist(), 2) for i, v in enumerate(clustered(9, 60, dims, 0.05))]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found = {r.vec_id: (r.n_links, r.component_id) for r in metric_join.embedding_links(frame).collect()}
    assert found == linked_slowly(rows) and sum(n for n, _ in found.values()) > 300
    nodes = frame.select(F.concat(F.lit(f"{dims}:"), "label").alias("group"), F.col("vec_id").alias("node"), F.lit(1).cast("long").alias("weight"), F.col("embedding").alias("vector"), F.col("vec_id").alias("h1")).cache()
    pivots = metric_join._pivots(nodes)
    assert {g: len(c) for g, (c, _) in pivots.of.items()} == {f"{dims}:0": metric_join.FEWEST, f"{dims}:1": metric_join.FEWEST}
    wide = nodes.select("group", "node", "weight", "vector")
    for r in wide.mapInArrow(lambda it: metric_join._radii(it, pivots), "cell bigint, radius double").groupBy("cell").agg(F.max("radius").alias("radius")).collect():
        pivots.radius[r.cell] = r.radius
    cells = metric_join._cells(wide, pivots, 0.2).where("not looked")
    assert cells.select("group", "cell").distinct().count() == 2 * metric_join.FEWEST + 1
    if chunk:
        assert cells.count() < 0.7 * 700 * 350 / chunk  # of what passes every chunk of its group
    nodes.unpersist()


def test_pivots_are_shared_out():
    assert metric_join._shares({"a": 128, "b": 10**6}) == {"a": 4, "b": 976}
    many = metric_join._shares({str(i): 10**7 for i in range(50)})
    assert sum(many.values()) <= metric_join.PIVOTS and min(many.values()) > 70


def scored_slowly(model, text: bytes) -> float:
    """The network step by step: embedded windows of 8 bytes, maxima by chunk, mean and maximum over chunks, dense layer."""
    blocks = -(-(len(text) + 2 * quality_cnn.STRIDE) // quality_cnn.BLOCK)
    laid = bytes(quality_cnn.STRIDE) + text
    laid += bytes(blocks * quality_cnn.BLOCK + quality_cnn.STRIDE - len(laid))
    window = 2 * quality_cnn.STRIDE
    steps = []
    for s in range(blocks * quality_cnn.BLOCK // quality_cnn.STRIDE):
        seen = [x for byte in laid[s * quality_cnn.STRIDE :][:window] for x in model["embed"][byte]]
        steps.append([sum(float(a) * float(w) for a, w in zip(seen, model["filters"][:, f], strict=True)) for f in range(quality_cnn.FILTERS)])
    per, chunks = quality_cnn.BLOCK // quality_cnn.STRIDE, []
    start = 0
    while True:
        stop = min(start + quality_cnn.CHUNK, blocks)
        own = steps[start * per : stop * per]
        chunks.append([max(0.0, max(r[f] for r in own) + float(model["shift"][f])) for f in range(quality_cnn.FILTERS)])
        if stop == blocks:
            break
        start += quality_cnn.CHUNK - 1
    features = [sum(c[f] for c in chunks) / len(chunks) for f in range(quality_cnn.FILTERS)] + [max(c[f] for c in chunks) for f in range(quality_cnn.FILTERS)] + [math.log2(1 + len(text)) / 8]
    hidden = [math.tanh(sum(x * float(w) for x, w in zip(features, model["dense"][:, h], strict=True)) + float(model["dense_shift"][h])) for h in range(quality_cnn.HIDDEN)]
    return 1 / (1 + math.exp(-sum(h * float(w) for h, w in zip(hidden, model["out"], strict=True)) - float(model["out_shift"][0])))


def test_quality_is_a_slow_forward_pass(spark):
    rng = np.random.default_rng(3)
    texts = ["", "a", "abcdefgh", "short words here.", "é" * 60, " ".join(rng.choice(["lorem", "ipsum", "dolor"], 300)), "x" * 449, "y" * 512, "tail " * 200]
    model = quality_cnn.fresh_model(5)
    model["shift"] = rng.normal(size=quality_cnn.FILTERS).astype(np.float32)
    found = quality_cnn.score(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), model).collect()
    for r in found:
        assert r.score == pytest.approx(scored_slowly(model, texts[r.doc_id].encode()), abs=2e-5)


def test_all_gradients_of_the_quality_network():
    single = quality_cnn.fresh_model(7)
    model = {k: v.astype(np.float64) for k, v in single.items()}
    texts = [b"hello there general of the guard", b"x" * 700 + b"yz" * 40, b"some words, more words. " * 30]
    data, ends = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    truth = np.array([1.0, 0.0, 1.0])
    grads = quality_cnn._gradients(single, data, ends, truth.astype(np.float32))

    def loss():
        p = np.array([scored_slowly(model, t) for t in texts])
        return -(truth * np.log(p) + (1 - truth) * np.log(1 - p)).mean()

    assert grads.keys() == model.keys()
    for name, grad in grads.items():
        at = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        old, step = model[name][at], 1e-4
        model[name][at] = old + step
        up = loss()
        model[name][at] = old - step
        down = loss()
        model[name][at] = old
        assert grad[at] == pytest.approx((up - down) / (2 * step), rel=0.02, abs=1e-5), name


def test_columns_of_any_name(spark):
    frame = spark.createDataFrame([(1, "some text " * 40, "a", 2, "z", 0.5), (2, None, "b", 3, "y", 1.5)], "doc_id long, text string, __text string, c0 int, __ranges string, `a.b` double")
    scored = quality_cnn.score(frame, quality_cnn.fresh_model(1))
    assert scored.columns == [*frame.columns, "score"]
    assert sorted(tuple(r)[:6] for r in scored.collect()) == sorted(map(tuple, frame.collect()))
    cut = suffix_dedup.remove_repeats(frame, keep=["doc_id", "__text", "c0", "__ranges", "a.b"])
    assert sorted((r.doc_id, r["__text"], r.c0, r["__ranges"], r["a.b"]) for r in cut.collect()) == [(1, "a", 2, "z", 0.5), (2, "b", 3, "y", 1.5)]


@pytest.mark.parametrize("tasks", [1, 5, 40, 300])
def test_replicas_average_in_a_tree(spark, monkeypatch, tasks):
    from sievework.llm import gru_lm

    monkeypatch.setattr(gru_lm, "WIDTH", 4)
    replica = lambda i: np.array([i, -i, 1.0], np.float32).tobytes()
    rows = [(1.0 + i % 3, replica(i)) for i in range(60)]
    (merged,) = gru_lm._averaged(spark.createDataFrame(rows, "weight double, model binary").repartition(tasks))
    total = sum(w for w, _ in rows)
    mean = sum(w * i for i, (w, _) in enumerate(rows)) / total
    assert merged.weight == total and np.allclose(np.frombuffer(merged.model, np.float32), [mean, -mean, 1.0], rtol=1e-5)
    assert gru_lm._averaged(spark.createDataFrame([], "weight double, model binary")) == []
