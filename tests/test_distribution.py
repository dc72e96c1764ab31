"""Distribution metrics against all pairs and numpy."""

from __future__ import annotations

import math

import numpy as np
import pytest

from sievework.operators import distribution as ds


def frame(spark, points, first=0):
    return spark.createDataFrame([(first + i, p.tolist()) for i, p in enumerate(points)], "id long, vector array<double>")


def pairs(a, b):
    return np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2))


def slow_metrics(g, r, k):
    rr, gg, gr = pairs(r, r), pairs(g, g), pairs(g, r)
    np.fill_diagonal(rr, np.inf)
    np.fill_diagonal(gg, np.inf)
    rad, rad_g = np.sort(rr, axis=1)[:, k - 1], np.sort(gg, axis=1)[:, k - 1]
    cut = np.minimum(rad, np.median(rad))
    inside = gr <= rad
    clipped = lambda x: np.minimum(1, x / k).mean()
    nearest = gr.argmin(axis=1)
    return {
        "precision": inside.any(axis=1).mean(), "recall": (gr.T <= rad_g).any(axis=1).mean(), "density": inside.sum() / (k * len(g)), "coverage": inside.any(axis=0).mean(),
        "clipped_density": clipped((gr <= cut).sum(axis=1)) / clipped((rr <= cut).sum(axis=1)), "clipped_coverage": clipped(inside.sum(axis=0)),
        "authenticity": (gr.min(axis=1) > rr.min(axis=1)[nearest]).mean(),
    }


@pytest.fixture(scope="module")
def clouds():
    rng = np.random.default_rng(3)
    real = np.vstack([rng.normal(size=(150, 5)), rng.normal(size=(90, 5)) * 0.3 + 4])
    made = np.vstack([rng.normal(size=(80, 5)) + 0.4, rng.normal(size=(60, 5)) * 0.4 + 4.2, real[:10], real[:5] * 9])
    return made, real


@pytest.mark.parametrize("cell,chunk", [(256, 2048), (10, 7)])
def test_neighbours_are_all_pairs(spark, monkeypatch, clouds, cell, chunk):
    monkeypatch.setattr(ds, "CELL", cell)
    monkeypatch.setattr(ds, "CHUNK", chunk)
    made, real = clouds
    found = ds.neighbour_metrics(frame(spark, made, 1000), frame(spark, real), 4).first().asDict()
    expected = slow_metrics(made, real, 4)
    assert found.keys() == expected.keys() and all(abs(found[n] - expected[n]) < 1e-12 for n in expected)
    held = ds.cells(frame(spark, real).selectExpr("id", "vector", "cast(null as double) as ball"))
    for others in (False, True):
        near = {r.id: [(x.distance, x.id) for x in r.near] for r in ds.nearest(frame(spark, real), held, 3, others=others).collect()}
        for i, row in enumerate(pairs(real, real)):
            order = sorted((x, j) for j, x in enumerate(row) if not (others and i == j))[:3]
            assert [j for _, j in near[i]] == [j for _, j in order] and np.allclose([x for x, _ in near[i]], [x for x, _ in order])


def test_few_vectors_have_no_neighbours(spark, clouds):
    made, real = clouds
    assert set(ds.neighbour_metrics(frame(spark, made[:3]), frame(spark, real), 5).first()) == {None}


def test_frechet_is_numpys(spark, clouds):
    made, real = clouds
    a, b = np.cov(made.T, bias=True), np.cov(real.T, bias=True)
    values = np.linalg.eigvals(a @ b)
    expected = ((made.mean(axis=0) - real.mean(axis=0)) ** 2).sum() + np.trace(a) + np.trace(b) - 2 * np.sqrt(np.maximum(values.real, 0)).sum()
    assert abs(ds.frechet(frame(spark, made).repartition(7), frame(spark, real)) - expected) < 1e-6
    far = 1e6
    assert abs(ds.frechet(frame(spark, made + far), frame(spark, real + far)) - expected) < 1e-5
    assert abs(ds.frechet(frame(spark, real), frame(spark, real))) < 1e-9
    assert ds.frechet(frame(spark, real), frame(spark, real).limit(0)) is None


def test_discrepancy_is_within_its_bound(spark, clouds):
    made, real = clouds
    kernel = lambda a, b: np.exp(-pairs(a, b) ** 2 / (2 * 2.0**2)).mean()
    exact = kernel(made, made) + kernel(real, real) - 2 * kernel(made, real)
    for seed in range(3):
        found, bound = ds.kernel_discrepancy(frame(spark, made), frame(spark, real), width=2.0, seed=seed)
        assert abs(found - exact) <= bound and bound == 4 * math.sqrt(math.log(2000) / 4096)
    wide, _ = ds.kernel_discrepancy(frame(spark, made), frame(spark, real), width=2.0, features=60_000)
    assert abs(wide - exact) < 0.02
    assert ds.kernel_discrepancy(frame(spark, made), frame(spark, real).limit(0), width=1.0)[0] is None


def test_a_query_goes_to_a_bin_once(spark, monkeypatch):
    """Where pivots prune nothing, a query moves for each bin of cells, not for each cell."""
    monkeypatch.setattr(ds, "CELL", 10)
    monkeypatch.setattr(ds, "CHUNK", 200)
    points = np.random.default_rng(5).normal(size=(600, 64))
    sent, groups = [], ds._groups

    def counted(*args):
        out = groups(*args)
        sent.append(out.where("asks").count())
        return out

    monkeypatch.setattr(ds, "_groups", counted)
    held = ds.cells(frame(spark, points).selectExpr("id", "vector", "9.0D as ball"))
    found = {r.query: r.n for r in ds.within(frame(spark, points), held).where("query is not null").collect()}
    assert [found.get(i, 0) for i in range(600)] == (pairs(points, points) <= 9.0).sum(axis=1).tolist()
    assert len(points) <= sent[0] <= 8 * len(points)


def test_copies_far_from_the_origin(spark, monkeypatch):
    """Products of matrices lose digits there; what they choose is compared exactly."""
    monkeypatch.setattr(ds, "CHUNK", 50)
    rng = np.random.default_rng(6)
    real = np.repeat(rng.normal(size=(60, 4)), 2, axis=0) + 1e5
    made = real[::3] + np.where(rng.random((40, 1)) < 0.5, 0, 1e-3)
    found = ds.neighbour_metrics(frame(spark, made, 1000), frame(spark, real), 3).first().asDict()
    expected = slow_metrics(made, real, 3)
    assert all(abs(found[n] - expected[n]) < 1e-12 for n in expected)
