"""Pages of one template, almost alike but not linked: no pair of them is made, and the links among them are found."""

from __future__ import annotations

import random

import pytest

from sievework.llm import jaccard_join


def shingles(text: str) -> frozenset:
    words = text.lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def components_slowly(texts: dict[int, str]) -> dict[int, int]:
    sets, parent = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(texts)
    for a in ids:
        for b in ids:
            if a < b:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((find(a), find(b)))
                    parent[y] = x
    return {i: find(i) for i in ids}


def pages(seed: int, n: int, shared: int, own: int, spread: int) -> dict[int, str]:
    """Pages with ``shared`` words of a template and about ``own`` of their own, some of them edited copies of a page or of a part of it."""
    rng = random.Random(seed)
    template = [f"t{rng.randrange(900)}" for _ in range(shared)]
    out = {}
    for i in range(n):
        if i % 9 == 8:
            words = out[rng.randrange(i)].split()
            for _ in range(rng.randrange(6)):
                words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
            words = words[rng.randrange(12) :]
        else:
            words = template + [f"u{rng.randrange(10**6)}" for _ in range(own + rng.randrange(spread + 1))]
        out[i] = " ".join(words)
    return out


@pytest.mark.parametrize("shared,own,spread", [(150, 27, 0), (120, 15, 14), (60, 6, 30), (40, 40, 5)])
def test_templates(spark, monkeypatch, shared, own, spread):
    monkeypatch.setattr(jaccard_join, "COSTLY", 3)
    texts = pages(shared, 260, shared, own, spread)
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    found = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(frame).collect()}
    assert found == components_slowly(texts)


def test_template_pages_make_no_pairs(spark, monkeypatch):
    """The template's shingles are in nobody's short prefix, so nothing is left to compare by family."""
    def fail(*_):
        raise AssertionError("compared by family")

    monkeypatch.setattr(jaccard_join, "_families", fail)
    rng = random.Random(5)
    template = [f"t{rng.randrange(900)}" for _ in range(400)]
    texts = {i: " ".join(template + [f"u{rng.randrange(10**6)}" for _ in range(72)]) for i in range(1500)}
    found = jaccard_join.jaccard_components(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)).collect()
    assert all(r.component_id == r.doc_id for r in found) and len(found) == 1500
