"""Alignments against a plain dynamic program, hits against all pairs, clusters against the greedy loop."""

from __future__ import annotations

import random

import pandas as pd
import pytest

from sievework.functions import scales
from sievework.operators import alignment as al


def slow_hit(a: str, b: str) -> tuple:
    """(score, matches, columns, span_a, span_b) of the best local alignment, cell by cell."""
    none = (float("-inf"), 0, 0, 0, 0)
    add = lambda x, *y: tuple(p + q for p, q in zip(x, y, strict=True))
    best = (0, 0, 0, 0, 0)
    h = [[(0, 0, 0, 0, 0)] * (len(b) + 1) for _ in range(len(a) + 1)]
    e, f = ([[none] * (len(b) + 1) for _ in range(len(a) + 1)] for _ in range(2))
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            e[i][j] = max(add(h[i][j - 1], al.OPEN, 0, -1, 0, 1), add(e[i][j - 1], al.EXTEND, 0, -1, 0, 1))
            f[i][j] = max(add(h[i - 1][j], al.OPEN, 0, -1, 1, 0), add(f[i - 1][j], al.EXTEND, 0, -1, 1, 0))
            same = a[i - 1] == b[j - 1]
            h[i][j] = max((0, 0, 0, 0, 0), add(h[i - 1][j - 1], al.MATCH if same else al.MISMATCH, int(same), -1, 1, 1), e[i][j], f[i][j])
            best = max(best, h[i][j])
    return best[0], best[1], -best[2], best[3], best[4]


def grams_of(s: str, k: int = 3) -> set:
    return {s[i : i + k] for i in range(len(s) - k + 1)}


def slow_alike(a: str, b: str, shared: int = 2) -> bool:
    if len(grams_of(a) & grams_of(b)) < shared:
        return False
    _, matches, columns, span_a, span_b = slow_hit(a, b)
    return matches >= 0.5 * columns and span_a >= 0.5 * len(a) and span_b >= 0.5 * len(b)


def made(seed: int, families: int, each: int, letters: str = scales.ALPHABET) -> list[str]:
    rng = random.Random(seed)
    out = ["", "A", "ACD", "ACDE"]
    for _ in range(families):
        root = [rng.choice(letters) for _ in range(rng.randint(8, 30))]
        for _ in range(each):
            s = list(root)
            for _ in range(rng.randint(0, len(s) // 2)):
                at = rng.randrange(len(s))
                s[at : at + rng.randrange(2)] = rng.choices(letters, k=rng.randrange(2))
                s = s or ["A"]
            out.append("".join(s))
    return out


def test_batches_are_the_dynamic_program():
    for seed, letters in ((1, "AC"), (2, scales.ALPHABET), (3, "Aé")):
        rng = random.Random(seed)
        names = made(seed, 6, 5, letters)
        a, b = [rng.choice(names) for _ in range(150)], [rng.choice(names) for _ in range(150)]
        found = al.local_hits(pd.Series(a), pd.Series(b)).to_numpy().tolist()
        assert [tuple(x) for x in found] == [slow_hit(x, y) for x, y in zip(a, b, strict=True)]
    assert al.local_hits(pd.Series([None, "A"]), pd.Series(["A", None])).to_numpy().sum() == 0
    long = "ACDEFGHIKL" * 900
    assert al.local_hits(pd.Series([long[:1500]]), pd.Series([long[:40]])).score[0] == 2 * 40


def test_long_pairs_need_wide_integers():
    rng = random.Random(4)
    a, b = ("".join(rng.choices("ACD", k=n)) for n in (2600, 30))
    assert tuple(al.local_hits(pd.Series([a]), pd.Series([b])).iloc[0]) == slow_hit(a, b)


def test_best_hits(spark):
    queries, reference = made(5, 6, 4), made(5, 6, 4)[10:] + made(6, 4, 3)
    left = spark.createDataFrame(list(enumerate(queries)), "a int, seq_a string")
    right = spark.createDataFrame(list(enumerate(reference)), "b int, seq_b string")
    expected = {}
    for i, q in enumerate(queries):
        hits = []
        for j, r in enumerate(reference):
            shared = [p - o for p in range(len(q) - 2) for o in range(len(r) - 2) if q[p : p + 3] == r[o : o + 3]]
            if shared and max(map(shared.count, shared)) >= 2:
                score, matches, columns, x, y = slow_hit(q, r)
                hits.append((-score, -matches / columns, j, x, y))
        if hits:
            s, m, j, x, y = min(hits)
            expected[i] = (j, -m, -s, x, y)
    assert {r.a: tuple(r)[1:] for r in al.best_hits(left, right).collect()} == expected and expected


@pytest.mark.parametrize("seed,letters,first", [(1, scales.ALPHABET, 8), (2, "ACD", 1), (3, "ACDEF", 2)])
def test_clusters_are_the_greedy_loop(spark, seed, letters, first):
    names = made(seed, 12, 6, letters)
    rows = [(100 - i, s) for i, s in enumerate(names)] + [(500, None), (501, None), (502, names[7])]
    found = {r.row_id: r.cluster for r in al.identity_clusters(spark.createDataFrame(rows, "row_id long, sequence string"), first=first).collect()}
    lowest = {}
    for i, s in rows:
        if s is not None:
            lowest[s] = min(i, lowest.get(s, i))
    reps, of = [], {}
    for s in sorted(lowest, key=lambda s: (-len(s), lowest[s])):
        of[s] = next((r for r in reps if slow_alike(s, r)), None)
        if of[s] is None:
            reps.append(s)
            of[s] = s
    assert found == {i: i if s is None else lowest[of[s]] for i, s in rows}
    assert 1 < len(reps) < len(lowest)


def test_no_sequences_no_clusters(spark):
    assert al.identity_clusters(spark.createDataFrame([], "row_id long, sequence string")).count() == 0
