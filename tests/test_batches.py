"""Descriptors of batches against plain Python, and how their queries are spread."""

from __future__ import annotations

import math
import random

import pandas as pd
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from sievework.functions import batches, scales
from sievework.operators import similarity
from sievework.plans import catalogue

WEIGHTS = {"KK": 3.5, "AL": -2.0, "😀😀": 4.0}


def slow(s: str) -> dict[str, float]:
    """Some descriptors, a letter at a time."""
    n, value = len(s), [scales.EISENBERG.get(c, 0.0) for c in s]
    turn = math.radians(100.0)

    def vector(lo: int, hi: int) -> tuple[float, float]:
        return sum(value[i] * math.cos(turn * i) for i in range(lo, hi)), sum(value[i] * math.sin(turn * i) for i in range(lo, hi))

    spans = [(i, min(i + 11, n)) for i in range(n)]
    x, y = vector(0, n)
    face = [c for i, c in enumerate(s) if math.cos(turn * i) * x + math.sin(turn * i) * y >= -1e-12] if x or y else []
    run = lambda good: max((j - i for i in range(n) for j in range(i + 1, n + 1) if good(s[i:j])), default=0)
    return {
        "length": n, "moment": max((math.hypot(*vector(lo, hi)) / (hi - lo) for lo, hi in spans), default=0.0), "face": sum(c in scales.HYDROPHOBIC for c in face) / len(face) if face else 0.0,
        "run_identical": run(lambda t: len(set(t)) == 1), "run_positive": run(lambda t: set(t) <= set(scales.POSITIVE)), "count_p": s.count("P"),
        "positive_window": max((sum(c in scales.POSITIVE for c in s[i : i + 5]) for i in range(n)), default=0),
        "instability": 10 / n * sum(WEIGHTS.get(s[i : i + 2], 1.0) for i in range(n - 1)) if n > 1 else 0.0,
    }


def test_batches_are_letter_by_letter():
    rng = random.Random(4)
    rows = ["", "A", "😀😀K", "KKKKKK", "xx", "ALALAL", *["".join(rng.choices(scales.ALPHABET + "xz", k=rng.randint(1, 45))) for _ in range(80)]]
    found = batches.descriptors(pd.Series([*rows, None]), WEIGHTS)
    assert found.iloc[len(rows)].isna().all()
    for i, s in enumerate(rows):
        expected = slow(s)
        assert [found[name][i] for name in expected] == pytest.approx(list(expected.values()), abs=1e-12), s


def test_empty_batches():
    assert len(batches.descriptors(pd.Series([], dtype=object), WEIGHTS)) == 0
    assert batches.descriptors(pd.Series([None, ""])).isna()["moment"].tolist() == [True, False]


@pytest.mark.parametrize("name", ["descriptor_rows", "isoelectric_point", "face_fraction", "property_cells", "hydrophobic_moments"])
def test_one_file_is_worked_on_by_all_cores(spark, name):
    """A table of one split goes to every core, and its letters are walked once for each column asked for at most."""
    frame = catalogue.queries()[name](spark, SMALL)
    assert frame.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "aggregate(" not in plan and "transform(" not in plan


def test_grams_of_a_row_are_counted_in_its_batch(spark):
    rows = [(1, "KKKK"), (2, "a😀a😀"), (3, "K"), (4, ""), (5, None), (6, "KAKA")]
    found = similarity.gram_counts(spark.createDataFrame(rows, "id long, s string").repartition(2), "id", "s", 2).collect()
    expected = [(i, g, sum(s[j : j + 2] == g for j in range(len(s) - 1)), len(s) - 1) for i, s in rows if s for g in {s[j : j + 2] for j in range(len(s) - 1)}]
    assert sorted(map(tuple, found)) == sorted(expected)
    plan = catalogue.queries()["gram_frequencies"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Join" not in plan


def test_alike_rows_are_cut_once(spark, tmp_path):
    """The table function runs over distinct names and types, in more than one task."""
    part = spark.read.parquet(f"{SMALL}/part.parquet")
    part.unionByName(part.withColumn("p_partkey", F.col("p_partkey") + 10**6)).coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    once = {r.gram: r for r in catalogue.queries()["sql_gram_counts"](spark, SMALL).collect()}
    frame = catalogue.queries()["sql_gram_counts"](spark, str(tmp_path))
    twice = {r.gram: r for r in frame.collect()}
    assert once.keys() == twice.keys() and all((2 * a.n, a.types, a.first) == tuple(twice[g])[1:] for g, a in once.items())
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan[plan.index("grams") :]
