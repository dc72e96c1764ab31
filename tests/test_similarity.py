"""The similarity join against all pairs."""

from __future__ import annotations

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sievework.functions import scales
from sievework.operators import similarity


def family(rng: random.Random, n: int, short: int = 8, long: int = 50) -> list[str]:
    """Random sequences and edited copies of them, some with foreign letters, some very short."""
    out = ["", "", "A", "AC", "B?", "é" * 9, "é" * 8 + "A"]
    while len(out) < n:
        fresh = [rng.choice(scales.ALPHABET) for _ in range(rng.randint(short, long))]
        out.append("".join(fresh))
        for _ in range(3):
            for _ in range(rng.randint(1, 6)):
                at = rng.randrange(len(fresh))
                fresh[at : at + rng.randrange(2)] = [rng.choice(scales.ALPHABET)] * rng.randrange(2)
                fresh = fresh or ["A"]
            out.append("".join(fresh))
    return out[:n]


@pytest.mark.parametrize("threshold", [0.5, 0.65, 0.75, 0.8, 0.9, 1.0])
def test_join_finds_all_pairs(spark, threshold):
    rng = random.Random(int(threshold * 100))
    names = family(rng, 120)
    left = spark.createDataFrame(list(enumerate(names)), "a int, seq_a string")
    right = spark.createDataFrame(list(enumerate(names)), "b int, seq_b string")
    every = left.crossJoin(right).withColumn("ratio", similarity.indel_ratio()("seq_a", "seq_b")).where(F.col("ratio") > threshold)
    found = {(r.a, r.b): r.ratio for r in similarity.similar_pairs(left, right, threshold).collect()}
    assert found == {(r.a, r.b): r.ratio for r in every.collect()}
    assert similarity.similar_pairs(left.limit(0), right, threshold).count() == 0


def test_few_pairs_are_compared(spark):
    rng = random.Random(9)
    names = list({"".join(rng.choices(scales.ALPHABET, k=rng.randint(18, 30))) for _ in range(1500)})
    left = spark.createDataFrame(list(enumerate(names)), "a int, seq_a string")
    right = left.select(F.col("a").alias("b"), F.col("seq_a").alias("seq_b"))
    admitted = sum(min(len(x), len(y)) >= similarity.length_gate(0.8) * max(len(x), len(y)) for x in names for y in names)
    met = similarity.candidate_pairs(left, right, 0.8).where("a <> b").count()
    assert met < admitted / 1000


def test_functions_in_sql(spark):
    from sievework.functions import registered

    registered.register(spark)
    spark.createDataFrame([(1, "ABCDE"), (2, "AB"), (3, None), (4, "")], "id int, s string").createOrReplaceTempView("texts")
    found = spark.sql("SELECT id, place, gram FROM texts, LATERAL grams(s, 3)").collect()
    assert sorted(map(tuple, found)) == [(1, 1, "ABC"), (1, 2, "BCD"), (1, 3, "CDE")]
    assert spark.sql("SELECT * FROM grams('ABC', 0)").count() == 0
    row = spark.sql("SELECT indel_ratio('ABC', 'AXC') AS r, indel_ratio(NULL, 'A') AS n, local_hit('ACDEF', 'CDE').score AS score, size(composition_vector('AAC')) AS size, sketch_key(s) AS k FROM texts WHERE id = 1").first()
    assert abs(row.r - 2 / 3) < 1e-12 and row.n is None and row.score == 6 and row["size"] == 420
    assert row.k == similarity.sketch_keys(pd.Series(["ABCDE"]))[0]


@pytest.mark.parametrize("piece", [1 << 15, 7])
def test_kmer_hits_by_hashes_are_exact(spark, monkeypatch, piece):
    """The reference's grams are hashed without being made: the plan makes none, and none spans two texts or is lost at a cut."""
    monkeypatch.setattr(similarity, "PIECE", piece)
    rng = random.Random(8)
    text = lambda n: "".join(rng.choices("abc😀é", k=n))
    theirs = [text(rng.choice([0, 2, 5, 6, 40, 90])) for _ in range(60)] + [None]
    mine = [text(rng.randint(0, 25)) for _ in range(40)] + [theirs[5][3:20], None]
    known = {t[i : i + 5] for t in theirs if t for i in range(len(t) - 4)}
    own = spark.createDataFrame(list(enumerate(mine)), "i long, s string")
    found = similarity.kmer_hits(own, "s", "i", spark.createDataFrame([(t,) for t in theirs], "s string").repartition(3), "s", 5)
    for i, hit in found.collect():
        grams = [(mine[i] or "")[j : j + 5] for j in range(len(mine[i] or "") - 4)]
        assert hit == pytest.approx(sum(g in known for g in grams) / len(grams) if grams else 0.0)
    assert "regexp_extract_all" not in found._jdf.queryExecution().optimizedPlan().toString()
