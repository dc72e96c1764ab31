"""Heads: reports against SQL on their predictions, saving and loading, folds by cluster."""

from __future__ import annotations

import random

import pytest
from conftest import same_rows
from pyspark.sql import functions as F

from sievework.functions import scales
from sievework.operators import alignment, training


@pytest.fixture(scope="module")
def trained(spark, tmp_path_factory):
    rng = random.Random(1)
    roots = ["".join(rng.choices(scales.ALPHABET, k=20)) for _ in range(40)]
    names = sorted({"".join(rng.choice(scales.ALPHABET) if rng.random() < 0.15 else c for c in root) for root in roots for _ in range(4)})
    share = lambda s: sum(s.count(c) for c in "KR") / len(s)
    rows = [(s, i % 2, 8 - 20 * share(s) + rng.gauss(0, 0.2), 1 + i % 3) for i, s in enumerate(names)]
    labels = [(s, 0, float(share(s) > 0.1), 1) for s in names]
    schema = "sequence string, amidated int, y double, n long"
    few = spark.createDataFrame(rows[:20] + [(None, 0, 1.0, 1)], schema)
    targets = {"mic": training.Target(spark.createDataFrame(rows, schema), active=6.0), "amp": training.Target(spark.createDataFrame(labels, schema), classify=True), "few": training.Target(few)}
    folder = str(tmp_path_factory.mktemp("heads"))
    report, guesses = training.train_heads(targets, folder, least=60, rounds=6, depth=3, rate=0.3)
    return report, guesses, folder, names


def test_the_report_is_sql_on_the_predictions(trained):
    import duckdb

    report, guesses, _, names = trained
    con = duckdb.connect()
    for name in ("mic", "amp"):
        frame = guesses[name].select("y", "guess").toPandas()
        assert len(frame) == len(names)
        con.register(name, frame)
    sql = """WITH r AS (SELECT y, guess, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS a, rank() OVER (ORDER BY guess) + (count(*) OVER (PARTITION BY guess) - 1) / 2 AS b,
      rank() OVER (ORDER BY -guess) + (count(*) OVER (PARTITION BY guess) - 1) / 2 AS c FROM mic WHERE guess IS NOT NULL),
    p AS (SELECT y, rank() OVER (ORDER BY guess) + (count(*) OVER (PARTITION BY guess) - 1) / 2 AS b FROM amp WHERE guess IS NOT NULL)
    SELECT 'mic' AS head, (SELECT count(*) FROM mic) AS n, corr(a, b) AS spearman, sqrt(avg(pow(y - guess, 2))) AS rmse, 1 - avg(pow(y - guess, 2)) / var_pop(y) AS r2,
      (sum(c) FILTER (y <= 6) - count(*) FILTER (y <= 6) * (count(*) FILTER (y <= 6) + 1) / 2) / (count(*) FILTER (y <= 6) * count(*) FILTER (y > 6)) AS auroc FROM r
    UNION ALL SELECT 'amp', (SELECT count(*) FROM amp), NULL, NULL, NULL, (sum(b) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))) FROM p"""
    same_rows(report, con, sql)
    assert report.where("head = 'mic'").first().spearman > 0.5


def test_saved_heads_score_as_before(spark, trained):
    _, guesses, folder, names = trained
    heads = training.load_heads(spark, folder)
    assert sorted(heads) == ["amp", "mic"] and heads["amp"].getOrDefault("classify") and sorted(heads["mic"].models) == [0, 1, 2, 3, 4]
    rows = spark.createDataFrame([(i, s, 0, "x") for i, s in enumerate(names)], "row_id long, sequence string, amidated int, prediction string")
    scored = training.score_heads(rows, heads)
    assert scored.columns == ["row_id", "sequence", "amidated", "prediction", "mic", "amp"] or set(scored.columns) == {"row_id", "sequence", "amidated", "prediction", "mic", "amp"}
    # the mean over the folds, one of which is the out-of-fold model
    own = training.with_features(rows, out="features")
    by_fold = [{r.row_id: r.one for r in heads["mic"]._with(own, f, "one").select("row_id", "one").collect()} for f in range(5)]
    for r in scored.collect():
        assert abs(r.mic - sum(p[r.row_id] for p in by_fold) / 5) < 1e-9 and 0 <= r.amp <= 1
    assert training.score_heads(rows.limit(0), heads).count() == 0
    path = f"{folder}-estimator"
    training.HeadEnsemble(classify=True, depth=2).save(path)
    assert training.HeadEnsemble.load(path).getOrDefault("depth") == 2


def test_folds_keep_clusters_together(spark, trained):
    _, guesses, _, names = trained
    named = spark.createDataFrame([(s, s) for s in names], "row_id string, sequence string")
    cluster = {r.row_id: r.cluster for r in alignment.identity_clusters(named).collect()}
    fold = {r.sequence: r.fold for r in guesses["mic"].select("sequence", "fold").collect()}
    assert len(set(cluster.values())) < len(names)
    for s in names:
        assert fold[s] == fold[cluster[s]]


def test_rows_are_made_once(spark, tmp_path):
    """What makes a head's rows may be a join of all measurements, so it runs once, whatever is read from the rows."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def costly(n):
        made.add(1)
        return float(n)

    rows = spark.createDataFrame([("KWKLFKKIGAVLKVL"[i % 5 :], 0, i) for i in range(20)], "sequence string, amidated int, n long")
    rows = rows.groupBy("sequence", "amidated").agg(F.sum(costly("n")).alias("y"), F.count("*").alias("n"))
    guard = rows.select("sequence", "amidated", "y", "n").where("y >= 0")
    training.train_heads({"one": training.Target(guard)}, str(tmp_path / "heads"), least=10**9)
    assert made.value == 20


def test_the_amidation_flag_is_learnt(spark, tmp_path):
    """Labels that go by the flag alone: a sequence's two rows get different predictions, out of fold and from the saved head."""
    rng = random.Random(2)
    names = ["".join(rng.choices(scales.ALPHABET, k=12)) for _ in range(60)]
    rows = spark.createDataFrame([(s, flag, 4.0 - 3.0 * max(flag, 0), 2) for s in names for flag in (-1, 1)], "sequence string, amidated int, y double, n long")
    report, guesses = training.train_heads({"mic": training.Target(rows)}, str(tmp_path / "heads"), least=60, rounds=2, depth=2, rate=1.0)
    assert report.first().r2 > 0.9
    for r in guesses["mic"].collect():
        assert abs(r.guess - r.y) < 0.5
    asked = spark.createDataFrame([(s, flag) for s in names[:5] for flag in (-1, 0, 1)], "sequence string, amidated int")
    for r in training.score_heads(asked, training.load_heads(spark, str(tmp_path / "heads"))).collect():
        assert abs(r.mic - (1.0 if r.amidated == 1 else 4.0)) < 0.5


def test_small_heads_are_reported(spark, tmp_path):
    """A head of few rows, or of none, has its row in the report and its column among the scores."""
    schema = "sequence string, amidated int, y double, n long"
    few = spark.createDataFrame([("KWKLFKKIGAVLKVL"[i:], 0, float(i), 1) for i in range(5)], schema)
    targets = {"few": training.Target(few), "none": training.Target(few.limit(0), active=1.0), "sure": training.Target(few.withColumn("y", F.lit(1.0)), classify=True)}
    report, guesses = training.train_heads(targets, str(tmp_path / "heads"), rounds=2)
    assert sorted(map(tuple, report.collect())) == [("few", 5, None, None, None, None), ("none", 0, None, None, None, None), ("sure", 5, None, None, None, None)]
    assert {n: g.where("guess is null").count() for n, g in guesses.items()} == {"few": 5, "none": 0, "sure": 5}
    scored = training.score_heads(few.select("sequence", "amidated"), training.load_heads(spark, str(tmp_path / "heads")))
    assert [(r.few, r.none, r.sure) for r in scored.collect()] == [(None, None, None)] * 5


def test_head_report_of_small_tables(spark, tmp_path):
    """The query reports both heads of twenty parts as well."""
    from conftest import SMALL

    from sievework.plans import model_queries

    parts = spark.read.parquet(f"{SMALL}/part.parquet").orderBy("p_partkey").limit(20)
    parts.write.parquet(f"{tmp_path}/part.parquet")
    spark.read.parquet(f"{SMALL}/lineitem.parquet").join(parts, F.col("l_partkey") == F.col("p_partkey"), "left_semi").write.parquet(f"{tmp_path}/lineitem.parquet")
    rows = {r["head"]: r.n for r in model_queries.head_report(spark, str(tmp_path)).collect()}
    assert sorted(rows) == ["potency", "safe"] and rows["potency"] >= rows["safe"] > 0


def test_the_order_of_rows_does_not_matter(spark, tmp_path):
    """The same rows in other orders and partitions give the same trees, though many splits are equally good."""
    rng = random.Random(3)
    names = sorted({"".join(rng.choices(scales.ALPHABET, k=10)) for _ in range(90)})
    rows = spark.createDataFrame([(s, flag, rng.gauss(0, 1) / 3, 1 + rng.randrange(5)) for s in names for flag in (0, 1)], "sequence string, amidated int, y double, n long")
    found = []
    for i, dealt in enumerate((rows.coalesce(1).sortWithinPartitions("sequence", "amidated"), rows.repartition(3, "n").sortWithinPartitions(F.desc("y")))):
        _, guesses = training.train_heads({"one": training.Target(dealt)}, str(tmp_path / f"heads-{i}"), rounds=3, depth=3, rate=0.3)
        found.append(sorted((r.sequence, r.amidated, r.guess) for r in guesses["one"].collect()))
    assert found[0] == found[1]
