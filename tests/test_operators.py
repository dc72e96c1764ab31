"""Selection against a loop, quotas and ranks by property, sources by round trip."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from sievework.operators import cleaning, learning, ranking, scoring, selection, validation
from sievework.sources import fasta, npz, records, tables
from sievework.streaming import ingest


def loop_select(rows, quotas, total, forced):
    """The selection said as a loop over candidates."""
    order = sorted(rows, key=lambda r: (-r[3], r[0]))
    chosen, used = [], {}

    def take(r):
        chosen.append(r)
        used[r[2]] = used.get(r[2], 0) + 1

    by_id = {r[0]: r for r in rows}
    for i in forced:
        take(by_id[i])
    for cell in sorted(quotas):
        got, local = sum(r[1] == cell for r in chosen), {}
        for turn in range(1, len(rows) + 1):
            for r in order:
                if got < quotas[cell] and r[1] == cell and r not in chosen and local.get(r[2], 0) < turn:
                    local[r[2]] = local.get(r[2], 0) + 1
                    take(r)
                    got += 1
    for turn in range(1, len(rows) + 1):
        for r in order:
            if len(chosen) < total and r not in chosen and used.get(r[2], 0) < turn:
                take(r)
    if len(chosen) > total:
        first = [r for r in chosen if r[0] in forced]
        chosen = (first + [r for r in chosen if r[0] not in forced])[:total]
    return [r[0] for r in chosen]


@pytest.mark.parametrize("seed", [1, 2])
def test_select_is_the_loop(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice("abc"), rng.randrange(4), float(rng.randrange(6))) for i in range(40)]
    quotas, forced = {"a": 6, "b": 9, "c": 3}, [7, 3]
    df = spark.createDataFrame(rows, "row_id long, cell string, cluster int, quality double")
    wanted = spark.createDataFrame(list(quotas.items()), "cell string, quota long")
    first = spark.createDataFrame([(i, k) for k, i in enumerate(forced)], "row_id long, forced_pos int")
    found = selection.select(df, wanted, 20, forced=first).orderBy("pos").collect()
    assert [r.row_id for r in found] == loop_select(rows, quotas, 20, forced)


@pytest.mark.parametrize("total", [3, 50, 1001])
def test_quotas_sum_up(spark, total):
    df = spark.createDataFrame([(c,) for c in "a" * 97 + "b" * 13 + "c" * 5 + "d" * 1 + "e"], "cell string")
    rows = selection.quotas(df, "cell", total).collect()
    assert sum(r.quota for r in rows) == total and min(r.quota for r in rows) >= 0


def test_ranks(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, 9.0)], "id int, v double")
    assert [r.pct for r in ranking.rank_pct(df, "v", "id").orderBy("id").collect()] == [0, 0.5, 1]
    seven = spark.createDataFrame([(i, float(i)) for i in range(7)], "id int, v double")
    assert [r.bin for r in ranking.quantile_bin(seven, "v", "id", 5).orderBy("id").collect()] == [0, 0, 1, 2, 2, 3, 4]
    one = spark.createDataFrame([(1, 5.0)], "id int, v double")
    assert ranking.rank_pct(one, "v", "id").first().pct == 0


def listed(frame):
    rows = sorted(frame.collect(), key=lambda r: r.pos)
    assert [r.pos for r in rows] == list(range(1, len(rows) + 1))
    return [r.row_id for r in rows]


def test_top_is_diverse_and_capped(spark):
    df = spark.createDataFrame([(i, i % 2, 10.0 - i) for i in range(8)], "row_id long, cluster int, quality double")
    edges = spark.createDataFrame([(0, 1, 0.9), (0, 2, 0.6)], "a long, b long, ratio double")
    assert listed(selection.diverse_top(df, edges, 3, cap=2)) == [0, 2, 3]
    assert len(listed(selection.diverse_top(df, edges, 20, cap=1))) == 8
    assert listed(selection.diverse_top(df.limit(0), edges, 3)) == []


@pytest.mark.parametrize("seed,k,depth", [(1, 5, 400), (1, 5, 2), (2, 12, 7), (3, 60, 400)])
def test_top_is_the_walk_at_any_depth(spark, seed, k, depth):
    rng = random.Random(seed)
    rows = [(i, rng.randrange(6), float(rng.randrange(9))) for i in range(60)]
    pairs = {(a, b): round(rng.random(), 3) for a in range(60) for b in range(60) if a != b and rng.random() < 0.15}
    df, edges = spark.createDataFrame(rows, "row_id long, cluster int, quality double"), spark.createDataFrame([(*p, r) for p, r in pairs.items()], "a long, b long, ratio double")
    cap, most = 2, 0.65
    while True:
        chosen = []
        for i, c, _ in sorted(rows, key=lambda r: (-r[2], r[0])):
            close = [j for j in chosen if max(pairs.get((i, j), 0), pairs.get((j, i), 0)) > most]
            if len(chosen) < k and not close and sum(rows[j][1] == c for j in chosen) < cap:
                chosen.append(i)
        if len(chosen) == k or most == 1:
            break
        cap, most = cap + 2, min(1.0, most + 0.15)
    assert listed(selection.diverse_top(df, edges, k, cap=2, depth=depth)) == chosen


def test_hashed_parts_keep_groups(spark):
    df = spark.range(100).withColumn("g", F.col("id") % 7)
    assert learning.grouped_folds(df, "g").groupBy("g").agg(F.countDistinct("fold").alias("n")).where("n > 1").count() == 0
    assert cleaning.hashed_sample(df, "id", 10).count() == 10


def test_unknown_objective_is_the_default(spark):
    columns = ["mic_ecoli", "mic_paeru", "p_safe", "amp", "envelope", "risk"]
    df = spark.createDataFrame([tuple(float(i) for i in range(6))], columns)
    a, b = df.select(scoring.objective(columns, "no such"), scoring.objective(columns)).first()
    assert a == b


def test_report(spark):
    lib = spark.createDataFrame([("ACDEFGHI",), ("ACDEFGHI",), ("XX",), (None,)], "sequence string")
    out = {r.check: (r.value, r.ok) for r in validation.report(lib, lib.limit(1), lib.where("false"), size=4).collect()}
    assert out["library_invalid"] == (2, False) and out["library_repeats"] == (1, False) and out["library_size"] == (4, True) and out["library_in_reference"] == (0, True)


def test_fasta_round_trip(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.fasta").write_text("dropped\n>one activity=x\nacd\n\nEF\n>empty\n>two\nGH\n")
    rows = fasta.read_fasta(spark, str(tmp_path / "in")).orderBy("nth").collect()
    assert [(r.header, r.sequence) for r in rows] == [("one activity=x", "ACDEF"), ("empty", ""), ("two", "GH")]
    df = spark.createDataFrame([(2, "GH"), (1, "ACD")], "pos int, sequence string")
    fasta.write_fasta(df, str(tmp_path / "out"), "pos")
    assert [(r.header, r.sequence) for r in fasta.read_fasta(spark, str(tmp_path / "out")).orderBy("nth").collect()] == [("seq1", "ACD"), ("seq2", "GH")]


def test_fasta_appends_overwrites_and_cleans_up(spark, tmp_path):
    out = tmp_path / "out"
    spark.dataSource.register(fasta.FastaSource)
    rows = lambda *names: spark.createDataFrame([(n, "ACD") for n in names], "header string, sequence string").repartition(2)
    for names in (("a", "b"), ("c", "d", "e")):
        rows(*names).write.format("fasta").mode("append").save(str(out))
    assert sorted(r.header for r in fasta.read_fasta(spark, str(out)).collect()) == list("abcde")
    broken = rows("f", "g").withColumn("header", F.when(F.col("header") == "g", F.raise_error(F.lit("broken")).cast("string")).otherwise(F.col("header")))
    with pytest.raises(Exception, match="broken"):
        broken.write.format("fasta").mode("append").save(str(out))
    assert sorted(r.header for r in fasta.read_fasta(spark, str(out)).collect()) == list("abcde") and not [f for f in out.iterdir() if f.name.startswith("_")]
    rows("z").write.format("fasta").mode("overwrite").save(str(out))
    assert [r.header for r in fasta.read_fasta(spark, str(out)).collect()] == ["z"]


def test_npz_round_trip(spark, tmp_path, monkeypatch):
    import numpy as np

    monkeypatch.setattr(npz, "RANGE", 3)
    np.savez(tmp_path / "a.npz", combos=np.arange(28, dtype=np.int32).reshape(7, 4), weights=np.linspace(0, 1, 7, dtype=np.float32), on=np.arange(7) % 2 == 0)
    np.savez_compressed(tmp_path / "b.npz", combos=np.zeros((2, 4), np.int64), weights=np.array([np.nan, 2.0]), on=np.array([True, True]))
    df = npz.read_npz(spark, str(tmp_path))
    assert [(f.name, f.dataType.simpleString()) for f in df.schema] == [("combos", "array<bigint>"), ("weights", "double"), ("on", "boolean")]
    assert df.rdd.getNumPartitions() == 4
    rows = df.collect()
    assert len(rows) == 9 and sorted(r.combos[0] for r in rows) == [0, 0, 0, 4, 8, 12, 16, 20, 24]
    out = tmp_path / "out"
    for _ in range(2):
        npz.write_npz(df.where("not isnan(weights)").repartition(2), str(out))
    again = npz.read_npz(spark, str(out))
    key = lambda r: (r.combos, r.weights, r.on)
    assert sorted(map(key, again.collect())) == sorted(map(key, 2 * df.where("not isnan(weights)").collect()))
    with np.load(next(out.glob("*.npz"))) as file:
        assert sorted(file.files) == ["combos", "on", "weights"] and file["combos"].shape[1] == 4
    for broken in (df.withColumn("on", F.when(F.col("on"), True)), df.withColumn("combos", F.slice("combos", 1, 1 + F.col("on").cast("int")))):
        with pytest.raises(Exception, match="column"):
            npz.write_npz(broken.coalesce(1), str(out))
    assert again.count() == 16 and not [f for f in out.iterdir() if f.name.startswith("_")]
    npz.write_npz(df.limit(1), str(out), "overwrite")
    assert npz.read_npz(spark, str(out)).count() == 1


def test_one_cluster_fills_the_quota(spark):
    """200 rows of one cluster and cell: a quota above 64 is filled."""
    df = spark.createDataFrame([(i, "a", 1, float(i % 7)) for i in range(200)], "row_id long, cell string, cluster int, quality double")
    found = selection.select(df, spark.createDataFrame([("a", 100)], "cell string, quota long"), 150).collect()
    assert len(found) == len({r.row_id for r in found}) == 150 and sorted(r.pos for r in found) == list(range(1, 151))
    assert selection.round_robin(df, ["cell"], "cluster", "quality", "row_id", rounds=64).count() == 64


@pytest.mark.parametrize("groups", [[], ["g"], ["g", "h"]])
def test_running_places_and_sums(spark, groups):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "a", "a", "b", None]), rng.randrange(2), rng.randrange(50), rng.randrange(5)) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, g string, h int, v int, w int")
    found = ranking.running(ranking.running(df, groups, [F.desc("v"), F.col("id")], "nth"), groups, [F.desc("v"), F.col("id")], "upto", weight="w").collect()
    place, total = {}, {}
    for r in sorted(found, key=lambda r: (-r.v, r.id)):
        key = tuple(r[g] for g in groups)
        place[key], total[key] = place.get(key, 0) + 1, total.get(key, 0) + r.w
        assert (r.nth, r.upto) == (place[key], total[key])
    assert len(found) == 500


def test_weighted_draws_merge(spark):
    choices = [(i, (i * 7) % 5) for i in range(200)]
    df, draws = spark.createDataFrame(choices, "k int, w int"), spark.createDataFrame([(j, j / 997) for j in range(997)], "j int, u double")
    out = cleaning.weighted_draws(df, "w", "k", draws, "u")
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()
    total, upper, ends = sum(w for _, w in choices), 0, []
    for k, w in choices:
        upper += w
        ends.append((upper / total - w / total, k, w))
    expected = {j: max(e for e in ends if e[2] and e[0] <= j / 997)[1] for j in range(997)}
    assert {r.j: r.k for r in out.collect()} == expected
    assert cleaning.weighted_draws(df.where("w < 0"), "w", "k", draws, "u").count() == 0


def test_records(spark, tmp_path):
    good = {"id": "1", "sequence": "kwk", "complexity": {"name": "Monomer"}, "cTerminus": {"name": "AMD"}, "hemoliticCytotoxicActivities": [
        {"targetCell": "Human erythrocytes", "concentration": ">100", "unit": "µM"}, {"targetCell": {"name": "Human erythrocytes"}, "concentration": "50", "unit": {"name": "µM"}}, {"targetCell": "Sheep erythrocytes", "concentration": "1", "unit": "µM"}],
        "targetActivities": [{"activityMeasureGroup": {"name": "MIC"}, "targetSpecies": {"name": "Escherichia coli"}, "concentration": "8", "unit": "µM"}, {"activityMeasureGroup": "MBC", "concentration": "9", "unit": "µM"},
                             {"activityMeasureGroup": "MIC", "targetSpecies": "X", "concentration": "?", "unit": "pH"}]}
    (tmp_path / "1.json").write_text(json.dumps(good))
    (tmp_path / "2.json").write_text("{broken")
    (tmp_path / "3.json").write_text(json.dumps({"id": "3", "sequence": "AXB", "targetActivities": good["targetActivities"]}))
    rows = records.flatten_records(tables.read_records(spark, str(tmp_path))).orderBy("species").collect()
    assert [(r.species, r.mic_uM, r.human_hc50_uM, r.hc50_censored, r.c_term, r.monomer, r.unmodified) for r in rows] == [("Escherichia coli", 8.0, 50.0, False, "AMD", True, True), ("X", None, 50.0, False, "AMD", True, True)]


def test_lines_and_plain_csv(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, "a"), (3, None)], "n int, s string")
    tables.write_lines(df, str(tmp_path / "lines"), "s", "n")
    assert [p.read_text() for p in sorted((tmp_path / "lines").glob("part*"))] == ["a\nb\n"]
    tables.write_csv(df, str(tmp_path / "plain"), compression=None)
    assert sorted(tables.read_csv(spark, str(tmp_path / "plain"), "n int, s string").collect(), key=lambda r: r.n)[0].s == "a" and not list((tmp_path / "plain").glob("*.gz"))
    assert not tables.write_csv(df.limit(0), str(tmp_path / "none"), skip_empty=True) and not (tmp_path / "none").exists()


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([("A", 1, "E coli", "-", 2.0, True)], tables.ASSAYS)
    tables.write_csv(df, str(tmp_path / "csv"))
    assert tables.read_csv(spark, str(tmp_path / "csv"), tables.ASSAYS).collect() == df.collect()
    (tmp_path / "t.txt").write_text("A B\n\nC\n")
    assert [r.token for r in tables.read_tokens(spark, str(tmp_path / "t.txt")).collect()] == ["A", "B", "C"]
    assert json.loads(tables.manifest({"x": df, "y": df.union(df)})) == {"x": 1, "y": 2}


def test_stream_drains_and_resumes(spark, tmp_path):
    src, out, mark = (str(tmp_path / n) for n in ("src", "out", "mark"))
    rows = spark.range(10).select("id", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 60).alias("ts"), (F.col("id") % 2).cast("string").alias("kind"))
    rows.write.parquet(src)
    for expected in (10, 20):
        stream = ingest.follow(spark, src, rows.schema)
        ingest.drain(ingest.keep_first(stream, "id", "ts"), out, mark).awaitTermination()
        assert spark.read.parquet(out).count() == expected
        rows.withColumn("id", F.col("id") + 100).write.mode("append").parquet(src)


@pytest.mark.parametrize("chunk", [3, 4096])
def test_cell_means_are_lloyd(spark, monkeypatch, chunk):
    """A cell that holds most rows is dealt to many groups; the clusters are those of a plain loop from the same starts."""
    import hashlib

    import numpy as np

    monkeypatch.setattr(learning, "CHUNK", chunk)
    rng = np.random.default_rng(1)
    rows = [(i, "big" if i % 5 else "small", (rng.integers(0, 4, 3) * 3.0 + rng.normal(size=3)).tolist()) for i in range(120)] + [(500, "one", [1.0] * 3)]
    df = spark.createDataFrame(rows, "row_id long, cell string, vector array<double>")
    wanted = spark.createDataFrame([("big", 200), ("small", 90), ("one", 500), ("gone", 80)], "cell string, quota long")
    found = learning.cell_centroids(df, "cell", "vector", wanted, starts=3, steps=6).collect()
    for cell, k in (("big", 5), ("small", 2)):
        members = [(i, np.array(v)) for i, c, v in rows if c == cell]
        points = np.stack([v for _, v in members])
        best = None
        for start in range(3):
            order = sorted(members, key=lambda m: (hashlib.md5(f"0:{start}:{m[0]}".encode()).hexdigest(), str(m[0])))
            centres = np.stack([v for _, v in order[:k]])
            for _ in range(7):
                far = ((points[:, None] - centres[None]) ** 2).sum(axis=2)
                near, used = far.argmin(axis=1), centres
                centres = np.stack([points[near == j].mean(axis=0) if (near == j).any() else used[j] for j in range(k)])
            if best is None or far.min(axis=1).sum() < best[0] - 1e-9:
                best = (far.min(axis=1).sum(), used, near)
        mine = sorted((r.sub, r.n, r.centroid) for r in found if r.cell == cell)
        assert [m[0] for m in mine] == list(range(k)) and [m[1] for m in mine] == [(best[2] == j).sum() for j in range(k)]
        assert np.allclose([m[2] for m in mine], best[1])
    assert {r.cell for r in found} == {"big", "small"}
