"""Queries that cluster by identity, align, train heads, and compare distributions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scales
from ..operators import alignment, assays, distribution, scoring, training
from ..session import kept, shared_dir, spread, table
from .sequence_queries import _PKA, SEQS, _charge_sql, _moment_sql, _values, parts


def _sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as sequences, of letters of the alphabet alone."""
    return parts(spark, sf_dir).select(F.col("id").alias("row_id"), F.col("s").alias("sequence"))


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part's identity cluster."""
    return alignment.identity_clusters(_sequences(spark, sf_dir))


def best_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the distinct names with an odd checksum, the best hit among the others."""
    names = kept(_sequences(spark, sf_dir).groupBy("sequence").agg(F.min("row_id").alias("row_id")).withColumn("odd", F.crc32(F.col("sequence").cast("binary")) % 2))
    left = names.where("odd = 1").select(F.col("row_id").alias("a"), F.col("sequence").alias("seq_a"))
    right = names.where("odd = 0").select(F.col("row_id").alias("b"), F.col("sequence").alias("seq_b"))
    found = alignment.best_hits(left, right)
    return found.select("a", "b", F.round("identity", 6).alias("identity"), "score", "span_a", "span_b")


def _heads(spark: SparkSession, sf_dir: str):
    """Two heads over the parts' sequences: the quantities' mean logarithm, and whether most lines of a sequence are dear."""
    named = table(spark, sf_dir, "lineitem").join(_sequences(spark, sf_dir), F.col("l_partkey") == F.col("row_id"))
    medians = assays.replicate_medians(named.withColumn("amidated", (F.col("l_linenumber") % 2).cast("int")), ["sequence", "l_returnflag", "amidated"], "l_quantity")
    potency = assays.mean_of_logs(medians, ["sequence", "amidated"])
    # lines are joined once for each head: what follows reads the kept rows
    dear = kept(named.groupBy("sequence").agg(F.avg(F.log2("l_extendedprice")).alias("mean"), F.count("*").alias("n")))
    middle = dear.agg(F.median("mean")).first()[0]
    safe = dear.select("sequence", F.lit(0).alias("amidated"), (F.col("mean") >= F.lit(middle)).cast("double").alias("y"), "n")
    targets = {"potency": training.Target(potency, active=4.5), "safe": training.Target(safe, classify=True)}
    folder = f"{shared_dir(spark)}/heads-{uuid.uuid4().hex}"
    return training.train_heads(targets, folder, rounds=4, depth=3, rate=0.3), folder


def head_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of both heads, of out-of-fold predictions over grouped folds."""
    report = _heads(spark, sf_dir)[0][0]
    return report.select("head", "n", *[F.round(c, 6).alias(c) for c in ("spearman", "rmse", "r2", "auroc")])


def head_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts scored by the heads as they were saved and loaded again."""
    heads = training.load_heads(spark, _heads(spark, sf_dir)[1])
    return training.score_heads(spread(_sequences(spark, sf_dir)).withColumn("amidated", F.lit(0)), heads).select("row_id", *[F.round(h, 6).alias(h) for h in heads])


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The embeddings of odd ids as the generated side, and of even ids as the real one."""
    rows = table(spark, sf_dir, "embeddings").where("embedding is not null").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    return rows.where("id % 2 = 1"), rows.where("id % 2 = 0")


def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall, density, coverage and authenticity among the embeddings."""
    row = distribution.neighbour_metrics(*_vectors(spark, sf_dir))
    return row.select(*[F.round(c, 9).alias(c) for c in row.columns])


NEIGHBOURS = """WITH v AS (SELECT vec_id AS id, vec_id % 2 = 0 AS real, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL),
d AS MATERIALIZED (SELECT a.id AS a, a.real AS ra, b.id AS b, b.real AS rb, sqrt(list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(a.e, b.e)])) AS d FROM v a JOIN v b ON a.id <> b.id),
near AS (SELECT a, ra, d, row_number() OVER (PARTITION BY a ORDER BY d, b) AS nth FROM d WHERE ra = rb),
balls AS (SELECT a AS id, max(ra) AS real, max(d) FILTER (nth = 5) AS ball, max(d) FILTER (nth = 1) AS apart FROM near WHERE nth <= 5 GROUP BY a),
cut AS (SELECT median(ball) AS c FROM balls WHERE real),
met AS (SELECT a, ra, b, rb, d <= ball AS inside, d <= least(ball, c) AS inner_ FROM d JOIN balls ON id = b, cut),
asked AS (SELECT a, count(*) FILTER (inside) AS n, count(*) FILTER (inner_) AS m FROM met WHERE NOT ra AND rb GROUP BY a),
held AS (SELECT b, count(*) FILTER (inside) AS n FROM met WHERE NOT ra AND rb GROUP BY b),
recalled AS (SELECT a, count(*) FILTER (inside) AS n FROM met WHERE ra AND NOT rb GROUP BY a),
own AS (SELECT a, count(*) FILTER (inner_) AS m FROM met WHERE ra AND rb GROUP BY a),
closest AS (SELECT a, arg_min(b, {'d': d, 'b': b}) AS b, min(d) AS away FROM d WHERE NOT ra AND rb GROUP BY a)
SELECT round(avg((a.n > 0)::INT), 9) AS precision, (SELECT round(avg((n > 0)::INT), 9) FROM recalled) AS recall, round(sum(a.n) / (5.0::DOUBLE * count(*)), 9) AS density, (SELECT round(avg((n > 0)::INT), 9) FROM held) AS coverage,
  round(avg(least(1, m / 5.0::DOUBLE)) / (SELECT avg(least(1, m / 5.0::DOUBLE)) FROM own), 9) AS clipped_density, (SELECT round(avg(least(1, n / 5.0::DOUBLE)), 9) FROM held) AS clipped_coverage,
  (SELECT round(avg((away > apart)::INT), 9) FROM closest JOIN balls ON id = b) AS authenticity FROM asked a"""


def frechet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: the Fréchet distance of the two sides."""
    return spark.createDataFrame([(distribution.frechet(*_vectors(spark, sf_dir)),)], "frechet double").select(F.round("frechet", 9).alias("frechet"))


def discrepancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: the squared kernel discrepancy of the two sides, and its bound."""
    found, bound = distribution.kernel_discrepancy(*_vectors(spark, sf_dir), width=1.0)
    return spark.createDataFrame([(found, bound)], "mmd2 double, bound double").select(F.round("mmd2", 9).alias("mmd2"), F.round("bound", 9).alias("bound"))


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of odd ids as a library, of even ids as its reference."""
    rows = _sequences(spark, sf_dir)
    row = distribution.library_report(rows.where("row_id % 2 = 1"), rows.where("row_id % 2 = 0"))
    return row.select(*[F.round(c, 6).alias(c) for c in row.columns])


def _kl_sql(name: str, value: str, width: float) -> str:
    bins = f"SELECT CAST(floor(round({value} / {width}::DOUBLE, 6)) AS BIGINT) AS bin, id % 2 AS own FROM rows"
    return f"""(SELECT round(sum(p * ln(p / q)), 6) FROM (SELECT (a + 1) / sum(a + 1) OVER () AS p, (b + 1) / sum(b + 1) OVER () AS q FROM (
  SELECT bin, count(*) FILTER (own = 1) AS a, count(*) FILTER (own = 0) AS b FROM ({bins}) GROUP BY bin))) AS kl_{name}"""


REPORT = f"""WITH {SEQS}, {_PKA}, {_values('eis', scales.EISENBERG)}, {_values('kd', scales.HYDROPATHY)}, {_moment_sql('moment', 11, 100.0)},
facts AS (SELECT id, max(n) AS length, {_charge_sql('7.4')} AS charge, avg(kd.v) AS gravy FROM chars JOIN kd USING (c) LEFT JOIN pka USING (c) GROUP BY id),
rows AS MATERIALIZED (SELECT * FROM facts JOIN moment USING (id) JOIN seqs USING (id)),
fractions AS (SELECT id % 2 AS own, c, sum(k / n) AS total FROM (SELECT id, c, count(*) AS k, max(n) AS n FROM chars GROUP BY id, c) GROUP BY ALL),
means AS (SELECT c, coalesce(max(total) FILTER (own = 1), 0) / (SELECT count(*) FROM rows WHERE id % 2 = 1) - coalesce(max(total) FILTER (own = 0), 0) / (SELECT count(*) FROM rows WHERE id % 2 = 0) AS gap FROM fractions GROUP BY c)
SELECT round(count(DISTINCT s) / count(*), 6) AS uniqueness, round(count(DISTINCT s) FILTER (s NOT IN (SELECT s FROM rows WHERE id % 2 = 0)) / count(DISTINCT s), 6) AS novelty,
  round(avg(length), 6) AS mean_length, round(avg(charge), 6) AS mean_charge, (SELECT round(sqrt(sum(gap * gap)), 6) FROM means) AS composition_gap,
  {_kl_sql('charge', 'charge', 1.0)}, {_kl_sql('moment', 'moment', 0.1)}, {_kl_sql('gravy', 'gravy', 0.25)}, {_kl_sql('length', 'length', 1.0)} FROM rows WHERE id % 2 = 1"""


def agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts' median quantities among returned lines and among open ones, as two sources."""
    lines = table(spark, sf_dir, "lineitem")
    sides = [lines.where(F.col("l_returnflag") == flag).groupBy("l_partkey").agg(F.median("l_quantity").alias("value")) for flag in ("R", "N")]
    return scoring.agreement(*sides, "l_partkey", "value").select("n", F.round("spearman", 6).alias("spearman"))


AGREEMENT = """WITH m AS (SELECT l_partkey, l_returnflag AS f, median(l_quantity) AS v FROM lineitem GROUP BY ALL),
j AS (SELECT a.v AS x, b.v AS y FROM m a JOIN m b USING (l_partkey) WHERE a.f = 'R' AND b.f = 'N'),
r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS a, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS b FROM j)
SELECT count(*) AS n, round(corr(a, b), 6) AS spearman FROM r"""


QUERIES = {
    "library_report": (report, REPORT), "source_agreement": (agreement, AGREEMENT),
    "neighbour_metrics": (neighbours, NEIGHBOURS), "frechet_distance": (frechet, None), "kernel_discrepancy": (discrepancy, None),
    "identity_clusters": (clusters, None), "best_local_hits": (best_hits, None), "head_report": (head_report, None), "head_scores": (head_scores, None),
}
