"""Queries over pools, weights and model inputs."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parsing, scales
from ..functions import sequences as seq
from ..operators import assays, cleaning, learning, scoring
from ..session import table
from .sequence_queries import SEQS, parts


def encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parts(spark, sf_dir).select("id", "s", (F.col("id") % 4).alias("a"), (F.col("id") % 3).alias("b"))
    tokens = seq.with_controls(F.col("s"), [F.col("a"), F.col("b")], [30, 40], 21, 22)
    return rows.select("id", F.array_join(seq.codes(F.col("s")).cast("array<string>"), ",").alias("codes"), F.array_join(tokens.cast("array<string>"), ",").alias("tokens"))


ENCODED = f"""WITH {SEQS}, coded AS (SELECT id, string_agg(CAST(strpos('{scales.ALPHABET}', c) - 1 AS VARCHAR), ',' ORDER BY i) AS codes FROM chars GROUP BY id)
SELECT id, codes, '21,' || (30 + id % 4) || ',' || (40 + id % 3) || ',' || codes || ',22' AS tokens FROM coded"""


def antilogs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.round(parsing.antilog(F.col("s_acctbal").cast("double") / 5000), 9).alias("value"))


ANTILOGS = "SELECT s_suppkey, round(pow(10, CAST(s_acctbal AS DOUBLE) / 5000), 9) AS value FROM supplier"


def weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    subjects, measured = table(spark, sf_dir, "part").select("p_partkey"), table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.col("l_quantity").cast("double").alias("quantity"))
    return assays.potent_weights(subjects, measured, "p_partkey", "quantity", 25.0)


WEIGHTS = """WITH potent AS (SELECT l_partkey FROM lineitem GROUP BY l_partkey HAVING median(CAST(l_quantity AS DOUBLE)) <= 25)
SELECT p_partkey, CASE WHEN p_partkey IN (SELECT l_partkey FROM potent) THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM part"""


def top_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy("l_linenumber", (F.col("l_orderkey") % 5).alias("bin")).agg(F.count("*").cast("double").alias("weight"))
    found = scoring.top_share(rows, ["l_linenumber", "bin"])
    return found.select(*[F.round(c, 9).alias(c) for c in found.columns])


TOP_SHARES = """SELECT round(sum((l_linenumber = (SELECT max(l_linenumber) FROM lineitem))::INT) / count(*), 9) AS l_linenumber,
  round(sum((l_orderkey % 5 = (SELECT max(l_orderkey % 5) FROM lineitem))::INT) / count(*), 9) AS bin FROM lineitem"""


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [table(spark, sf_dir, t).select(F.col(c).alias("name")) for t, c in (("part", "p_name"), ("nation", "n_name"), ("region", "r_name"), ("part", "p_type"))]
    return cleaning.pooled(names, "name", F.length("name").between(4, 40))


POOL = """SELECT name, CAST(min(source) AS INTEGER) AS source FROM (SELECT upper(trim(p_name)) AS name, 0 AS source FROM part UNION ALL SELECT upper(trim(n_name)), 1 FROM nation
  UNION ALL SELECT upper(trim(r_name)), 2 FROM region UNION ALL SELECT upper(trim(p_type)), 3 FROM part) WHERE length(name) BETWEEN 4 AND 40 GROUP BY name"""


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderpriority").alias("cluster"))
    return assays.with_cluster(table(spark, sf_dir, "customer").select("c_custkey"), placed, "c_custkey")


CLUSTERS = """SELECT c_custkey, coalesce(p, 'own:' || c_custkey) AS cluster FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderpriority) AS p FROM orders GROUP BY 1) ON o_custkey = c_custkey"""


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.round(learning.cosine_rate(F.col("s_suppkey"), 80, 0.01, 7), 12).alias("rate"))


RATES = f"""SELECT s_suppkey, round(CASE WHEN s_suppkey < 7 THEN 0.01::DOUBLE * s_suppkey / 7 ELSE 0.01::DOUBLE * 0.5 * (1 + cos({math.pi!r} * least(1.0::DOUBLE, (s_suppkey - 7)::DOUBLE / 73))) END, 12) AS rate FROM supplier"""


def least_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    entry = F.struct(F.col("l_linenumber").alias("line"), F.col("l_quantity").cast("double").alias("value"), F.col("l_returnflag").alias("flag"))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(entry)).alias("entries")).withColumn("least", assays.least_with_flag("entries", "value", "flag"))
    return rows.select("l_orderkey", "least.value", "least.flag")


LEAST_VALUES = """SELECT l_orderkey, CAST(l_quantity AS DOUBLE) AS value, l_returnflag AS flag FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY CAST(l_quantity AS DOUBLE), l_linenumber, l_returnflag) = 1"""

QUERIES = {
    "encoded_sequences": (encoded, ENCODED), "antilog_values": (antilogs, ANTILOGS), "potent_weights": (weights, WEIGHTS), "top_shares": (top_shares, TOP_SHARES), "multi_source_pool": (pool, POOL),
    "cluster_lookup": (clusters, CLUSTERS), "cosine_rates": (rates, RATES), "least_with_flag": (least_values, LEAST_VALUES),
}
