"""Queries written in SQL over the registered functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions import registered, scales
from ..session import table
from .sequence_queries import SKETCHES


def _views(spark: SparkSession, sf_dir: str) -> None:
    registered.register(spark)
    table(spark, sf_dir, "part").createOrReplaceTempView("sievework_part")


def gram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lateral join with the table function: how often each gram of five letters occurs, and in how many types.

    Rows alike in name and type are counted before their grams are made, which also deals them to all cores.
    """
    _views(spark, sf_dir)
    return spark.sql("""
        WITH alike AS (SELECT p_name, p_type, count(*) AS times FROM sievework_part GROUP BY p_name, p_type)
        SELECT g.gram, sum(p.times) AS n, count(DISTINCT p.p_type) AS types, min(g.place) AS first
        FROM alike p, LATERAL grams(p.p_name, 5) g GROUP BY g.gram""")


GRAM_COUNTS = """WITH cut AS (SELECT p_type, i AS place, substr(p_name, i, 5) AS gram FROM (SELECT p_name, p_type, unnest(range(1, length(p_name) - 3)) AS i FROM part))
SELECT gram, count(*) AS n, count(DISTINCT p_type) AS types, CAST(min(place) AS INTEGER) AS first FROM cut GROUP BY gram"""


def sketch_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by the sketch of their sequence."""
    _views(spark, sf_dir)
    return spark.sql(f"""
        WITH seqs AS (SELECT p_partkey, regexp_replace(upper(concat(p_name, p_type, p_brand)), '[^{scales.ALPHABET}]', '') AS s FROM sievework_part)
        SELECT sketch_key(s) AS cluster, count(*) AS n, min(p_partkey) AS first FROM seqs GROUP BY sketch_key(s) HAVING count(*) > 1""")


SKETCH_GROUPS = f"SELECT cluster, count(*) AS n, min(id) AS first FROM ({SKETCHES}) GROUP BY cluster HAVING count(*) > 1"


def alike_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that begin with the same word, by how alike they are."""
    _views(spark, sf_dir)
    return spark.sql("""
        WITH names AS (SELECT DISTINCT p_name AS s, split_part(p_name, ' ', 1) AS word FROM sievework_part),
        scored AS (SELECT a.s AS a, b.s AS b, indel_ratio(a.s, b.s) AS ratio FROM names a JOIN names b ON a.word = b.word AND a.s < b.s)
        SELECT a, b, round(ratio, 6) AS ratio FROM scored WHERE ratio > 0.6""")


ALIKE_NAMES = """WITH RECURSIVE names AS (SELECT DISTINCT p_name AS s, split_part(p_name, ' ', 1) AS word FROM part),
pairs AS (SELECT a.s AS a, b.s AS b FROM names a JOIN names b ON a.word = b.word AND a.s < b.s),
walk AS (
  SELECT a, b, 0 AS i, list_transform(range(0, length(b) + 1), lambda x: 0::BIGINT) AS line FROM pairs
  UNION ALL
  SELECT a, b, i + 1, list_reduce(list_concat([[0::BIGINT]], list_transform(range(1, length(b) + 1), lambda j: [
      greatest(line[j + 1], CASE WHEN substr(a, i + 1, 1) = substr(b, j, 1) THEN line[j] + 1 ELSE 0 END)])),
      lambda t, x: list_append(t, greatest(t[len(t)], x[1])))
  FROM walk WHERE i < length(a))
SELECT a, b, round(2 * line[len(line)] / (length(a) + length(b)), 6) AS ratio FROM walk WHERE i = length(a) AND 2 * line[len(line)] / (length(a) + length(b)) > 0.6"""

QUERIES = {"sql_gram_counts": (gram_counts, GRAM_COUNTS), "sql_sketch_groups": (sketch_groups, SKETCH_GROUPS), "sql_alike_names": (alike_names, ALIKE_NAMES)}
