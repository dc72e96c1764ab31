"""Mixing sources to target weights: hash order, distributed prefix sums, exact cuts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, table


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weights: Sequence[int] = (5, 2, 1),
    share: float = 1.5,
    epochs: int = 2,
    seed: str = "mix",
    digits: int = 3,
    carry: Sequence[str] = (),
) -> DataFrame:
    """How many words of each document a mix of ``share`` times all words takes.

    Sources in code-point order, null last, weigh ``weights`` in turn. Targets go by
    weight; none exceeds ``epochs`` times its source's size, and what is above goes to
    the others by weight (one pass of water filling over the sorted ratios). A source
    whose target is above its size repeats whole epochs; the rest is cut out of one
    hash-random order at exactly the budget, the last document in part.

    The order is the MD5 of seed, id and text. Its first ``digits`` hex digits are the
    ranges of a distributed range sort: word counts are summed per source and range,
    the few range sums of a source are prefix-summed, and only within a range are
    documents sorted. A hot source is thus spread over 16 ** digits ranges.

    Returns a row per input row: id, source, size, source_size, target, taken, and the
    columns named in ``carry`` inside the struct ``carried``, where no name can clash.
    Null and empty texts have size 0 and take 0; null ids and sources are values like
    others; rows alike in id and text take the cut in either order, which gives the same
    rows; an empty table gives none.
    """
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("")).alias("source_key"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col), F.lit("")))).alias("hash"),
        F.struct(*[F.col(c) for c in carry] or [F.lit(None).alias("none")]).alias("carried"),
    ).withColumn("range", F.substring("hash", 1, digits))

    ranges = rows.groupBy("source", "source_key", "range").agg(F.sum("size").alias("range_size"))
    sources = ranges.groupBy("source", "source_key").agg(F.sum("range_size").alias("source_size"))
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", "source_key")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    targets = (
        sources.withColumn("weight", weight)
        .withColumn("cap", F.lit(epochs) * F.col("source_size"))
        .withColumn("ratio", F.col("cap").cast("double") / F.col("weight"))
        .withColumn("capped", F.sum("cap").over(by_ratio) - F.col("cap"))
        .withColumn("open", F.sum("weight").over(everything) - F.sum("weight").over(by_ratio) + F.col("weight"))
        .withColumn("level", (F.lit(share) * F.sum("source_size").over(everything) - F.col("capped")) / F.col("open"))
        .withColumn("level_at_end", F.max(F.when(F.col("ratio") > F.col("level"), F.col("level"))).over(everything))
        .withColumn("target", F.when(F.col("ratio") > F.col("level"), F.col("weight") * F.col("level_at_end")).otherwise(F.col("cap").cast("double")))
        .select("source_key", "source_size", "target")
    )
    in_source = Window.partitionBy("source_key").orderBy("range")
    in_range = Window.partitionBy("source_key", "range").orderBy("hash")
    starts = ranges.withColumn("range_start", F.sum("range_size").over(in_source) - F.col("range_size")).drop("source", "range_size").join(targets, "source_key")
    budget = F.round("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    start = F.col("range_start") + F.sum("size").over(in_range.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    return (
        rows.join(starts, ["source_key", "range"])
        .withColumn("start", start)
        .withColumn("whole", whole)
        .withColumn("rest", budget - F.col("whole") * F.col("source_size"))
        .select(
            F.col("id").alias(id_col),
            F.col("source").alias("source"),
            "size",
            "source_size",
            "target",
            (F.col("whole") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("start")))).alias("taken"),
            "carried",
        )
    )


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP8_SQL = r"""
WITH rows AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS hash
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [5, 2, 1][CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS BIGINT)] AS weight
  FROM rows GROUP BY source),
ratios AS (
  SELECT *, 2 * source_size AS cap, CAST(2 * source_size AS DOUBLE) / weight AS ratio FROM sources),
levels AS (
  SELECT *, (1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE)
     - CAST(sum(cap) OVER (ORDER BY ratio, source NULLS FIRST ROWS UNBOUNDED PRECEDING) - cap AS DOUBLE))
     / CAST(sum(weight) OVER () - sum(weight) OVER (ORDER BY ratio, source NULLS FIRST ROWS UNBOUNDED PRECEDING) + weight AS DOUBLE) AS level
  FROM ratios),
targets AS (
  SELECT source, source_size,
         CASE WHEN ratio > level THEN weight * max(CASE WHEN ratio > level THEN level END) OVER () ELSE CAST(cap AS DOUBLE) END AS target
  FROM levels),
ordered AS (
  SELECT r.doc_id, r.size, t.source_size, t.target,
         CAST(sum(r.size) OVER (PARTITION BY r.source ORDER BY r.hash ROWS UNBOUNDED PRECEDING) - r.size AS BIGINT) AS start,
         CAST(round(t.target) AS BIGINT) AS budget
  FROM rows r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source),
cut AS (
  SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS whole FROM ordered)
SELECT doc_id, size, source_size, target,
       CAST(whole * size + greatest(0, least(size, budget - whole * source_size - start)) AS BIGINT) AS taken
FROM cut
"""
