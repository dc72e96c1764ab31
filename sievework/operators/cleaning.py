"""Cleaning, set operations and splits; every ordering ends in the row's id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import kept
from .ranking import running


def first_of_each(df: DataFrame, key: str, row_id: str) -> DataFrame:
    """Of the rows with one key the one with the smallest id, as struct minima that are combined before the shuffle."""
    others = [c for c in df.columns if c not in (key, row_id)]
    return df.groupBy(key).agg(F.min_by(F.struct(row_id, *others), F.col(row_id)).alias("first")).select(key, "first.*").select(*df.columns)


def minus(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """The rows whose key isn't in ``other``, as often as they occur."""
    return df.join(other.select(key), key, "left_anti")


def within(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """The rows whose key is in ``other``."""
    return df.join(other.select(key), key, "left_semi")


def hashed_part(key: Column, parts: int, seed: int = 0) -> Column:
    """A part number from 0 that depends on the key and the seed alone: folds by group, splits, samples."""
    return F.pmod(F.crc32(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary")), F.lit(parts)).cast("int")


def hashed_sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """At most ``n`` rows, those first in a hashed order."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n)


def weighted_draws(df: DataFrame, weight: str, key: str, draws: DataFrame, at: str) -> DataFrame:
    """For each draw (a number in [0, 1) in column ``at``) the row whose stretch of the summed weights holds it.

    Choices of no weight are never drawn. Both tables may be of any size: weights are summed
    up by ranges, and the choices' lower ends and the draws are merged in ranges of one order, where
    a draw belongs to the last end before it; a range without one goes on with the last of
    the ranges before, one row for each range.
    """
    some = df.where(F.col(weight) > 0)
    total = some.agg(F.sum(weight)).first()[0]
    if total is None:
        return draws.limit(0).join(df.limit(0), F.lit(True))
    ends = running(some.select(key, weight, F.struct(*df.columns).alias("choice")), [], [F.col(key)], "upto", weight=weight)
    place = F.col("upto") / F.lit(total) - F.col(weight) / F.lit(total)
    lower = ends.select(place.cast("double").alias("place"), F.lit(0).alias("kind"), key, "choice", F.lit(None).cast(draws.select(F.struct(*draws.columns)).schema[0].dataType).alias("draw"))
    asked = draws.select(F.col(at).cast("double").alias("place"), F.lit(1).alias("kind"), F.lit(None).cast(df.schema[key].dataType).alias(key), F.lit(None).cast(lower.schema["choice"].dataType).alias("choice"), F.struct(*draws.columns).alias("draw"))
    order = ["place", "kind", key]
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    merged = kept(lower.unionByName(asked.where("place >= 0 and place < 1")).repartitionByRange(ranges, *order).withColumn("__part", F.spark_partition_id()))
    last = merged.where("kind = 0").groupBy("__part").agg(F.max_by("choice", F.struct("place", key)).alias("ended")).withColumnRenamed("__part", "__of")
    parts = merged.select(F.col("__part").alias("__of")).distinct().join(last, "__of", "left")
    earlier = Window.orderBy("__of").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select("__of", F.last("ended", ignorenulls=True).over(earlier).alias("carried"))
    inside = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    met = merged.withColumn("own", F.last("choice", ignorenulls=True).over(inside)).where("kind = 1").join(F.broadcast(carried), F.col("__part") == F.col("__of"))
    return met.select(F.col("draw.*"), F.coalesce("own", "carried").alias("choice")).select(*draws.columns, "choice.*")


def pooled(sources: list[DataFrame], column: str, keep: Column) -> DataFrame:
    """The distinct values of ``column`` in all sources, upper-cased and trimmed, for which ``keep`` holds, with the number of the first source that has each."""
    parts = [df.select(F.upper(F.trim(column)).alias(column), F.lit(i).alias("source")) for i, df in enumerate(sources)]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.where(keep).groupBy(column).agg(F.min("source").alias("source"))
