"""Ranks and their uses; ties go by id, unlike in ntile and percent_rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import kept


def running(df: DataFrame, groups: list[str], order: list[Column], out: str, *, weight: str | None = None) -> DataFrame:
    """Adds ``out``, each row's place from 1 within its group by ``order``, or the running sum of ``weight`` up to it.

    No task holds a whole group: rows are range-partitioned by group and order and kept so,
    summed up within their range, and ranges that go on with a group of an earlier one get
    what came before. There is at most one such group in a range, so the table that is
    broadcast has fewer rows than there are ranges. Rows that ``order`` can't tell apart share a range and come in any order.
    """
    part = "__part"
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = kept(df.repartitionByRange(ranges, *[F.col(g) for g in groups], *order).withColumn(part, F.spark_partition_id()))
    inside = Window.partitionBy(part, *groups).orderBy(*order)
    step, total = (F.row_number().over(inside), F.count("*")) if weight is None else (F.sum(weight).over(inside.rowsBetween(Window.unboundedPreceding, 0)), F.sum(weight))
    names = {g: f"__group{i}" for i, g in enumerate(groups)}
    sums = spread.groupBy(F.col(part).alias("__of"), *[F.col(g).alias(n) for g, n in names.items()]).agg(total.alias("__sum"), F.count("*").alias("__rows"))
    earlier = Window.partitionBy(*names.values()).orderBy("__of").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("__of", *names.values(), F.sum("__sum").over(earlier).alias("__before")).where("__before is not null")
    met = F.col(part) == F.col("__of")
    for g, n in names.items():
        met &= F.col(g).eqNullSafe(F.col(n))
    found = spread.withColumn(out, step).join(F.broadcast(before), met, "left")
    return found.withColumn(out, F.col(out) + F.coalesce("__before", F.lit(0))).select(*[c for c in df.columns if c != out], out)


def with_rank(df: DataFrame, value: str, row_id: str) -> DataFrame:
    """Adds ``rank0``, from 0 by value and id, and ``n_rows``."""
    placed = running(df, [], [F.col(value).asc(), F.col(row_id).asc()], "rank0")
    return placed.withColumn("rank0", F.col("rank0") - 1).withColumn("n_rows", F.lit(df.count()))


def quantile_bin(df: DataFrame, value: str, row_id: str, bins: int) -> DataFrame:
    """Adds ``bin``: rank0 * bins div n, at most bins - 1."""
    return with_rank(df, value, row_id).withColumn("bin", F.least(F.floor(F.col("rank0") * bins / F.col("n_rows")), F.lit(bins - 1)).cast("int")).drop("rank0", "n_rows")


def rank_pct(df: DataFrame, value: str, row_id: str, out: str = "pct") -> DataFrame:
    """Adds rank0 / (n - 1), 0 for a single row."""
    return with_rank(df, value, row_id).withColumn(out, F.col("rank0") / F.greatest(F.col("n_rows") - 1, F.lit(1))).drop("rank0", "n_rows")


def rank_blend(df: DataFrame, first: str, second: str, row_id: str, weight: float, penalty: float) -> DataFrame:
    """Adds ``blend`` of two scores by rank, less for disagreement."""
    both = rank_pct(rank_pct(df, first, row_id, "pct_a"), second, row_id, "pct_b")
    return both.withColumn("blend", (1 - weight) * F.col("pct_a") + weight * F.col("pct_b") - penalty * F.abs(F.col("pct_a") - F.col("pct_b")))


def quantile_map(df: DataFrame, value: str, onto: str, row_id: str) -> DataFrame:
    """Adds ``mapped``: the i-th smallest ``value`` gets the i-th smallest ``onto``."""
    target = with_rank(df.select(F.col(onto).alias("mapped"), F.col(row_id).alias("other")), "mapped", "other").select("rank0", "mapped")
    return with_rank(df, value, row_id).join(target, "rank0").drop("rank0", "n_rows")


def best_of_each(df: DataFrame, cell: str, quality: str, row_id: str, budget: Column) -> DataFrame:
    """The best rows of each cell by quality, then id, up to its budget."""
    return running(df, [cell], [F.desc(quality), F.col(row_id)], "nth").where(F.col("nth") <= budget).drop("nth")


def shortlist(df: DataFrame, cell: str, quality: str, row_id: str, shares: DataFrame, cap: int, least: int = 40) -> DataFrame:
    """The best rows of each cell: int(cap * share) of them, and ``least`` even where the share is small or none.

    ``shares`` has a row (cell, share) for each cell of the reference.
    """
    joined = df.join(shares, cell, "left")
    budget = F.greatest(F.floor(F.lit(cap) * F.coalesce("share", F.lit(0.0))), F.lit(least))
    return best_of_each(joined, cell, quality, row_id, budget).drop("share")


def union_of_best(df: DataFrame, objectives: list[str], row_id: str, n: int) -> DataFrame:
    """The ids that are among the ``n`` best of any objective."""
    tops = [df.orderBy(F.desc(o), row_id).limit(n).select(row_id) for o in objectives]
    out = tops[0]
    for top in tops[1:]:
        out = out.union(top)
    return out.distinct()
