"""K-means within cells, grouped folds and boosted-tree ensembles."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..session import kept, written
from .cleaning import hashed_part


CHUNK = 4096  # members of a cell that meet its centroids in one group


def _tallied(batches: Iterator[pa.RecordBatch], cell_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """(cell, start, sub, sum, n, cost) of each group's members by nearest centroid; a group's centroids come first, then its members stream past."""
    key, books, sums = None, {}, {}

    def flush() -> Iterator[pa.RecordBatch]:
        if sums:
            rows = [(key[0], *at, list(total), n, cost) for at, (total, n, cost) in sums.items()]
            kinds = [cell_type, pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["cell", "start", "sub", "sum", "n", "cost"])

    for batch in batches:
        groups = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        starts = batch.column(2).to_pylist()
        edges = [0, *[i for i in range(1, len(groups)) if groups[i] != groups[i - 1] or (starts[i] is None) != (starts[i - 1] is None)], len(groups)]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            vectors = batch.column(4).slice(lo, hi - lo).flatten().to_numpy(zero_copy_only=False).reshape(hi - lo, -1)
            if groups[lo] != key:
                yield from flush()
                key, books, sums = groups[lo], {}, {}
            if starts[lo] is not None:
                for i, (start, sub) in enumerate(zip(starts[lo:hi], batch.column(3).to_pylist()[lo:hi], strict=True)):
                    books.setdefault(start, {})[sub] = vectors[i]
                continue
            for start, book in books.items():
                subs = np.array(sorted(book))
                far = np.stack([((vectors - book[j]) ** 2).sum(axis=1) for j in subs], axis=1)
                nearest = far.argmin(axis=1)
                for j in np.unique(nearest):
                    mine = nearest == j
                    total, n, cost = sums.get((start, int(subs[j])), (0.0, 0, 0.0))
                    sums[start, int(subs[j])] = (total + vectors[mine].sum(axis=0), n + int(mine.sum()), cost + float(far[mine, j].sum()))
    yield from flush()


def cell_centroids(members: DataFrame, cell: str, vector: str, cell_quotas: DataFrame, *, row_id: str = "row_id", per_cluster: int = 40, most: int = 12, starts: int = 3, steps: int = 20, seed: int = 0) -> DataFrame:
    """(cell, sub, centroid, n) of each cell's reference members, by k-means with k from the quota; cells with k of 1 have none.

    A cell has quota div ``per_cluster`` clusters, at most ``most`` and its members. Each of ``starts`` runs
    begins at the members first in a hashed order, so reruns agree; the run of the least summed distance is taken.
    A step of all runs of all cells is one aggregation by (cell, run, cluster): members go in
    groups of about ``CHUNK`` past their cell's centroids, each group returns sums, and these are
    added up. So no task holds a cell, whatever its share of the rows; nothing is
    broadcast, and the driver gets one number a step. An empty cluster keeps its centroid. Runs end after ``steps``, or once nothing moves.
    """
    kind = members.schema[cell].dataType
    rows = members.select(F.col(cell).alias("cell"), F.col(row_id).cast("string").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    wanted = cell_quotas.select(F.col(cell).alias("of"), "quota")
    sizes = rows.groupBy(F.col("cell").alias("of")).agg(F.count("*").alias("members")).join(wanted, "of")
    clusters = F.least(F.lit(most), F.greatest(F.lit(1), F.floor(F.col("quota") / per_cluster)), F.col("members")).cast("int")
    sizes = kept(sizes.select("of", clusters.alias("k"), F.ceil(F.col("members") / CHUNK).cast("int").alias("chunks")).where("quota > 0 and k > 1"))
    dealt = kept(rows.join(sizes, F.col("cell") == F.col("of")).withColumn("chunk", F.pmod(F.xxhash64("id"), "chunks").cast("int")))
    runs = dealt.withColumn("start", F.explode(F.array(*map(F.lit, range(starts))))).withColumn("hash", F.md5(F.concat(F.lit(f"{seed}:"), "start", F.lit(":"), "id")))
    nth = F.row_number().over(Window.partitionBy("cell", "start").orderBy("hash", "id"))
    first = runs.withColumn("nth", nth).where(F.col("nth") <= most).where("nth <= k")
    centroids = written(first.select("cell", "start", (F.col("nth") - 1).alias("sub"), F.col("vector").alias("centroid"), F.lit(0).cast("bigint").alias("n"), F.lit(0.0).alias("cost")))
    partitions = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = T.StructType([T.StructField("cell", kind)]).simpleString()[7:-1].replace(":", " ", 1)
    passing = dealt.select("cell", "chunk", F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("sub"), "vector")
    arrow = to_arrow_type(kind)
    for _ in range(steps + 1):
        copies = centroids.join(sizes, F.col("cell") == F.col("of")).select("cell", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "start", "sub", F.col("centroid").alias("vector"))
        groups = copies.unionByName(passing).repartition(partitions, "cell", "chunk").sortWithinPartitions("cell", "chunk", F.col("start").asc_nulls_last())
        tallies = groups.mapInArrow(lambda it: _tallied(it, arrow), f"{named}, start int, sub int, sum array<double>, n bigint, cost double")
        summed = tallies.groupBy("cell", "start", "sub").agg(Summarizer.sum(array_to_vector("sum")).alias("sum"), F.sum("n").alias("n"), F.sum("cost").alias("cost"))
        joined = centroids.select("cell", "start", "sub", F.col("centroid").alias("before")).join(summed.select("cell", "start", "sub", vector_to_array("sum").alias("sum"), "n", "cost"), ["cell", "start", "sub"], "left")
        fresh = F.coalesce(F.transform("sum", lambda x: x / F.col("n")), F.col("before"))
        found = written(joined.select("cell", "start", "sub", "before", fresh.alias("centroid"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("cost", F.lit(0.0)).alias("cost")))
        centroids = found.drop("before")
        if found.where(F.exists(F.zip_with("before", "centroid", lambda x, y: F.abs(x - y) > 1e-12 * (1 + F.abs(x))), lambda moved: moved)).isEmpty():
            break
    best = found.groupBy("cell", "start").agg(F.sum("cost").alias("cost")).groupBy(F.col("cell").alias("of")).agg(F.min(F.struct("cost", "start")).alias("best"))
    # the counts are of the assignment to the centroids before the step
    chosen = found.join(best, (F.col("cell") == F.col("of")) & (F.col("start") == F.col("best.start")))
    return chosen.select(F.col("cell").alias(cell), "sub", F.col("before").alias("centroid"), "n")


def grouped_folds(df: DataFrame, group: str, folds: int = 5, seed: int = 0) -> DataFrame:
    """Adds ``fold``, the same for all rows of a group."""
    return df.withColumn("fold", hashed_part(F.col(group), folds, seed))


def out_of_fold(df: DataFrame, features: list[str], target: str, *, weight: str | None = None, classify: bool = False, folds: int = 5, depth: int = 5, rounds: int = 20) -> DataFrame:
    """Adds ``guess``: each row's prediction by boosted trees that were fitted without its fold (column ``fold``)."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.regression import GBTRegressor

    data = VectorAssembler(inputCols=features, outputCol="__x", handleInvalid="keep").transform(df)
    out = None
    for f in range(folds):
        make = GBTClassifier if classify else GBTRegressor
        model = make(featuresCol="__x", labelCol=target, maxDepth=depth, maxIter=rounds, seed=f)
        if weight:
            model = model.setWeightCol(weight)
        found = model.fit(data.where(F.col("fold") != f)).transform(data.where(F.col("fold") == f))
        found = found.withColumn("guess", vector_to_array("probability")[1] if classify else F.col("prediction")).select(*df.columns, "guess")
        out = found if out is None else out.unionByName(found)
    return out


def cosine_rate(step: Column, total: int, base: float, warmup: int) -> Column:
    """A learning rate that rises in a line over ``warmup`` steps and falls to 0 along a half cosine at ``total``."""
    done = F.least(F.lit(1.0), (step - warmup) / max(1, total - warmup))
    return F.when(step < warmup, base * step / max(1, warmup)).otherwise(base * 0.5 * (1 + F.cos(math.pi * done)))
