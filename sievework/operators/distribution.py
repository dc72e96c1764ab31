"""How alike two sets of vectors are: nearest neighbours, Fréchet distance and kernel discrepancy, without all pairs."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import kept, written

CELL, PIVOTS = 256, 1024  # vectors of a cell on average; most pivots, so most vectors of which the driver gets one each
CHUNK = 16384  # vectors of a bin of cells that a group holds
PAIRS = 1 << 22  # whose rough distances are held at once
SLACK = 1e-9  # relative, for rounding in the bounds that choose cells; distances themselves are compared as they are


def matrix(column: pa.ListArray) -> np.ndarray:
    """A row for each vector."""
    return column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(column), -1)


def between(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances (a x b), the same for a pair whichever side it is on."""
    out = np.empty((len(a), len(b)))
    step = max(1, (1 << 20) // max(1, b.size))
    for at in range(0, len(a), step):
        gap = a[at : at + step, None] - b[None]
        out[at : at + step] = np.sqrt((gap * gap).sum(axis=2))
    return out


def squares(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, float]:
    """(squared distances (a x b) from one matrix product, how far off they may be): for choosing what is compared exactly."""
    own, other = (a * a).sum(axis=1), (b * b).sum(axis=1)
    out = a @ b.T
    out *= -2
    out += own[:, None]
    out += other
    return out, 1e-14 * (8 + a.shape[1]) * float(own.max(initial=0) + other.max(initial=0))


def roughly(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, float]:
    """(distances (a x b), how far off they may be)."""
    out, off = squares(a, b)
    return np.sqrt(np.maximum(out, 0)), math.sqrt(off)


def exactly(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The distances of a[i] and b[j], as ``between`` has them."""
    out, step = np.empty(len(i)), max(1, (1 << 20) // max(1, a.shape[1]))
    for at in range(0, len(i), step):
        gap = a[i[at : at + step]] - b[j[at : at + step]]
        out[at : at + step] = np.sqrt((gap * gap).sum(axis=1))
    return out


@dataclass
class Bounds:
    """By cell its pivot, radius, number of vectors, largest ball and bin; by bin the groups it is cut into: what tasks need to choose bins."""

    pivots: np.ndarray
    radius: np.ndarray
    count: np.ndarray
    ball: np.ndarray
    bin: np.ndarray
    chunks: np.ndarray


@dataclass
class Cells:
    """Vectors by nearest pivot, as rows (bin, chunk, id, vector, ball)."""

    rows: DataFrame
    bounds: Bounds


def cells(df: DataFrame) -> Cells:
    """Of rows (id, vector, ball); ``ball`` may be null. Pivots are the vectors with the smallest hashes.

    Cells are gathered in bins of some ``CHUNK`` vectors, about the first pivots: where pivots prune little, a query
    goes to a bin once, not to each of its cells.
    """
    n = df.count()
    picked = df.select("vector").distinct().orderBy(F.xxhash64("vector"), "vector").limit(max(1, min(PIVOTS, n // CELL))).collect()
    pivots = np.array([r.vector for r in picked], float)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = matrix(batch.column(1))
            home = squares(vectors, pivots)[0].argmin(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(home), pa.array(exactly(vectors, pivots, np.arange(len(home)), home)), *batch.columns], names=["cell", "away", "id", "vector", "ball"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select("id", "vector", "ball").schema.fields)
    near = kept(df.select("id", "vector", "ball").mapInArrow(placed, f"cell bigint, away double, {kinds}"))
    radius, count, ball = (np.zeros(len(pivots)) for _ in range(3))
    for r in near.groupBy("cell").agg(F.max("away").alias("radius"), F.count("*").alias("n"), F.coalesce(F.max("ball"), F.lit(0.0)).alias("ball")).collect():
        radius[r.cell], count[r.cell], ball[r.cell] = r.radius, r.n, r.ball
    bins = squares(pivots, pivots[: max(1, math.ceil(n / CHUNK))])[0].argmin(axis=1) if len(pivots) else np.zeros(0, np.int64)
    chunks = np.maximum(1, np.ceil(np.bincount(bins, weights=count, minlength=1) / CHUNK)).astype(int)
    of = lambda values: F.element_at(F.array(*[F.lit(int(v)) for v in values]), (F.col("cell") + 1).cast("int")) if len(pivots) else F.lit(1)
    placed_in = near.select(of(bins).alias("bin"), F.pmod(F.xxhash64("id", "vector"), of(chunks[bins])).cast("int").alias("chunk"), "id", "vector", "ball")
    return Cells(placed_in, Bounds(pivots, radius, count, ball, bins, chunks))


Rule = Callable[[np.ndarray, np.ndarray, np.ndarray, float], np.ndarray]


def _bins(cells: np.ndarray, bounds: Bounds) -> np.ndarray:
    """Which bins (rows x bins) have a cell that is marked (rows x cells)."""
    kinds = np.eye(len(bounds.chunks), dtype=np.float32)[bounds.bin]
    return cells.astype(np.float32) @ kinds > 0


def _dealt(queries: DataFrame, found: Cells, rule: Rule, slices: int) -> DataFrame:
    """The queries (id, vector, bound, home) at each chunk of each bin that ``rule`` of (distances to pivots, bounds, home bins, how far off the distances may be) allows."""
    bounds = found.bounds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(at, 1024) for at in range(0, batch.num_rows, 1024)):
                away, off = roughly(matrix(part.column(1)), bounds.pivots)
                row, where = np.nonzero(rule(away, part.column(2).to_numpy(zero_copy_only=False).astype(float), part.column(3).to_numpy(zero_copy_only=False), off))
                for at in range(0, len(row), 4096):
                    copies = bounds.chunks[where[at : at + 4096]]
                    rows, bins = np.repeat(row[at : at + 4096], copies), np.repeat(where[at : at + 4096], copies)
                    nth = np.arange(len(rows)) - np.repeat(np.cumsum(copies) - copies, copies)
                    taken = part.take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays([pa.array(bins.astype(np.int32)), pa.array(nth.astype(np.int32)), *taken.columns[:3]], names=["bin", "chunk", "id", "vector", "bound"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in queries.select("id", "vector", "bound").schema.fields)
    dealt = queries.select("id", "vector", "bound", "home").mapInArrow(run, f"bin int, chunk int, {kinds}")
    return dealt.withColumn("slice", F.pmod(F.xxhash64("id"), F.lit(slices)).cast("int"))


def _groups(queries: DataFrame, found: Cells, rule: Rule) -> DataFrame:
    """(bin, chunk, slice, asks, id, vector, number) with each chunk's vectors before the queries that pass them.

    Where there are fewer chunks than tasks, queries are dealt in slices, and a chunk goes to each.
    """
    spark = queries.sparkSession
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    slices = math.ceil(2 * partitions / int(found.bounds.chunks.sum())) if found.bounds.count.sum() > CHUNK else 1
    asked = _dealt(queries, found, rule, slices).select("bin", "chunk", "slice", F.lit(True).alias("asks"), "id", "vector", F.col("bound").alias("number"))
    held = found.rows.withColumn("slice", F.explode(F.array(*map(F.lit, range(slices))))).select("bin", "chunk", "slice", F.lit(False).alias("asks"), "id", "vector", F.col("ball").alias("number"))
    return held.unionByName(asked).repartition(partitions, "bin", "chunk", "slice").sortWithinPartitions("bin", "chunk", "slice", "asks", "id")


class Held:
    """A group's vectors, which come before its queries."""

    def __init__(self, key: tuple) -> None:
        self.key, self.ids, self.parts, self.numbers = key, [], [], []

    def add(self, rows: pa.RecordBatch) -> None:
        self.ids += rows.column(4).to_pylist()
        self.parts.append(matrix(rows.column(5)))
        self.numbers.append(rows.column(6).to_numpy(zero_copy_only=False).astype(float))

    def ready(self) -> None:
        """Puts the parts together once all are there."""
        if self.parts is not None:
            self.vectors, self.balls = np.vstack(self.parts), np.concatenate(self.numbers)
            self.place, self.parts, self.numbers = {}, None, None
            for j, x in enumerate(self.ids):
                self.place.setdefault(x, []).append(j)

    def same(self, own: list) -> tuple[list[int], list[int]]:
        """(i, j) of the queries and the vectors that have one id."""
        met = [(i, j) for i, x in enumerate(own) for j in self.place.get(x, ())]
        return [i for i, _ in met], [j for _, j in met]


def _passing(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Held | None, pa.RecordBatch | None]]:
    """(group, its next queries), and (group, None) after its last ones; a group without vectors is passed over."""
    held = None
    for batch in batches:
        keys = np.stack([batch.column(i).cast(pa.int32()).to_numpy() for i in range(4)])
        edges = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            if lo == hi:
                continue
            key = tuple(keys[:3, lo].tolist())
            if held is None or held.key != key:
                if held is not None and held.ids:
                    held.ready()
                    yield held, None
                held = Held(key)
            if not keys[3, lo]:
                held.add(batch.slice(lo, hi - lo))
            elif held.ids:
                held.ready()
                step = max(1, PAIRS // len(held.ids))
                for at in range(lo, hi, step):
                    yield held, batch.slice(at, min(hi, at + step) - at)
    if held is not None and held.ids:
        held.ready()
        yield held, None


def _nearest(batches: Iterator[pa.RecordBatch], k: int, others: bool, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """(id, near) of each query: its ``k`` nearest of one chunk within its bound, as (distance, id).

    A matrix product finds those that may be among them, and only these are compared exactly.
    """
    for held, rows in _passing(batches):
        if rows is None:
            continue
        vectors, own = matrix(rows.column(5)), rows.column(4).to_pylist()
        away, off = squares(vectors, held.vectors)
        if others:
            away[held.same(own)] = np.inf
        bound = rows.column(6).to_numpy(zero_copy_only=False).astype(float) * (1 + SLACK) + SLACK
        most = np.where(np.isfinite(bound), bound * bound + off, np.finfo(float).max)
        met = away <= most[:, None]
        if met.sum() > 8 * k * len(own) and away.shape[1] > k:
            most = np.minimum(most, np.partition(away, k - 1, axis=1)[:, k - 1] + 2 * off)
            met = away <= most[:, None]
        i, j = np.nonzero(met & np.isfinite(away))
        exact = exactly(vectors, held.vectors, i, j)
        order = np.lexsort((j, exact, i))
        i, j, exact = i[order], j[order], exact[order]
        n = np.bincount(i, minlength=len(own))
        good = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) < k
        offsets = np.concatenate([[0], np.cumsum(np.minimum(n, k))]).astype(np.int32)
        near = pa.StructArray.from_arrays([pa.array(exact[good]), pa.array([held.ids[x] for x in j[good].tolist()], kind)], names=["distance", "id"])
        yield pa.RecordBatch.from_arrays([rows.column(4), pa.ListArray.from_arrays(pa.array(offsets), near)], names=["id", "near"])


def nearest(queries: DataFrame, data: Cells, k: int, *, others: bool = False) -> DataFrame:
    """(id, near): each query's ``k`` nearest vectors, near first, as (distance, id); with ``others``, none of its own id.

    Exact, for queries (id, vector) of unique ids. The pivots alone bound how far the k-th can be (a cell
    whose whole radius is nearer counts with all its vectors); the home bin shrinks
    that bound, and then a query goes to the bins of the cells that still reach within it. Bins are joined independently, in
    groups of about ``CHUNK`` vectors past which queries stream. On vectors that no pivots tell apart each
    query meets all others, in products of matrices.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    bounds, need, kind = data.bounds, k + others, to_arrow_type(data.rows.schema["id"].dataType)
    names = f"id {queries.schema['id'].dataType.simpleString()}, near array<struct<distance: double, id: {data.rows.schema['id'].dataType.simpleString()}>>"

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            away, off = roughly(matrix(batch.column(1)), bounds.pivots)
            reach = away + bounds.radius + off
            order = np.argsort(reach, axis=1)
            enough = np.cumsum(bounds.count[order], axis=1) >= need
            bound = np.where(enough.any(axis=1), np.take_along_axis(reach, order, axis=1)[np.arange(len(order)), enough.argmax(axis=1)], np.inf)
            home = bounds.bin[np.where(bounds.count > 0, away, np.inf).argmin(axis=1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bound), pa.array(home.astype(np.int32))], names=["id", "vector", "bound", "home"])

    def merged(found: DataFrame) -> DataFrame:
        return found.groupBy("id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"))

    def at_home(away: np.ndarray, bound: np.ndarray, home: np.ndarray, off: float) -> np.ndarray:
        return np.arange(len(bounds.chunks)) == home[:, None]

    def beyond(away: np.ndarray, bound: np.ndarray, home: np.ndarray, off: float) -> np.ndarray:
        return ~at_home(away, bound, home, off) & _bins((away - off - bounds.radius <= bound[:, None] * (1 + SLACK) + SLACK) & (bounds.count > 0), bounds)

    searched = lambda df: df.mapInArrow(lambda it: _nearest(it, k, others, kind), names)
    asked = kept(queries.select("id", "vector").mapInArrow(bounded, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in queries.select("id", "vector").schema.fields) + ", bound double, home int"))
    first = kept(merged(searched(_groups(asked, data, at_home))))
    last = F.when(F.size("near") >= k, F.element_at("near", k)["distance"])
    shrunk = asked.join(first, "id", "left").select("id", "vector", F.least("bound", last).alias("bound"), "home")
    rest = searched(_groups(shrunk, data, beyond))
    return merged(first.unionByName(rest))


def _within(batches: Iterator[pa.RecordBatch], others: bool, cut: float, kinds: list) -> Iterator[pa.RecordBatch]:
    """How many balls hold each query (all balls; balls cut to ``cut``), and how many queries each ball holds."""

    def out(asks: bool, names: list, n: np.ndarray, m: np.ndarray) -> pa.RecordBatch:
        empty = pa.nulls(len(names), kinds[0]), pa.nulls(len(names), kinds[1])
        sides = [pa.array(names, kinds[0]), empty[1]] if asks else [empty[0], pa.array(names, kinds[1])]
        return pa.RecordBatch.from_arrays([*sides, pa.array(n), pa.array(m)], names=["query", "ball", "n", "cut"])

    of, hits = None, np.zeros(0, np.int64)
    for held, rows in _passing(batches):
        if held is not of:
            of, hits = held, np.zeros(len(held.ids), np.int64)
        if rows is None:
            if hits.any():
                yield out(False, held.ids, hits, np.zeros_like(hits))
            continue
        vectors, own = matrix(rows.column(5)), rows.column(4).to_pylist()
        away, off = squares(vectors, held.vectors)
        if others:
            away[held.same(own)] = np.inf
        # what may be inside is found by products of matrices, and then compared exactly
        i, j = np.nonzero(away <= held.balls * held.balls * (1 + SLACK) + off)
        exact = exactly(vectors, held.vectors, i, j)
        inside = exact <= held.balls[j]
        i, j, exact = i[inside], j[inside], exact[inside]
        hits += np.bincount(j, minlength=len(hits))
        yield out(True, own, np.bincount(i, minlength=len(own)), np.bincount(i[exact <= cut], minlength=len(own)))


def within(queries: DataFrame, data: Cells, *, others: bool = False, cut: float = math.inf) -> DataFrame:
    """(query or ball, n, cut): how many balls of ``data`` hold each query, and how many queries each ball holds; rows that would be 0 may be missing.

    A query goes to the bins of the cells where some ball may reach it.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    types = queries.schema["id"].dataType, data.rows.schema["id"].dataType
    kinds, bounds = [to_arrow_type(t) for t in types], data.bounds

    def near(away: np.ndarray, bound: np.ndarray, home: np.ndarray, off: float) -> np.ndarray:
        return _bins((away - off <= (bounds.radius + bounds.ball) * (1 + SLACK) + SLACK) & (bounds.count > 0), bounds)

    asked = queries.select("id", "vector", F.lit(0.0).alias("bound"), F.lit(0).alias("home"))
    found = _groups(asked, data, near).mapInArrow(lambda it: _within(it, others, cut, kinds), f"query {types[0].simpleString()}, ball {types[1].simpleString()}, n bigint, cut bigint")
    return found.groupBy("query", "ball").agg(F.sum("n").alias("n"), F.sum("cut").alias("cut"))


def neighbour_metrics(generated: DataFrame, real: DataFrame, k: int = 5) -> DataFrame:
    """One row of shares, from rows (id, vector) of unique ids and equal length; null where a side has ``k`` vectors or fewer.

    A vector's ball reaches to its k-th nearest other of its own side. ``precision``: generated vectors
    within a real ball. ``recall``: real ones within a generated ball. ``density``: real balls that
    hold a generated vector, by k. ``coverage``: real balls that hold a generated vector.
    ``clipped_density``: as density, with balls cut to the median ball, each vector counted up to
    1, divided by the same of the real vectors themselves. ``clipped_coverage``: the generated vectors in a
    real ball by k, up to 1. ``authenticity``: generated vectors farther from their nearest real one than that is from its own nearest.
    """
    sides = [df.select("id", F.col("vector").cast("array<double>").alias("vector")) for df in (generated, real)]
    names = ["precision", "recall", "density", "coverage", "clipped_density", "clipped_coverage", "authenticity"]
    sizes = [df.count() for df in sides]
    if min(sizes) <= k:
        return generated.sparkSession.range(1).select(*[F.lit(None).cast("double").alias(n) for n in names])
    plain = [cells(df.withColumn("ball", F.lit(None).cast("double"))) for df in sides]
    near = [written(nearest(df, c, k, others=True)) for df, c in zip(sides, plain, strict=True)]
    balls = [df.join(n.select("id", F.element_at("near", k)["distance"].alias("ball")), "id") for df, n in zip(sides, near, strict=True)]
    with_balls = [cells(df) for df in balls]
    middle = balls[1].agg(F.median("ball")).first()[0]
    into_real, into_generated = kept(within(sides[0], with_balls[1], cut=middle)), within(sides[1], with_balls[0])
    own = within(sides[1], with_balls[1], others=True, cut=middle)
    full = lambda c: F.sum(F.least(F.lit(1.0), F.col(c) / k))
    asked, held = into_real.where("query is not null"), into_real.where("ball is not null")
    a = asked.agg((F.count(F.when(F.col("n") > 0, 1)) / sizes[0]).alias("precision"), (F.coalesce(F.sum("n"), F.lit(0)) / (k * sizes[0])).alias("density"), (F.coalesce(full("cut"), F.lit(0.0)) / sizes[0]).alias("clipped"))
    b = held.agg((F.count(F.when(F.col("n") > 0, 1)) / sizes[1]).alias("coverage"), (F.coalesce(full("n"), F.lit(0.0)) / sizes[1]).alias("clipped_coverage"))
    c = into_generated.where("query is not null").agg((F.count(F.when(F.col("n") > 0, 1)) / sizes[1]).alias("recall"))
    d = own.where("query is not null").agg((F.coalesce(full("cut"), F.lit(0.0)) / sizes[1]).alias("own"))
    nearest_real = nearest(sides[0], plain[1], 1).select(F.col("near")[0]["id"].alias("id"), F.col("near")[0]["distance"].alias("away"))
    apart = nearest_real.join(near[1].select("id", F.col("near")[0]["distance"].alias("apart")), "id")
    e = apart.agg((F.count(F.when(F.col("away") > F.col("apart"), 1)) / sizes[0]).alias("authenticity"))
    row = a.join(b).join(c).join(d).join(e)
    return row.withColumn("clipped_density", F.try_divide("clipped", "own")).select(*names)


def _sums(df: DataFrame, features: Callable[[np.ndarray], np.ndarray]) -> tuple[int, np.ndarray]:
    """(rows, sum of ``features`` over them): a partial sum for each task, added up by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, 0.0
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                rows = matrix(batch.column(0).slice(at, 1024))
                n, total = n + len(rows), total + features(rows)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tolist()], pa.list_(pa.float64()))], names=["n", "total"])

    parts = df.select("vector").mapInArrow(run, "n bigint, total array<double>")
    row = parts.agg(F.sum("n").alias("n"), vector_to_array(Summarizer.sum(array_to_vector("total"))).alias("total")).first()
    return row.n or 0, np.array(row.total or [])


def moments(df: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, mean, covariance) of the vectors, from sums of outer products about the first vector by hash."""
    rows = df.select(F.col("vector").cast("array<double>").alias("vector"))
    origin = rows.orderBy(F.xxhash64("vector"), "vector").limit(1).collect()
    if not origin:
        return 0, np.zeros(0), np.zeros((0, 0))
    about = np.array(origin[0].vector)

    def outer(x: np.ndarray) -> np.ndarray:
        x = x - about
        return np.concatenate([x.sum(axis=0), (x.T @ x).ravel()])

    n, total = _sums(rows, outer)
    mean = total[: len(about)] / n
    return n, mean + about, total[len(about) :].reshape(len(about), -1) / n - np.outer(mean, mean)


def _root(m: np.ndarray) -> np.ndarray:
    """The symmetric root of a matrix without negative directions."""
    size, axes = np.linalg.eigh((m + m.T) / 2)
    return (axes * np.sqrt(np.maximum(size, 0))) @ axes.T


def frechet(generated: DataFrame, real: DataFrame) -> float | None:
    """The Fréchet distance of the normal distributions with both sides' means and covariances; null if a side is empty.

    The driver gets a mean and a covariance of each side, whatever its rows.
    """
    (n, mean_a, cov_a), (m, mean_b, cov_b) = moments(generated), moments(real)
    if not n or not m:
        return None
    half = _root(cov_a)
    return float(((mean_a - mean_b) ** 2).sum() + np.trace(cov_a) + np.trace(cov_b) - 2 * np.trace(_root(half @ cov_b @ half)))


def kernel_discrepancy(generated: DataFrame, real: DataFrame, *, width: float, features: int = 2048, seed: int = 0, doubt: float = 1e-3) -> tuple[float | None, float]:
    """(squared maximum mean discrepancy, bound): of the Gaussian kernel exp(-d^2 / (2 width^2)), by random features, no pairs.

    Each of ``features`` random waves gives a squared gap of two means, from 0 to 4, whose expectation is
    the discrepancy with all pairs (each with itself too); by Hoeffding the mean over the
    waves is off by more than ``bound`` with a probability of ``doubt``.
    """
    bound = 4 * math.sqrt(math.log(2 / doubt) / (2 * features))
    first = real.select(F.size("vector").alias("size")).limit(1).collect()
    if not first:
        return None, bound
    waves = np.random.default_rng(seed).standard_normal((first[0].size, features)) / width

    def mean(df: DataFrame) -> np.ndarray | None:
        n, total = _sums(df.select(F.col("vector").cast("array<double>").alias("vector")), lambda x: np.concatenate([np.cos(x @ waves).sum(axis=0), np.sin(x @ waves).sum(axis=0)]))
        return total / n if n else None

    a, b = mean(generated), mean(real)
    return (None if a is None else float(((a - b) ** 2).sum() / features)), bound


def library_report(library: DataFrame, reference: DataFrame, sequence: str = "sequence") -> DataFrame:
    """One row on a library against a reference, by sequences: ``uniqueness``, distinct by all; ``novelty``, of the distinct ones those that the reference lacks;
    mean length and charge; ``composition_gap``, between the mean compositions; and the divergence of
    the library's charge, moment, hydropathy and length from the reference's, over bins of one width, each bin with one row more.

    Null sequences don't count. A side without rows gives nulls where it is asked for. Descriptors are made once.
    """
    from ..functions import scales
    from ..functions import sequences as seq
    from .scoring import divergence

    own = F.col("sequence")
    widths = {"charge": 1.0, "moment": 0.1, "gravy": 0.25, "length": 1.0}
    values = {"charge": seq.charge(own), "moment": seq.moment(own), "gravy": seq.scale_mean(own, scales.HYDROPATHY), "length": F.length(own).cast("double")}
    parts = {f"frac_{a}": seq.fraction(own, a) for a in scales.ALPHABET}
    sides = [kept(df.select(F.col(sequence).alias("sequence")).where("sequence is not null").select("sequence", *[v.alias(n) for n, v in {**values, **parts}.items()])) for df in (library, reference)]
    firsts = sides[0].select("sequence").distinct()
    shares = firsts.join(sides[1].select("sequence").distinct().withColumn("known", F.lit(1)), "sequence", "left").agg(F.count("*").alias("distinct"), F.count("known").alias("known"))
    means = [df.agg(F.count("*").alias(f"n_{k}"), *[F.avg(c).alias(f"{c}_{k}") for c in ["length", "charge", *parts]]) for k, df in zip("ab", sides, strict=True)]
    gap = F.sqrt(sum((F.pow(F.col(f"{p}_a") - F.col(f"{p}_b"), 2) for p in parts), F.lit(0.0)))
    row = shares.join(means[0]).join(means[1]).select(
        F.try_divide("distinct", "n_a").alias("uniqueness"), F.try_divide(F.col("distinct") - F.col("known"), F.col("distinct")).alias("novelty"),
        F.col("length_a").alias("mean_length"), F.col("charge_a").alias("mean_charge"), gap.alias("composition_gap"),
    )
    for name, width in widths.items():
        binned = [df.select(F.floor(F.round(F.col(name) / width, 6)).alias("bin")) for df in sides]
        row = row.join(divergence(*binned, "bin").select(F.col("kl").alias(f"kl_{name}")))
    return row
