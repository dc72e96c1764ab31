"""Exact range join of embeddings: pivot cells, boundary replication, cells joined independently."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrow_text import emptied
from .common import checkpoint, components, table

CELL = 1024  # distinct vectors a cell, on average
FEWEST = 4  # pivots of a group
SMALL = 128  # distinct vectors of a group from which on it has pivots
PIVOTS = 4096  # most pivots: 2 MB at 64 dimensions
CHUNK = 2048  # most vectors of a cell that one group looks up
SLACK = 1e-7  # for rounding in bounds: the root of 2 - 2x is off by up to 2e-8 near 0


def unit_vectors(column: pa.ListArray) -> np.ndarray:
    """Rows of equal length as doubles of length 1."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    flat = flat / np.abs(flat).max(axis=1, keepdims=True)
    return flat / np.sqrt((flat * flat).sum(axis=1, keepdims=True))


class Pivots:
    """The pivots of each group of comparable vectors, with their cells' numbers and radii."""

    def __init__(self, groups: list[str], vectors: list[list[float]]) -> None:
        self.of: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for group in dict.fromkeys(groups):
            cells = np.array([i for i, g in enumerate(groups) if g == group])
            self.of[group] = (cells, unit_vectors(pa.array([vectors[i] for i in cells], pa.list_(pa.float64()))))
        self.radius = np.zeros(len(groups))

    def distances(self, group: str, vectors: np.ndarray) -> np.ndarray:
        """From each vector to each of the group's pivots."""
        return np.sqrt(np.maximum(0, 2 - 2 * vectors @ self.of[group][1].T))

    def between(self, group: str) -> np.ndarray:
        """From pivot to pivot."""
        return self.distances(group, self.of[group][1])


def _by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.RecordBatch, np.ndarray]]:
    """(group, its rows of a batch, their vectors); columns are group, node, weight, vector."""
    for batch in batches:
        coded = batch.column(0).dictionary_encode()
        for code, group in enumerate(coded.dictionary.to_pylist()):
            rows = batch.filter(pa.array(coded.indices.to_numpy() == code))
            yield group, rows, unit_vectors(rows.column(3))


def _radii(batches: Iterator[pa.RecordBatch], pivots: Pivots) -> Iterator[pa.RecordBatch]:
    for group, _, vectors in _by_group(batches):
        if group in pivots.of:
            away = pivots.distances(group, vectors)
            home = away.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pivots.of[group][0][home].astype(np.int64)), pa.array(away[np.arange(len(home)), home])], names=["cell", "radius"])


def _dealt(batches: Iterator[pa.RecordBatch], pivots: Pivots, reach: float) -> Iterator[pa.RecordBatch]:
    """Every vector in its own cell, and in each other cell that may hold a vector within ``reach``, with the ring about the pivot where it lies; rings are as wide as ``reach``."""
    for group, rows, vectors in _by_group(batches):
        n = len(vectors)
        if group in pivots.of:
            cells, _ = pivots.of[group]
            away, between = pivots.distances(group, vectors), pivots.between(group)
            home = away.argmin(axis=1)
            own = away[np.arange(n), home][:, None]
            # a vector within reach in cell j is as near to pivot j as to any, and within its radius
            near = (away <= own + 2 * reach + SLACK) & (away <= pivots.radius[cells] + reach + SLACK)
            near &= away**2 - own**2 <= 2 * reach * between[home] + SLACK
            near[np.arange(n), home] = True
            at, j = np.nonzero(near)
            cell, is_home, ring = cells[j].astype(np.int64), j == home[at], (away[at, j] / (reach + SLACK)).astype(np.int32)
        else:
            at, cell, is_home, ring = np.arange(n), np.full(n, -1), np.ones(n, bool), np.zeros(n, np.int32)
        taken = rows.take(pa.array(at))
        yield pa.RecordBatch.from_arrays([taken.column(0), pa.array(cell), pa.array(is_home), pa.array(ring), *taken.columns[1:]], names=["group", "cell", "home", "ring", "node", "weight", "vector"])


def _joined(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """(node, links, root): of each vector at home its links; of each vector with a link one that it reaches.

    Rows come by (group, cell, chunk), those to look up first; the others stream past them.
    """
    key, homes, nodes, links, label = None, np.zeros((0, 0)), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def finish() -> Iterator[pa.RecordBatch]:
        if len(nodes):
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(links), pa.array(nodes[label])], names=["node", "links", "root"])

    for batch in batches:
        names = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))
        looked = batch.column(3).to_numpy(zero_copy_only=False)
        edges = [0, *[i for i in range(1, len(names)) if names[i] != names[i - 1] or looked[i] != looked[i - 1]], len(names)]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            vectors = unit_vectors(batch.column(6).slice(lo, hi - lo))
            own = batch.column(4).slice(lo, hi - lo).to_numpy()
            if names[lo] != key:
                yield from finish()
                key, homes, nodes, links, label = names[lo], np.zeros((0, vectors.shape[1])), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
            if looked[lo]:
                homes, nodes = np.vstack([homes, vectors]), np.concatenate([nodes, own])
                links, label = np.zeros(len(nodes), np.int64), np.arange(len(nodes))
                continue
            weight = batch.column(5).slice(lo, hi - lo).to_numpy()
            for at in range(0, hi - lo, 1024):
                near = homes @ vectors[at : at + 1024].T >= least
                same = nodes[:, None] == own[at : at + 1024]
                links += (near & ~same) @ weight[at : at + 1024] + (same @ weight[at : at + 1024] - same.any(axis=1))
                met = np.flatnonzero(near.any(axis=0))
                if not len(met):
                    continue
                near = near[:, met]
                while True:
                    of = np.where(near, label[:, None], len(label)).min(axis=0)
                    least_met = np.minimum(label, np.where(near, of, len(label)).min(axis=1))
                    # whole trees move: the old root hooks to the least label that one of its homes meets
                    hook = np.arange(len(label))
                    np.minimum.at(hook, label, least_met)
                    while (hook[hook] != hook).any():
                        hook = hook[hook]
                    if (hook[label] == label).all():
                        break
                    label = hook[label]
                yield pa.RecordBatch.from_arrays([pa.array(own[at : at + 1024][met]), pa.nulls(len(met), pa.int64()), pa.array(nodes[of])], names=["node", "links", "root"])
    yield from finish()


def _shares(sizes: dict[str, int]) -> dict[str, int]:
    """How many pivots each group gets: one for ``CELL`` vectors and ``FEWEST`` at least, of at most ``PIVOTS`` in all, of which the largest groups come first."""
    wanted = {g: max(FEWEST, n // CELL) for g, n in sizes.items()}
    scale = min(1.0, PIVOTS / max(1, sum(wanted.values())))
    return {g: max(1, int(w * scale)) for g, w in wanted.items()}


def _pivots(nodes: DataFrame) -> Pivots:
    """Each group's pivots: its vectors of the smallest hashes. Groups of fewer than ``SMALL`` vectors have none."""
    sizes = nodes.groupBy("group").agg(F.count("*").alias("n")).where(F.col("n") >= SMALL).orderBy(F.desc("n"), "group").limit(PIVOTS).collect()
    shares = _shares({r.group: r.n for r in sizes})
    if not shares:
        return Pivots([], [])
    listed = F.broadcast(nodes.sparkSession.createDataFrame(list(shares.items()), "group string, wanted int"))
    nth = F.row_number().over(Window.partitionBy("group").orderBy("h1", "node"))
    first = nodes.select("group", "h1", "node", "vector").withColumn("nth", nth).where(F.col("nth") <= max(shares.values()))
    picked = first.join(listed, "group").where("nth <= wanted").orderBy("group", "nth").select("group", F.col("vector").cast("array<double>").alias("vector")).collect()
    return Pivots([r.group for r in picked], [r.vector for r in picked])


def _cells(wide: DataFrame, pivots: Pivots, reach: float) -> DataFrame:
    """(group, cell, chunk, looked, node, weight, vector): each chunk's own vectors, and those that pass it.

    A cell of over ``CHUNK`` vectors has a second level, rings about its pivot: by the triangle
    inequality a vector has its links in its own ring and the two beside it. A ring is cut
    into chunks of ``CHUNK`` vectors.
    """
    kind = wide.schema["vector"].dataType.simpleString()
    dealt = wide.mapInArrow(lambda it: emptied(_dealt(it, pivots, reach)), f"`group` string, cell bigint, home boolean, ring int, node bigint, weight bigint, vector {kind}")
    counted = checkpoint(dealt.where("home").groupBy("group", "cell", "ring").agg(F.count("*").alias("n")))
    whole = counted.groupBy("group", "cell").agg((F.sum("n") > CHUNK).alias("large"))
    ring = F.when(F.col("large"), F.col("ring")).otherwise(0)
    chunks = counted.join(whole, ["group", "cell"]).groupBy("group", "cell", "large", ring.alias("ring")).agg(F.ceil(F.sum("n") / CHUNK).cast("int").alias("chunks"))
    placed = dealt.join(whole, ["group", "cell"]).withColumn("ring", ring)
    chunk = lambda nth: (F.col("ring").cast("bigint") * (1 << 32) + nth).alias("chunk")
    looked = placed.where("home").join(chunks.drop("large"), ["group", "cell", "ring"]).select("group", "cell", chunk(F.pmod(F.xxhash64("node"), "chunks")), F.lit(True).alias("looked"), "node", "weight", "vector")
    beside = F.when(F.col("large"), F.array(F.col("ring") - 1, F.col("ring"), F.col("ring") + 1)).otherwise(F.array("ring"))
    passing = placed.withColumn("ring", F.explode(beside)).join(chunks.drop("large"), ["group", "cell", "ring"])
    return looked.unionByName(passing.withColumn("nth", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select("group", "cell", chunk(F.col("nth")), F.lit(False).alias("looked"), "node", "weight", "vector"))


def embedding_links(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", group_col: str = "label", least: float = 0.98) -> DataFrame:
    """A row per vector: id, n_links, component_id, kept.

    Vectors of equal group (not null) link when their cosine in double precision is ``least``
    or more. Equal vectors of a group are one node with a weight. On the unit sphere the
    cosine bounds the distance, a metric: each node belongs to the nearest of its group's
    pivots (hashed samples of ``FEWEST`` nodes or more for each group of ``SMALL``, at most ``PIVOTS`` in all), and is also sent to each cell that
    triangle inequalities, the cell's radius and the bisecting plane don't rule out. So each
    cell has all links of its own nodes and is joined by itself, a large one by rings about its pivot, in groups of at most
    ``CHUNK`` nodes to look up, past which the vectors near them stream. Groups return counts
    and a spanning link for each node, never pairs.

    A vector that is null, empty or zero, or has a null or non-finite component, or no group,
    links with nothing, as does a row without an id, whose component is null; vectors of different lengths don't link.
    ``kept`` marks the smallest id of a component. Repeated rows are vectors like others; an
    empty table gives no rows; other columns are not read. Rows find their node by 128 bits of hashes.
    """
    v = F.col("vector")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(group_col).cast("string").alias("group"), F.col(vector_col).alias("vector"))
    rows = rows.withColumn("usable", F.coalesce(F.col("id").isNotNull() & F.col("group").isNotNull() & fine, F.lit(False)))
    rows = rows.withColumn("group", F.concat_ws(":", F.size("vector").cast("string"), "group"))
    rows = rows.withColumns({"h1": F.when(F.col("usable"), F.xxhash64("group", "vector")), "h2": F.when(F.col("usable"), F.xxhash64(F.lit(7), "group", "vector"))})
    alike = rows.where("usable").groupBy("group", "h1", "h2", "vector").agg(F.count("*").alias("weight"), F.min("id").alias("rep"))
    nodes = checkpoint(alike.withColumn("node", F.monotonically_increasing_id()))
    wide = nodes.select("group", "node", "weight", "vector")
    pivots = _pivots(nodes)
    for r in wide.mapInArrow(lambda it: emptied(_radii(it, pivots)), "cell bigint, radius double").groupBy("cell").agg(F.max("radius").alias("radius")).collect():
        pivots.radius[r.cell] = r.radius
    partitions = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = _cells(wide, pivots, float(np.sqrt(2 - 2 * least))).repartition(partitions, "group", "cell", "chunk").sortWithinPartitions("group", "cell", "chunk", F.desc("looked"))
    found = checkpoint(groups.mapInArrow(lambda it: emptied(_joined(it, least)), "node bigint, links bigint, root bigint"))
    together = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    by_node = nodes.select("node", "h1", "h2", "rep").join(together, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = by_node.groupBy("component").agg(F.min("rep").alias("component_id"))
    facts = by_node.join(smallest, "component").join(found.where("links is not null").groupBy("node").agg(F.sum("links").alias("links")), "node").select("h1", "h2", "links", "component_id")
    return rows.select("id", "h1", "h2").join(facts, ["h1", "h2"], "left").select(
        F.col("id").alias(id_col),
        F.coalesce("links", F.lit(0)).alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("component_id", "id"), F.lit(False)).alias("kept"),
    )


def op2_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates among all embeddings."""
    return embedding_links(table(spark, sf_dir, "embeddings"))


OP2_SQL = """
WITH RECURSIVE usable AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
parts AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM parts
"""
