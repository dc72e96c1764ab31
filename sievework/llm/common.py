"""What several operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow_text import emptied

FEW = 1 << 18  # links that one task settles
#: A word is a run of anything but these six characters (a character class of any regex dialect).
WORD = r"[^\x20\x09-\x0D]+"
SPACES = "\t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark alone."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(df: DataFrame, size: str = "4m") -> DataFrame:
    """``df``, whose session from now on sends Python workers batches of at most ``size``.

    The default of 64 MB, held by the JVM and the worker for each task, leaves little room in
    small executors; a session that has set another size keeps it.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(key, "67108864b") == "67108864b":
        df.sparkSession.conf.set(key, size)
    return df


def words(text: Column) -> Column:
    """The text's words in order; null text has none."""
    spaced = F.translate(F.coalesce(text, F.lit("")), SPACES, " " * len(SPACES))
    return F.array_remove(F.split(spaced, " "), "")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where it isn't set, one of this machine's if that is all of the cluster."""
    context = spark.sparkContext
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there and context._jsc.sc().getCheckpointDir().isEmpty() and not context.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(there or tempfile.mkdtemp(prefix="sievework-"))
    return there or context._jsc.sc().getCheckpointDir().get()


def checkpoint(df: DataFrame) -> DataFrame:
    """``df`` computed now and kept in the shared folder, so that a lost executor costs no rerun."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: compressed, and read by column."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def most_frequent(counted: DataFrame, most: int) -> DataFrame:
    """The rows of the highest counts ``n``, at most ``most``: all from the least step of a histogram on that leaves no more.

    Nothing is sorted, and no task gathers more than its share of what is kept. A step is a
    sixteenth of a doubling; where the first one alone has more, there are no rows.
    """
    step = F.floor(16 * F.log2("n"))
    room, least = most, None
    for r in counted.groupBy(step.alias("step")).agg(F.count("*").alias("rows")).orderBy(F.desc("step")).collect():
        room -= r.rows
        if room < 0:
            break
        least = r.step
    return counted.limit(0) if least is None else counted.where(step >= least)


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, smallest node that its links reach) of all links (u, v)."""
    parent: dict = {}
    kind = None

    def top(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for batch in batches:
        kind = batch.schema.field(0).type
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            low, high = sorted((top(u), top(v)))
            parent[high] = low
    nodes = list(parent)
    for at in range(0, len(nodes), 1 << 16):
        part = nodes[at : at + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(part, kind), pa.array([top(x) for x in part], kind)], names=["node", "component"])


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the links (a, b): rows (node, component), its smallest node.

    Alternating large and small stars (Kiveris et al., 2014): each round links every
    node to the smallest one in sight, until nothing changes. Minima are summed up
    before a shuffle, and the joins are plain ones that AQE splits at hot nodes. Links
    counted to be at most ``FEW`` are settled in one task, in some 100 MB. Null ends and loops are ignored. Only nodes with a link appear.
    """
    links = checkpoint(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    if links.count() <= FEW:
        kind = links.schema["u"].dataType.simpleString()
        return checkpoint(links.coalesce(1).mapInArrow(lambda it: emptied(_trees(it)), f"node {kind}, component {kind}"))
    before = None
    while True:
        state = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            break
        before = state
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        parent = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(parent, "u")
        links = checkpoint(
            small.select("u", F.col("m").alias("v"))
            .unionByName(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
            .distinct()
        )
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
