"""N-gram Jaccard self-join with adaptive multi-match prefixes, up to connected components."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrow_text import emptied, slices, utf8
from .common import bounded_batches, checkpoint, components, most_frequent, table, written
from .shingles import shingle_sets

FREQUENT = 1 << 18  # most shingles that are ranked last by their count: 4 MB with the counts
SLICE = 2 << 20  # bytes of text that a worker looks at together
COUNTED = 4 << 20  # the same, where it counts shingles: more texts show more of what is frequent
SALTS = 64  # parts of a frequent shingle's group
SEEN = 1 << 20  # set digests that a task remembers: some 100 MB
CHECK_COST = 20.0  # of checking a candidate, in prefix shingles
SENT = 1 << 18  # most ids that are broadcast: 4 MB
COSTLY = 32  # pairs of a node, counted by shingle, up to which they are made
COSTLY_SHARE = 0.25  # the same, of its set's size, so that all such pairs are no more than prefix shingles
DEEP = 4  # matches asked of nodes whose prefix is taken from the whole set
FAMILY = 1 << 20  # shingles of an index: 16 MB


def prefixes(sets: np.ndarray, offsets: np.ndarray, percent: int, frequent: np.ndarray, counts: np.ndarray, deepest: int = 4) -> Iterator[tuple[int, int, np.ndarray]]:
    """(row, matches asked for, prefix) of each set that isn't empty.

    All sets are in one order: shingles not known to be frequent by hash, then the frequent
    ones, rarest first. Two sets of that similarity share ``m`` of their first
    n - ceil(percent * n) + m shingles each. A set takes the m of least estimated cost: the
    prefix's length, and the candidates, at most the sum of its shingles' counts over m.
    """
    rank = np.argsort(np.argsort(counts, kind="stable"), kind="stable")
    for i in range(len(offsets) - 1):
        own = sets[offsets[i] : offsets[i + 1]]
        n = len(own)
        if not n:
            continue
        least = -(-percent * n // 100)
        place = np.minimum(np.searchsorted(frequent, own), max(len(frequent) - 1, 0))
        known = frequent[place] == own if len(frequent) else np.zeros(n, bool)
        common = np.flatnonzero(known)
        common = common[np.argsort(rank[place[common]], kind="stable")] if len(common) else common
        ordered = np.concatenate([np.flatnonzero(~known), common])
        most = min(deepest, least)
        matches = 1
        if len(common) and n - least + 1 > n - len(common):
            weight = np.where(known, np.maximum(counts[place] - 1, 0) if len(counts) else 0, 0)[ordered]
            reach = np.cumsum(weight)
            cost = [n - least + m + CHECK_COST * reach[n - least + m - 1] / m for m in range(1, most + 1)]
            matches = 1 + int(np.argmin(cost))
        yield i, matches, own[ordered[: n - least + matches]]


def _described(batches: Iterator[pa.RecordBatch], size: int, percent: int, frequent: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Each row's id, its set's size, a 64-bit digest of the set, and the matches that it asks for."""
    for rows, data, ends in slices(batches, "text", SLICE):
        sets, at = shingle_sets(data, ends, size)
        digest: list[int | None] = [None] * rows.num_rows
        asked = np.zeros(rows.num_rows, np.int32)
        for i, m, _ in prefixes(sets, at, percent, frequent, counts):
            digest[i], asked[i] = _digest(sets[at[i] : at[i + 1]]), m
        yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.diff(at)), pa.array(digest, pa.int64()), pa.array(asked)], names=["id", "n_shingles", "node", "asked"])


def _digest(found: np.ndarray) -> int:
    return int.from_bytes(blake2b(found.tobytes(), digest_size=8).digest(), "little", signed=True)


def _own_overlap(n: int, percent: int) -> int:
    """How much a set of ``n`` shares at least with a linked one that isn't smaller."""
    return -(-2 * percent * n // (100 + percent))


def _often(batches: Iterator[pa.RecordBatch], size: int, least: int) -> Iterator[pa.RecordBatch]:
    """Shingles that ``least`` or more different sets of one slice hold, and how many."""
    for _, data, ends in slices(batches, "text", COUNTED):
        sets, at = shingle_sets(data, ends, size)
        seen: set[int] = set()
        fresh = np.zeros(len(at) - 1, bool)
        for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
            digest = _digest(sets[a:b])
            fresh[i] = digest not in seen
            seen.add(digest)
        found = sets if fresh.all() else sets[np.repeat(fresh, np.diff(at))]
        del sets
        value, count = np.unique(found, return_counts=True)
        keep = count >= least
        yield pa.RecordBatch.from_arrays([pa.array(value[keep].view(np.int64)), pa.array(count[keep].astype(np.int64))], names=["shingle", "n"])


def _prefix_rows(batches: Iterator[pa.RecordBatch], size: int, percent: int, frequent: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(shingle, salt, node, short) for each prefix shingle, once for each different set that the task remembers.

    The groups of frequent shingles are dealt out in ``SALTS`` parts, from 1 on; others are whole, as part 0.
    ``short``: whether the shingle is in the prefix that a set needs against sets that aren't smaller.
    """
    seen: set[int] = set()
    for _, data, ends in slices(batches, "text", SLICE):
        sets, at = shingle_sets(data, ends, size)
        shingle, node, short = [], [], []
        for i, m, found in prefixes(sets, at, percent, frequent, counts):
            digest = _digest(sets[at[i] : at[i + 1]])
            if digest not in seen:
                seen.add(digest)
                shingle.append(found)
                node.append((digest, len(found)))
                n = int(at[i + 1] - at[i])
                short.append(np.arange(len(found)) < n - _own_overlap(n, percent) + m)
        if len(seen) > SEEN:
            seen.clear()
        if node:
            value, times = zip(*node, strict=True)
            shingles, nodes = np.concatenate(shingle), np.repeat(np.array(value, np.int64), times)
            salt = np.where(np.isin(shingles, frequent), 1 + (nodes & (SALTS - 1)), 0).astype(np.int8)
            yield pa.RecordBatch.from_arrays([pa.array(shingles.view(np.int64)), pa.array(salt), pa.array(nodes), pa.array(np.concatenate(short))], names=["shingle", "salt", "node", "short"])


def _similar(batches: Iterator[pa.RecordBatch], size: int, percent: int) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) whose whole texts' sets are similar enough."""
    for rows, data, ends in slices(batches, "text_a", SLICE):
        other = rows.column(rows.schema.get_field_index("text_b")).dictionary_encode()
        mine, mine_at = shingle_sets(data, ends, size)
        theirs, theirs_at = shingle_sets(*utf8(other.dictionary), size)
        linked = np.zeros(rows.num_rows, bool)
        for i, k in enumerate(other.indices.to_pylist()):
            a, b = mine[mine_at[i] : mine_at[i + 1]], theirs[theirs_at[k] : theirs_at[k + 1]]
            both = len(np.intersect1d(a, b, assume_unique=True))
            linked[i] = 100 * both >= percent * (len(a) + len(b) - both) and both > 0
        yield rows.select(["a", "b"]).filter(pa.array(linked))


def _sent(ids: DataFrame, texts: DataFrame) -> DataFrame:
    """The different rows (id, text) of ``texts`` whose id is listed: the list is broadcast if it is counted to be small."""
    few = ids.limit(SENT + 1).count() <= SENT
    listed = texts.join(F.broadcast(ids) if few else ids, "id", "left_semi")
    return listed.groupBy("id", F.xxhash64("text"), F.octet_length("text")).agg(F.first("text").alias("text")).select("id", "text")


def _whole(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """(node, its whole set) of each text that has shingles."""
    for _, data, ends in slices(batches, "text", SLICE):
        sets, at = shingle_sets(data, ends, size)
        keep = np.flatnonzero(np.diff(at))
        node = [_digest(sets[at[i] : at[i + 1]]) for i in keep.tolist()]
        found = pa.ListArray.from_arrays(pa.array(np.append(at[keep], at[-1]).astype(np.int32)), pa.array(sets.view(np.int64)))
        yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), found], names=["node", "found"])


def _family_links(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """(a, b) of components that similar sets connect, no more than a tree of them for each chunk.

    Rows are (family, chunk, looked, component, found), by family and chunk, the chunk's own sets
    first, each sorted. They make an index of shingles; then they and the family's other sets pass it, and
    each counts its matches with all sets of the chunk at once.
    """
    key, index, owner, sizes, of, root = None, np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), [], {}
    held: list[np.ndarray] = []
    out: tuple[list, list] = ([], [])

    def top(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def passes(own: np.ndarray, component) -> None:
        lo, hi = np.searchsorted(index, own), np.searchsorted(index, own, side="right")
        many = hi - lo
        at = np.repeat(lo - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
        both = np.bincount(owner[at], minlength=len(sizes))
        for i in np.flatnonzero(100 * both >= percent * (sizes + len(own) - both)).tolist():
            x, y = top(component), top(of[i])
            if x != y:
                root[x] = y
                out[0].append(component)
                out[1].append(of[i])

    def close() -> None:
        nonlocal index, owner, sizes, held
        index = np.concatenate(held)
        sizes = np.array([len(x) for x in held], np.int64)
        order = np.argsort(index, kind="stable")
        index, owner, mine, held = index[order], np.repeat(np.arange(len(sizes)), sizes)[order], held, []
        for own, component in zip(mine, of, strict=True):
            passes(own, component)

    kind = None
    for batch in batches:
        kind = batch.schema.field(3).type
        columns = [batch.column(i).to_pylist() for i in range(4)]
        for family, chunk, looked, component, data in zip(*columns, batch.column(4), strict=True):
            own = data.values.to_numpy().view(np.uint64)
            if (family, chunk) != key:
                if held:
                    close()
                key, of, root = (family, chunk), [], {}
                index, owner, sizes = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
            if looked:
                held.append(own)
                of.append(component)
            else:
                if held:
                    close()
                passes(own, component)
        yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x in out], names=["a", "b"])
        out = ([], [])
    if held:
        close()
    if out[0]:
        yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x in out], names=["a", "b"])


def _split(placed: DataFrame, name: str) -> DataFrame:
    """Of the rows (shingle, node, n, asked, component, short) those of groups that hold several components and any short row, with the group's ``size`` and its short rows ``index``."""
    split = placed.groupBy("shingle").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size"), F.sum(F.col("short").cast("long")).alias("index")).where("lo <> hi and index > 0")
    return written(placed.join(split.select("shingle", "size", "index"), "shingle"), name)


def _least(n, percent: int):
    """The least size of a set that can link with one of ``n``."""
    return -F.floor(-percent * n / 100)


def _cheap(rest: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs (x, y) across components within the groups of ``rest``, and the nodes that make too many: (node, n, component).

    Of a pair, the smaller set need only be met by its short prefix, since it shares more of
    itself with a set that isn't smaller; so a shingle that is in nobody's short prefix makes no pair.
    A node costs as many pairs, counted once for each shingle, as its groups have other
    members that it may meet. Those with a node that costs at most ``COSTLY``, or ``COSTLY_SHARE`` of its set's
    size, are made and summed up. A pair stays if it shares as many prefix shingles as the
    less demanding node asks for, and if the sets' sizes allow the similarity: beyond the
    prefix that ends first, it can share at most the rest of that set.
    """
    met = F.when(F.col("short"), F.col("size") - 1).otherwise(F.col("index"))
    cost = rest.groupBy("node").agg(F.sum(met).alias("cost"), F.first("n").alias("n"), F.first("component").alias("component"))
    costly = checkpoint(cost.where(F.col("cost") > F.greatest(F.lit(COSTLY), COSTLY_SHARE * F.col("n"))).select("node", "n", "component"))
    marked = rest.join(costly.select("node", F.lit(True).alias("costly")), "node", "left").withColumn("costly", F.coalesce("costly", F.lit(False)))
    overlap = lambda n: -F.floor(-percent * n / (100 + percent))
    marked = marked.withColumns({"rest": _least(F.col("n"), percent) - F.col("asked"), "short_rest": overlap(2 * F.col("n")) - F.col("asked")})
    left, right = marked.where("not costly").alias("l"), marked.alias("r")
    alike = (F.col("l.shingle") == F.col("r.shingle")) & (F.col("l.component") != F.col("r.component"))
    sizes = 100 * F.least("l.n", "r.n") >= percent * F.greatest("l.n", "r.n")
    indexed = ((F.col("l.n") > F.col("r.n")) | F.col("l.short")) & ((F.col("r.n") > F.col("l.n")) | F.col("r.short"))
    unseen = F.greatest(F.when(F.col("l.n") > F.col("r.n"), F.col("l.rest")).otherwise(F.col("l.short_rest")), F.when(F.col("r.n") > F.col("l.n"), F.col("r.rest")).otherwise(F.col("r.short_rest")))
    needed = F.greatest(F.least("l.asked", "r.asked"), overlap(F.col("l.n") + F.col("r.n")) - unseen).cast("int")
    pairs = left.join(right, alike & sizes & indexed & (F.col("r.costly") | (F.col("l.node") < F.col("r.node"))))
    pairs = pairs.select(F.col("l.node").alias("x"), F.col("r.node").alias("y"), needed.alias("needed"))
    return pairs.groupBy("x", "y").agg(F.count("*").alias("shared"), F.first("needed").alias("needed")).where("shared >= needed").select("x", "y"), costly


def _sets(nodes: DataFrame, reps: DataFrame, named: DataFrame, size: int) -> DataFrame:
    """The rows (node, n, component) of ``nodes`` with the node's whole set in ``found``."""
    wanted = nodes.join(reps, "node").select(F.col("rep").alias("id")).distinct()
    sets = _sent(wanted, named).mapInArrow(lambda it: emptied(_whole(it, size)), "node bigint, found array<bigint>").dropDuplicates(["node"])
    return written(sets.join(nodes, "node"), "whole-sets")


def _deepened(sets: DataFrame, percent: int) -> DataFrame:
    """Prefix rows of nodes by the order of their whole sets: shingles of one component alone first, then by count.

    The counts are exact, over all sets given. The first shingles can't match across
    components; a node that has fewer others than a link shares has no prefix at all.
    """
    rows = sets.select("node", "n", "component", F.explode("found").alias("shingle"))
    counts = rows.groupBy("shingle").agg(F.count("*").alias("c"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("shingle", "c")
    own = Window.partitionBy("node")
    least, overlap = _least(F.col("n"), percent), -F.floor(-2 * percent * F.col("n") / (100 + percent))
    asked = F.least(F.lit(DEEP), least).cast("int")
    ranked = rows.join(counts, "shingle").withColumn("rank", F.row_number().over(own.orderBy("c", "shingle"))).withColumn("useful", F.count("*").over(own))
    short = F.col("rank") <= F.col("useful") - overlap + asked
    return ranked.where(F.col("rank") <= F.col("useful") - least + asked).select("shingle", "node", "n", asked.alias("asked"), "component", short.alias("short"))


def _families(costly: DataFrame, rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of components among nodes that groups of ``rest`` connect: each family is compared by an index of its shingles.

    An index holds ``FAMILY`` shingles; past it the whole family streams. Only links that
    connect components leave the task.
    """
    id_type = costly.schema["component"].dataType.simpleString()
    grouped = rest.join(costly.select("node"), "node", "left_semi").select("shingle", "node")
    leads = grouped.groupBy("shingle").agg(F.min("node").alias("lead"))
    family = components(grouped.join(leads, "shingle").select(F.col("node").alias("a"), F.col("lead").alias("b"))).withColumnRenamed("component", "family")
    placed = checkpoint(costly.join(family, "node"))
    chunks = placed.groupBy("family").agg(F.ceil(F.sum("n") / FAMILY).cast("int").alias("chunks"))
    members = sets.select("node", "found").join(placed, "node").join(chunks, "family")
    own = F.pmod(F.xxhash64("node"), "chunks").cast("int")
    dealt = members.select("family", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "component", "found")
    partitions = int(rest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return checkpoint(
        dealt.select("family", "chunk", (F.col("own") == F.col("chunk")).alias("looked"), "component", "found")
        .repartition(partitions, "family", "chunk").sortWithinPartitions("family", "chunk", F.desc("looked"))
        .mapInArrow(lambda it: emptied(_family_links(it, percent)), f"a {id_type}, b {id_type}")
    )


def _across(rest: DataFrame, named: DataFrame, reps: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame | None]:
    """Candidate pairs (x, y) of nodes across components, and links (a, b) of components already checked (None: none).

    Nodes that would make too many pairs have their prefix lengthened: it is taken from the
    whole set, in the order of the exact counts among such nodes, and asks for ``DEEP``
    matches. Those that still make too many are compared family by family.
    """
    pairs, costly = _cheap(rest, percent)
    if costly.isEmpty():
        return pairs, None
    sets = _sets(costly, reps, named, size)
    deep = _split(_deepened(sets, percent), "deep-prefixes")
    more, still = _cheap(deep, percent)
    return pairs.unionByName(more).distinct(), None if still.isEmpty() else _families(still, deep, sets, percent)


def jaccard_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 75, often: int = 2) -> DataFrame:
    """A row per document: id, n_shingles, component_id, node.

    Documents link when their sets of distinct ``size``-word shingles have a Jaccard
    similarity of ``percent`` / 100 or more; ``component_id`` is the smallest id that links
    reach. The steps, none of which drops a link between components:

    1. Shingles that two sets of a slice of the input hold are counted up over the input, and
       the ``FREQUENT`` most frequent ones come last in the global order. A shingle of g texts
       among s slices is seen where two of them share a slice, so from some g * g = 2 * s on.
       This affects only the speed.
    2. Documents with equal sets are one node, by a 64-bit digest of the set; its smallest
       id stands for it.
    3. Prefix shingles are grouped. In each group every node is paired with the smallest
       one, so that a group of n copies makes n - 1 candidates and not n squared.
    4. Of the candidates that share enough prefix shingles, each node's best is checked on
       the whole texts, and components are taken.
    5. Groups that still hold several components give the pairs across components, which are
       checked alike if they share enough prefix shingles and their sizes allow it. Nodes
       with many such pairs have their prefix lengthened: it is chosen anew from the whole
       set, by exact counts. What is still costly then is compared within families without
       making the pairs. Links of step 4 and 5 make the result.

    Texts move, not sets, as they are smaller. A null or empty text has no shingles and
    links with nothing. A long text costs memory in proportion, some 30 bytes a byte in a
    worker; its set is one row. Rows with an id that occurs again count as one document of several
    texts; rows without an id are returned with their count and no component. Repeated rows
    are returned as often; an empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    source = bounded_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = source.schema["id"].dataType.simpleString()
    named = source.where(F.col("id").isNotNull())
    many = written(named.mapInArrow(lambda it: emptied(_often(it, size, often)), "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n")), "frequent-shingles")
    top = most_frequent(many, FREQUENT).toPandas()
    by_value = np.argsort(top["shingle"].to_numpy(np.int64).view(np.uint64))
    frequent, counts = top["shingle"].to_numpy(np.int64).view(np.uint64)[by_value], top["n"].to_numpy(np.int64)[by_value]

    described = checkpoint(source.mapInArrow(lambda it: emptied(_described(it, size, percent, frequent, counts)), f"id {id_type}, n_shingles bigint, node bigint, asked int"))
    nodes = checkpoint(
        described.where("id is not null and node is not null")
        .groupBy("node").agg(F.min("id").alias("rep"), F.max("n_shingles").alias("n"), F.max("asked").alias("asked"))
    )
    prefix = named.mapInArrow(lambda it: emptied(_prefix_rows(it, size, percent, frequent, counts)), "shingle bigint, salt tinyint, node bigint, short boolean")
    part = Window.partitionBy("shingle", "salt")
    parts = written(
        prefix.withColumn("lead", F.min("node").over(part)).withColumn("last", F.max("node").over(part)).where("salt > 0 or lead <> last").distinct(),
        "shared-prefixes",
    )
    hot = parts.where("salt > 0")
    leads = hot.groupBy("shingle").agg(F.min("lead").alias("lead"), F.max("last").alias("last")).where("lead <> last").select("shingle", "lead")  # at most FREQUENT rows
    shared = parts.where("salt = 0").select("shingle", "node", "short", "lead").unionByName(hot.select("shingle", "node", "short").join(F.broadcast(leads), "shingle"))

    reps = nodes.select("node", "rep")

    def links(pairs: DataFrame) -> DataFrame:
        """Of the candidate pairs (x, y) of nodes, the links (a, b) of their ids, by their whole texts."""
        wanted = checkpoint(
            pairs.join(reps.select(F.col("node").alias("x"), F.col("rep").alias("a")), "x")
            .join(reps.select(F.col("node").alias("y"), F.col("rep").alias("b")), "y").where("a <> b").select("a", "b").distinct()
        )
        texts = _sent(wanted.select(F.col("a").alias("id")).unionByName(wanted.select(F.col("b").alias("id"))).distinct(), named)
        return checkpoint(
            wanted.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
            .join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
            .select("a", "b", "text_a", "text_b")
            .mapInArrow(lambda it: emptied(_similar(it, size, percent)), f"a {id_type}, b {id_type}")
        )

    stars = shared.where("node <> lead").groupBy(F.col("node").alias("x"), F.col("lead").alias("y")).agg(F.count("*").alias("shared"))
    rest = -F.floor(-percent * F.col("n") / 100) - F.col("asked")
    x, y = (nodes.select(F.col("node").alias(k), F.col("n").alias(f"n_{k}"), F.col("asked").alias(f"asked_{k}"), rest.alias(f"rest_{k}")) for k in "xy")
    stars = (
        stars.join(x, "x").join(y, "y")
        .where((F.col("shared") >= F.least("asked_x", "asked_y")) & (100 * F.least("n_x", "n_y") >= percent * F.greatest("n_x", "n_y")))
        .where((100 + percent) * (F.col("shared") + F.greatest("rest_x", "rest_y")) >= percent * (F.col("n_x") + F.col("n_y")))
        .groupBy("x").agg(F.max(F.struct("shared", "y")).alias("best")).select("x", "best.y")
    )
    found = links(stars)
    first = components(found)
    placed = shared.select("shingle", "node", "short").join(nodes, "node").join(first.withColumnRenamed("node", "rep"), "rep", "left")
    rest = _split(placed.select("shingle", "node", "n", "asked", F.coalesce("component", "rep").alias("component"), "short"), "split-prefixes")
    across, checked = _across(rest, named, reps, size, percent)
    more = links(across) if checked is None else links(across).unionByName(checked)
    last = components(found.unionByName(more)) if not more.isEmpty() else first
    placed = nodes.join(last.withColumnRenamed("node", "rep"), "rep", "left").select("node", F.coalesce("component", "rep").alias("component"))
    return described.join(placed, "node", "left").select(
        F.col("id").alias(id_col), "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"), "node"
    )


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate components of all documents."""
    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


OP9_SQL = r"""
WITH RECURSIVE listed AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingled AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM listed),
shingles AS (SELECT doc_id, unnest(s) AS x FROM shingled),
sizes AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM shingled),
linked AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.x = b.x AND a.doc_id <> b.doc_id
  JOIN sizes m ON m.doc_id = a.doc_id JOIN sizes n ON n.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, m.n, n.n HAVING 100 * count(*) >= 75 * (m.n + n.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM sizes UNION SELECT r.a, l.b FROM reach r JOIN linked l ON r.b = l.a)
SELECT s.doc_id, s.n AS n_shingles, r.component_id
FROM sizes s JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) r ON r.a = s.doc_id
"""
