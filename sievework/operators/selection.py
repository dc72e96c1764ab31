"""Selection that matches a distribution: quotas, round-robin over clusters, price loop, diverse top-k."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import kept, written
from .ranking import running


def quotas(reference: DataFrame, cell: str, total: int, floor: float = 0.0004) -> DataFrame:
    """(cell, quota) with the reference's histogram, summing to ``total``.

    Shares are at least ``floor``, scaled to 1 and rounded half to even; what that leaves or
    takes too much goes in turn to the cells of the largest quotas. A cell that would fall
    below 0 is passed over, by as many rounds as needed in a loop over the cells, of which
    there are few; the loop runs only then.
    """
    cells = reference.groupBy(cell).agg(F.count("*").alias("n"))
    everywhere = Window.partitionBy()
    by_quota = Window.orderBy(F.desc("quota"), cell)
    shared = cells.withColumn("share", F.greatest(F.col("n") / F.sum("n").over(everywhere), F.lit(floor)))
    rounded = shared.withColumn("quota", F.bround(F.lit(total) * F.col("share") / F.sum("share").over(everywhere)).cast("long"))
    placed = rounded.select(
        cell, "quota",
        (F.lit(total) - F.sum("quota").over(everywhere)).alias("drift"),
        (F.row_number().over(by_quota) - 1).alias("nth"),
        F.count("*").over(everywhere).alias("cells"),
    )
    share_of_drift = F.floor(F.abs("drift") / F.col("cells")) + F.when(F.col("nth") < F.abs("drift") % F.col("cells"), 1).otherwise(0)
    adjusted = placed.withColumn("quota", F.col("quota") + F.signum("drift").cast("long") * share_of_drift)
    if adjusted.where("quota < 0").isEmpty():
        return adjusted.select(cell, "quota")
    rows = sorted(placed.select(cell, "quota", "drift").collect(), key=lambda r: (-r.quota, r[cell]))
    left, values, i = rows[0].drift, [r.quota for r in rows], 0
    while left:
        step = 1 if left > 0 else -1
        if values[i % len(values)] + step >= 0:
            values[i % len(values)] += step
            left -= step
        i += 1
    return reference.sparkSession.createDataFrame([(r[cell], q) for r, q in zip(rows, values, strict=True)], adjusted.select(cell, "quota").schema)


def split_quotas(members: DataFrame, cell: str, sub: str, cell_quotas: DataFrame) -> DataFrame:
    """(cell, sub, sub_quota): each cell's quota by its members' shares of the sub-regions, the rest to the largest."""
    counts = members.groupBy(cell, sub).agg(F.count("*").alias("n")).join(cell_quotas, cell)
    in_cell = Window.partitionBy(cell)
    floors = counts.withColumn("sub_quota", F.floor(F.col("n") * F.col("quota") / F.sum("n").over(in_cell)))
    rest = F.col("quota") - F.sum("sub_quota").over(in_cell)
    nth = F.row_number().over(in_cell.orderBy(F.desc("n"), sub))
    return floors.withColumn("extra", F.when(nth <= rest, 1).otherwise(0)).select(cell, sub, (F.col("sub_quota") + F.col("extra")).alias("sub_quota"))


def round_robin(df: DataFrame, groups: list[str], cluster: str, quality: str, row_id: str, rounds: int | None = None) -> DataFrame:
    """Adds ``nth``, the place of each row when a group takes in turn the best row left of each cluster, until all are taken or ``rounds`` are over.

    Neither a group nor a cluster goes to one task.
    """
    turned = running(df, [*groups, cluster], [F.desc(quality), F.col(row_id)], "turn")
    if rounds is not None:
        turned = turned.where(F.col("turn") <= rounds)
    return running(turned, groups, [F.col("turn"), F.desc(quality), F.col(row_id)], "nth").drop("turn")


def select(
    df: DataFrame, cell_quotas: DataFrame, total: int, *, cell: str = "cell", cluster: str = "cluster", quality: str = "quality", row_id: str = "row_id",
    forced: DataFrame | None = None, sub: str | None = None, sub_quotas: DataFrame | None = None, rounds: int | None = None,
) -> DataFrame:
    """(row_id, pos): ``total`` rows that fill the cells' quotas cluster-first by quality, in the order they are taken.

    Forced rows come first and count towards their cell and sub-region. Then each cell takes
    its sub-regions' quotas and what is left of its own, each time in turn over the clusters;
    what cells can't fill is taken globally from the least used clusters. Beyond ``total``
    forced rows and then the first taken stay. ``rounds`` ends each phase's turns early, which
    may leave fewer than ``total`` rows. Phases are running places over ranges, not loops; each
    phase's result is kept in the shared folder for the next, so a lost executor costs no rerun.
    """
    key = [row_id]
    base = kept(df.select(row_id, cell, cluster, quality, *([sub] if sub else [])))
    no_cell = F.lit(None).cast(df.schema[cell].dataType).alias("major")
    none = base.limit(0).select(row_id, F.lit(0).alias("phase"), no_cell, F.lit(0).alias("minor"), F.lit(0).alias("nth"))
    taken = none
    if forced is not None:
        first = running(base.join(forced, row_id).select(row_id, "forced_pos"), [], [F.col("forced_pos"), F.col(row_id)], "nth")
        taken = kept(first.select(row_id, F.lit(0).alias("phase"), no_cell, F.lit(0).alias("minor"), "nth"))
    if sub and sub_quotas is not None:
        used = base.join(taken.select(row_id), key).groupBy(cell, sub).agg(F.count("*").alias("used"))
        open_ = base.join(taken.select(row_id), key, "left_anti").join(sub_quotas, [cell, sub]).join(used, [cell, sub], "left")
        open_ = open_.join(cell_quotas.where("quota > 0").select(cell), cell, "left_semi")
        picked = round_robin(open_, [cell, sub], cluster, quality, row_id, rounds).where(F.col("nth") <= F.col("sub_quota") - F.coalesce("used", F.lit(0)))
        taken = kept(taken.union(picked.select(row_id, F.lit(1).alias("phase"), F.col(cell).alias("major"), F.col(sub).cast("int").alias("minor"), "nth")))
    used = base.join(taken.select(row_id), key).groupBy(cell).agg(F.count("*").alias("used"))
    open_ = base.join(taken.select(row_id), key, "left_anti").join(cell_quotas, cell).join(used, cell, "left")
    picked = round_robin(open_, [cell], cluster, quality, row_id, rounds).where(F.col("nth") <= F.col("quota") - F.coalesce("used", F.lit(0)))
    taken = kept(taken.union(picked.select(row_id, F.lit(1).alias("phase"), F.col(cell).alias("major"), F.lit(1 << 30).alias("minor"), "nth")))
    used = base.join(taken.select(row_id), key).groupBy(cluster).agg(F.count("*").alias("used"))
    short = total - taken.count()
    if short > 0:
        spare = base.join(taken.select(row_id), key, "left_anti").join(used, cluster, "left")
        spare = running(spare, [cluster], [F.desc(quality), F.col(row_id)], "turn").withColumn("turn", F.coalesce("used", F.lit(0)) + F.col("turn"))
        if rounds is not None:
            spare = spare.where(F.col("turn") <= rounds)
        best = spare.orderBy("turn", F.desc(quality), row_id).limit(short).select(row_id, "turn", quality)
        extra = running(best, [], [F.col("turn"), F.desc(quality), F.col(row_id)], "nth")
        taken = taken.union(extra.select(row_id, F.lit(2).alias("phase"), no_cell, F.lit(0).alias("minor"), "nth"))
    placed = running(taken, [], [F.col("phase"), F.col("major"), F.col("minor"), F.col("nth")], "pos")
    return placed.where(F.col("pos") <= total).select(row_id, F.col("pos").cast("int").alias("pos"))


def match_composition(df: DataFrame, pick: Callable[[DataFrame], DataFrame], parts: list[str], target: list[float], *, quality: str = "quality", row_id: str = "row_id", passes: int = 8, step: float = 14.0, tolerance: float = 0.012, extra: tuple[str, ...] = ()) -> tuple[DataFrame, float]:
    """(chosen rows, gap): selections with a price on each part, raised where the selection has too much of it.

    ``pick`` chooses (row_id, ...) from rows with a quality. The driver holds one mean for
    each part and pass; the best pass is kept, with the ``extra`` columns of its rows.
    """
    prices = [0.0] * len(parts)
    best, best_gap = None, float("inf")
    for _ in range(passes + 1):
        cost = sum((F.col(p) * x for p, x in zip(parts, prices, strict=True)), F.lit(0.0))
        chosen = kept(pick(df.withColumn(quality, F.col(quality) - cost)).select(row_id, *extra))
        means = df.join(chosen.select(row_id), row_id).agg(*[F.avg(p).alias(p) for p in parts]).first()
        off = [means[p] - t for p, t in zip(parts, target, strict=True)]
        gap = sum(x * x for x in off) ** 0.5
        if gap < best_gap:
            best, best_gap = chosen, gap
        if best_gap < tolerance:
            break
        prices = [x + step * o for x, o in zip(prices, off, strict=True)]
    return best, best_gap


def _settled(prefix: DataFrame, near: DataFrame, k: int, cap: int) -> DataFrame:
    """The places (place) that a walk over ``prefix`` (place, cluster), best first, takes at least ``k`` of, or all it takes.

    ``near`` has the pairs (a, b) of places that exclude each other, b before a. Instead of
    a walk, rounds: a candidate is out once a better one near it is chosen or ``cap`` better ones of its cluster
    are; it is chosen once all better ones near it are out, and those of its cluster that are
    chosen or open leave room. In each round that decides the best open candidate at least.
    """
    state = prefix.select("place", "cluster", F.lit(False).alias("chosen"))
    while True:
        # only the first cap of a cluster are numbered, so no task gets a large cluster
        nth = F.row_number().over(Window.partitionBy("cluster").orderBy("place"))
        room = state.withColumn("nth", nth).where(F.col("nth") <= cap).select("place", F.lit(True).alias("room"))
        full = state.where("chosen").withColumn("nth", nth).where(F.col("nth") <= cap).where(F.col("nth") == cap).select(F.col("cluster").alias("of"), F.col("place").alias("last"))
        better = state.select(F.col("place").alias("b"), F.col("chosen").alias("taken"))
        met = near.join(better, "b").groupBy(F.col("a").alias("place")).agg(F.max("taken").alias("hit"), F.max(~F.col("taken")).alias("waits"))
        out = ~F.col("chosen") & (F.coalesce("hit", F.lit(False)) | F.coalesce(F.col("last") < F.col("place"), F.lit(False)))
        sure = F.col("chosen") | (~F.coalesce("waits", F.lit(False)) & F.coalesce("room", F.lit(False)))
        joined = state.join(met, "place", "left").join(room, "place", "left").join(full, F.col("cluster").eqNullSafe(F.col("of")), "left")
        state = written(joined.where(~out).select("place", "cluster", sure.alias("chosen")))
        first = state.where("not chosen").agg(F.min("place")).first()[0]
        if first is None or state.where(F.col("chosen") & (F.col("place") < first)).limit(k).count() == k:
            return state.where("chosen").select("place")


def diverse_top(ranked: DataFrame, edges: DataFrame | Callable[[DataFrame, float], DataFrame], k: int, *, row_id: str = "row_id", cluster: str = "cluster", quality: str = "quality", cap: int = 3, most_alike: float = 0.65, depth: int = 4000) -> DataFrame:
    """(row_id, pos) of a greedy list: best first, at most ``cap`` a cluster, none more alike than ``most_alike`` to one before.

    ``edges`` has the similarity (a, b, ratio) of candidates, or finds it for the ids and the
    threshold it is called with. Only the best ``depth`` candidates are compared, a number that grows
    fourfold until the list is full or no candidates are left; the list is that of a walk
    over all of them, whatever the depth. A list that stays short is tried again with ``cap + 2`` and
    ``most_alike + 0.15``, up to 1. Nothing but counts comes to the driver.
    """
    placed = running(ranked.select(F.col(row_id).alias("id"), F.col(cluster).alias("cluster"), F.col(quality).alias("quality")), [], [F.desc("quality"), F.col("id")], "place")
    placed = kept(placed)
    rows, found = placed.count(), None
    while True:
        prefix = placed.where(F.col("place") <= depth)
        if found is None:
            ids = prefix.select(F.col("id").alias(row_id))
            pairs = edges(ids, most_alike) if callable(edges) else edges
            side = lambda c: prefix.select(F.col("id").alias(c), F.col("place").alias(f"place_{c}"))
            both = pairs.where(F.col("ratio") > most_alike).join(side("a"), "a").join(side("b"), "b").where("place_a <> place_b")
            found = kept(both.groupBy(F.greatest("place_a", "place_b").alias("a"), F.least("place_a", "place_b").alias("b")).agg(F.max("ratio").alias("ratio")))
        chosen = kept(_settled(prefix, found.where(F.col("ratio") > most_alike) if most_alike < 1 else found.limit(0), k, cap))
        short = chosen.limit(k).count() < k
        if short and depth < rows:
            depth, found = 4 * depth, None
        elif short and most_alike < 1:
            cap, most_alike = cap + 2, min(1.0, most_alike + 0.15)
        else:
            listed = running(chosen, [], [F.col("place")], "pos").where(F.col("pos") <= k)
            return listed.join(placed, "place").select(F.col("id").alias(row_id), F.col("pos").cast("int").alias("pos"))
