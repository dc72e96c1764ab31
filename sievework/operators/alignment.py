"""Local alignment of pairs in batches, the best hit of each query, and clusters by identity."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequences import grams
from ..session import kept, written
from .ranking import running

MATCH, MISMATCH, OPEN, EXTEND = 2, -1, -3, -1
HIT = "score bigint, matches bigint, columns bigint, span_a bigint, span_b bigint"
CELLS = 1 << 16  # of a batch's diagonal


def _batch(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    """The five numbers of each pair's best local alignment, all pairs at a time along anti-diagonals.

    The best has the highest score; of those the most matches, the fewest columns, then the
    longest span in a, then in b. A cell holds these as digits of one integer, of which all but the score
    stay below the base, so that integer order is that order.
    """
    rows, wide = max(map(len, a)), max(map(len, b))
    base = 1 << int(rows + wide + 1).bit_length()
    kind = np.int64 if 4 * base.bit_length() + int(MATCH * base).bit_length() < 62 else object
    points, equal, column, step_a = base**4, base**3, base**2, base
    left = np.full((len(a), rows), -1, np.int64)
    right = np.full((len(a), wide), -2, np.int64)  # reversed, so that a diagonal is a slice
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        left[i, : len(x)] = x
        right[i, wide - len(y) :] = y[::-1]
    hit, miss = MATCH * points + equal - column + step_a + 1, MISMATCH * points - column + step_a + 1
    low = -(1 << 61) if kind is np.int64 else -(points * points)
    fresh = lambda value: np.full((len(a), rows + 1), value, kind)
    older, last, gap_a, gap_b, best = fresh(0), fresh(0), fresh(low), fresh(low), np.zeros(len(a), kind)
    for d in range(2, rows + wide + 1):
        lo, hi = max(1, d - wide), min(rows, d - 1)
        here, before = slice(lo, hi + 1), slice(lo - 1, hi)
        same = left[:, lo - 1 : hi] == right[:, wide - d + lo : wide - d + hi + 1]
        cell, new_a, new_b = fresh(0), fresh(low), fresh(low)
        new_b[:, here] = np.maximum(last[:, here] + (OPEN * points - column + 1), gap_b[:, here] + (EXTEND * points - column + 1))
        new_a[:, here] = np.maximum(last[:, before] + (OPEN * points - column + step_a), gap_a[:, before] + (EXTEND * points - column + step_a))
        cell[:, here] = np.maximum(np.maximum(older[:, before] + np.where(same, hit, miss).astype(kind), 0), np.maximum(new_a[:, here], new_b[:, here]))
        best = np.maximum(best, cell.max(axis=1))
        older, last, gap_a, gap_b = last, cell, new_a, new_b
    best = best + (base - 1) * column
    return [best // points, best // equal % base, base - 1 - best // column % base, best // step_a % base, best % base]


def local_hits(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """Each pair's best local alignment with affine gaps: score, matches, columns, and how many letters of a and of b it spans; zeros for a null or an empty one."""
    out = np.zeros((len(a), 5), np.int64)
    codes = [[np.frombuffer(s.encode("utf-32-le"), np.uint32).astype(np.int64) if s else np.zeros(0, np.int64) for s in column.fillna("")] for column in (a, b)]
    sizes = np.array([[len(x), len(y)] for x, y in zip(*codes, strict=True)], np.int64).reshape(-1, 2)
    order = [i for i in np.lexsort(sizes.T) if sizes[i].all()]
    at = 0
    while at < len(order):
        count = max(1, CELLS // int(sizes[order[at], 1] + sizes[order[at], 0]))
        part = order[at : at + count]
        found = _batch([codes[0][i] for i in part], [codes[1][i] for i in part])
        out[part] = np.stack(found, axis=1).astype(np.int64)
        at += count
    return pd.DataFrame(out, columns=["score", "matches", "columns", "span_a", "span_b"])


def local_hit():
    """``local_hits`` as a vectorised UDF."""
    return F.pandas_udf(lambda a, b: local_hits(a, b), HIT)


def best_hits(queries: DataFrame, reference: DataFrame, *, k: int = 3, seeds: int = 2) -> DataFrame:
    """(a, b, identity, score, span_a, span_b): of each query (a, seq_a) its best hit among (b, seq_b), if it has any.

    A pair is aligned if it has ``seeds`` grams of ``k`` letters in common on one diagonal. The best
    hit has the highest score, then identity (matches by columns), then the smallest b.
    Ids are unique. Grams that only one side has are dropped before pairs are made, and what a pair shares is counted before it moves.
    """
    def placed(df: DataFrame, row_id: str, seq: str, at: str) -> DataFrame:
        return df.select(row_id, F.posexplode(grams(F.col(seq), k)).alias(at, "gram"))

    met = placed(queries, "a", "seq_a", "i").join(placed(reference, "b", "seq_b", "j"), "gram")
    seeded = met.groupBy("a", "b", (F.col("i") - F.col("j")).alias("diagonal")).count().where(F.col("count") >= seeds).select("a", "b").distinct()
    hits = seeded.join(queries, "a").join(reference, "b").select("a", "b", local_hit()("seq_a", "seq_b").alias("hit")).select("a", "b", "hit.*")
    hits = hits.withColumn("identity", F.col("matches") / F.col("columns"))
    best = F.min_by(F.struct("b", "identity", "score", "span_a", "span_b"), F.struct(-F.col("score"), -F.col("identity"), "b"))
    return hits.groupBy("a").agg(best.alias("best")).select("a", "best.*")


def alike(pairs: DataFrame, nodes: DataFrame, identity: float, coverage: float, shared: int, k: int) -> DataFrame:
    """The pairs (a, b) of places that share ``shared`` distinct grams and whose best local alignment has this identity, and this coverage of both."""
    own = nodes.select("place", "sequence", F.array_distinct(grams(F.col("sequence"), k)).alias("grams"))
    side = lambda c: own.select(F.col("place").alias(c), F.col("sequence").alias(f"seq_{c}"), F.col("grams").alias(f"grams_{c}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b").where(F.size(F.array_intersect("grams_a", "grams_b")) >= shared)
    hits = met.select("a", "b", F.length("seq_a").alias("len_a"), F.length("seq_b").alias("len_b"), local_hit()("seq_a", "seq_b").alias("hit")).select("a", "b", "len_a", "len_b", "hit.*")
    good = (F.col("matches") >= identity * F.col("columns")) & (F.col("span_a") >= coverage * F.col("len_a")) & (F.col("span_b") >= coverage * F.col("len_b"))
    return hits.where(good).select("a", "b")


def identity_clusters(df: DataFrame, *, row_id: str = "row_id", sequence: str = "sequence", identity: float = 0.5, coverage: float = 0.5, k: int = 3, shared: int = 2, first: int = 8) -> DataFrame:
    """(row_id, cluster): each row's representative's id, by greedy clustering of sequences, the longest first, then by id.

    A sequence joins the first representative that it is alike to (``alike``), and is one itself if there
    is none. A row without a sequence is its own cluster. Ids are unique.

    The loop over sequences is replaced by rounds. Sequences that share enough grams share one of
    their rarer ones (all but the last ``shared`` - 1 in order of frequency). In a round, the
    first ``first`` undecided of each gram are its heads. A sequence that is a head of all its
    grams sees all earlier ones it may be alike to: if none is, it is a representative. All others meet only the new representatives, at
    most ``first`` for each gram they have: a large family goes with its first member and
    its pairs are never made. Where few are decided, heads grow fourfold.
    """
    rows = df.select(F.col(row_id).alias("row_id"), F.col(sequence).alias("sequence"))
    distinct = rows.where("sequence is not null").groupBy("sequence").agg(F.min("row_id").alias("row_id"))
    nodes = kept(running(distinct, [], [F.desc(F.length("sequence")), F.col("row_id")], "place"))
    each = nodes.select("place", F.explode(F.array_distinct(grams(F.col("sequence"), k))).alias("gram"))
    often = each.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = Window.partitionBy("place").orderBy("n", "gram")
    ordered = each.join(often, "gram").withColumn("nth", F.row_number().over(rarest)).withColumn("all", F.count("*").over(Window.partitionBy("place")))
    tokens = kept(ordered.where(F.col("nth") <= F.col("all") - shared + 1).select("place", "gram"))
    wanted = tokens.groupBy("place").agg(F.count("*").alias("wanted"))
    state = kept(nodes.select("place", F.lit(None).cast("bigint").alias("rep")))
    undecided, checked = state.count(), lambda pairs: alike(pairs.distinct(), nodes, identity, coverage, shared, k)
    while undecided:
        live = state.where("rep is null").select("place")
        nth = F.row_number().over(Window.partitionBy("gram").orderBy("place"))
        heads = kept(tokens.join(live, "place", "left_semi").withColumn("nth", nth).where(F.col("nth") <= first).select("gram", "place"))
        counted = heads.groupBy("place").agg(F.count("*").alias("seen"))
        seeing = live.join(wanted, "place", "left").join(counted, "place", "left").where(F.coalesce("wanted", F.lit(0)) == F.coalesce("seen", F.lit(0))).select("place")
        mine = heads.join(seeing, "place", "left_semi").select("gram", F.col("place").alias("a"))
        blocked = checked(mine.join(heads.select("gram", F.col("place").alias("b")), "gram").where("b < a").select("a", "b"))
        elected = kept(seeing.join(blocked.select(F.col("a").alias("place")), "place", "left_anti"))
        calls = heads.join(elected, "place", "left_semi").select("gram", F.col("place").alias("b"))
        open_ = tokens.join(state.where("rep is null or rep <> place"), "place").select("gram", F.col("place").alias("a"), "rep")
        joins = checked(open_.join(calls, "gram").where("b < a and (rep is null or b < rep)").select("a", "b"))
        found = joins.groupBy(F.col("a").alias("place")).agg(F.min("b").alias("found")).unionByName(elected.select("place", F.col("place").alias("found")))
        state = written(state.join(found, "place", "left").select("place", F.least("rep", "found").alias("rep")))
        left = state.where("rep is null").count()
        first, undecided = 4 * first if undecided - left < left else first, left
    names = nodes.select("sequence", "place").join(state, "place").select("sequence", F.col("rep").alias("of"))
    by_sequence = names.join(nodes.select(F.col("place").alias("of"), F.col("row_id").alias("cluster")), "of").select("sequence", "cluster")
    return rows.join(by_sequence, "sequence", "left").select(F.col("row_id").alias(row_id), F.coalesce("cluster", "row_id").alias("cluster"))
