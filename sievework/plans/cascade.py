"""The whole selection: coarse scores for all, full scores for a shortlist, ranked lists, a matched library."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scales
from ..functions import sequences as seq
from ..operators import learning, ranking, scoring, selection, similarity
from ..session import kept


@dataclass
class Settings:
    """Sizes and thresholds, all in one place."""

    total: int = 50_000
    top_k: int = 100
    shortlist: int = 90_000
    best_of_each: int = 2_000
    walk: int = 2_000
    coarse: tuple[str, ...] = ("amp", "mic_gram_neg", "surrogate", "safe")
    objectives: tuple[str, ...] = ("broad_spectrum", "gram_pos", "gram_neg", "mdr", "therapeutic")
    novelty: float = 0.75
    banned_gram: int = 10
    reuse_gram: int = 6
    floor: float = scales.SAFETY_FLOOR
    strain_weight: float = 0.45
    disagreement: float = 0.25
    log: list[str] = field(default_factory=list)


def score_sequences(df: DataFrame, scorers: dict, name: str = scales.DEFAULT_OBJECTIVE, sequence: str = "sequence") -> DataFrame:
    """``df`` with its heads, panel and one objective as ``score``: row-local, no shuffle."""
    own = F.col(sequence)
    scored = scoring.panel(scoring.with_scores(df, sequence, scorers)).withColumns({"risk": seq.risk(own), "envelope": seq.envelope(own)})
    return scored.withColumn("score", scoring.objective(scored.columns, name))


def with_cell(df: DataFrame, sequence: str = "sequence") -> DataFrame:
    """Adds ``cell``, three bins in one number that sorts as they do."""
    own = F.col(sequence)
    bins = seq.bin_of(F.length(own), scales.LENGTH_EDGES) * 100 + seq.bin_of(seq.charge(own), scales.CHARGE_EDGES) * 10 + seq.bin_of(seq.moment(own), scales.MOMENT_EDGES)
    return df.withColumn("cell", bins)


def eligible(df: DataFrame, reference: DataFrame, settings: Settings) -> DataFrame:
    """Candidates that are strictly buildable, safe and share no long gram with the reference.

    If fewer than four times the list's length are left, all candidates are, which is logged.
    """
    banned = similarity.shares_kmer(df, "sequence", "row_id", reference, "sequence", settings.banned_gram)
    strict = df.where(seq.strictly_buildable(F.col("sequence")) & (F.col("p_safe") >= settings.floor)).join(banned, "row_id", "left_anti")
    if strict.limit(4 * settings.top_k).count() < 4 * settings.top_k:
        settings.log.append("too few strict candidates: ranking all")
        return df
    return strict


def leading(full: DataFrame, settings: Settings) -> DataFrame:
    """The strictly buildable and safe rows of the shortlist that are among the best of any objective.

    If fewer than four times the list's length are such, all rows compete, which is logged.
    """
    open_ = full.where(seq.strictly_buildable(F.col("sequence")) & (F.col("p_safe") >= settings.floor))
    if open_.limit(4 * settings.top_k).count() < 4 * settings.top_k:
        settings.log.append("too few strict leaders: taking all")
        open_ = full
    return full.join(ranking.union_of_best(open_, list(settings.objectives), "row_id", settings.best_of_each), "row_id")


def rescored(leaders: DataFrame, scorers: dict, strains: dict, finer: dict, settings: Settings) -> DataFrame:
    """The leaders with the finer heads in place of those of the same name, and each objective blended by rank with the strain model's."""
    heads = scoring.with_scores(leaders.select("row_id", "sequence", "cluster", "risk", "envelope", *scorers), "sequence", {**finer, **strains})
    out = scoring.panel(heads)
    out = out.withColumns({f"{name}_model": scoring.objective(out.columns, name) for name in settings.objectives})
    out = kept(out.withColumns({f"{name}_strains": scoring.strain_objective(name) for name in settings.objectives}).drop(*strains))
    blends = out.select("row_id")
    for name in settings.objectives:
        q = ranking.rank_blend(out.select("row_id", f"{name}_model", f"{name}_strains"), f"{name}_model", f"{name}_strains", "row_id", settings.strain_weight, settings.disagreement)
        blends = blends.join(kept(q.select("row_id", F.col("blend").alias(name))), "row_id")
    return kept(out.join(blends, "row_id"))


def novel(df: DataFrame, reference: DataFrame, settings: Settings) -> DataFrame:
    """The rows that are no more alike to a reference sequence than ``novelty``."""
    known = reference.select(F.col("sequence").alias("seq_b")).distinct().withColumn("b", F.col("seq_b"))
    near = similarity.similar_pairs(df.select(F.col("row_id").alias("a"), F.col("sequence").alias("seq_a")), known, settings.novelty).select(F.col("a").alias("row_id")).distinct()
    return df.join(near, "row_id", "left_anti")


def ranked_list(df: DataFrame, quality: str, settings: Settings) -> DataFrame:
    """(row_id, pos) of the diverse list by one quality; only candidates that the list may reach are compared."""

    def edges(ids: DataFrame, most_alike: float) -> DataFrame:
        rows = kept(df.select("row_id", "sequence").join(ids, "row_id"))
        left, right = rows.select(F.col("row_id").alias("a"), F.col("sequence").alias("seq_a")), rows.select(F.col("row_id").alias("b"), F.col("sequence").alias("seq_b"))
        return similarity.similar_pairs(left, right, most_alike).where("a < b")

    return kept(selection.diverse_top(df, edges, settings.top_k, quality=quality, depth=settings.walk))


def sub_regions(pool: DataFrame, reference: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pool with ``sub``, sub-quotas): each cell's quota split over k-means regions of its reference members.

    A candidate belongs to the nearest centroid of its cell, or to -1 where the cell has none.
    """
    vector = similarity.composition_vector()("sequence")
    members = reference.select(F.col("sequence").alias("row_id"), "cell", vector.alias("vector"))
    centroids = kept(learning.cell_centroids(members, "cell", "vector", wanted))
    counted = centroids.where("n > 0").select("cell", "sub", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    subs = similarity.nearest(pool.join(centroids.select("cell").distinct(), "cell", "left_semi").select("row_id", "cell", vector.alias("vector")), centroids.select("cell", "sub", "centroid"), "cell")
    placed = pool.join(subs.select("row_id", "sub"), "row_id", "left").withColumn("sub", F.coalesce("sub", F.lit(-1)))
    return placed, selection.split_quotas(counted, "cell", "sub", wanted)


def build_library(pool: DataFrame, reference: DataFrame, scorers: dict, strains: dict, settings: Settings | None = None, finer: dict | None = None) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(library, ranked lists) from candidates (row_id, sequence) and reference sequences.

    Cheap heads rank all candidates within their cell. The shortlist gets all heads and the
    objectives; its leaders, the union of each objective's best, get the ``finer`` heads (which
    replace those of the same name) and the strain model's summaries ``strains``, and the ranked
    lists go by the blend. The library is chosen from all candidates: it holds the lists and
    fills the reference's quotas by sub-region, with prices that pull its mean composition to
    the reference's. The shortlist's better quality is mapped onto the scale of its coarse one.
    """
    settings = settings or Settings()
    own = F.col("sequence")
    fresh = pool.join(reference.select("sequence"), "sequence", "left_anti").groupBy("sequence").agg(F.min("row_id").alias("row_id"))
    known = kept(with_cell(reference.select("sequence")))
    wanted = kept(selection.quotas(known, "cell", settings.total))
    shares = known.groupBy("cell").agg(F.count("*").alias("n")).crossJoin(F.broadcast(known.agg(F.count("*").alias("all")))).select("cell", (F.col("n") / F.col("all")).alias("share"))
    reuse = similarity.kmer_hits(fresh, "sequence", "row_id", reference, "sequence", settings.reuse_gram).withColumnRenamed("hit_fraction", "reuse")
    coarse = with_cell(scoring.with_scores(fresh, "sequence", scorers, settings.coarse)).join(reuse, "row_id")
    coarse = coarse.withColumns({"risk": seq.risk(own), "buildable": seq.loosely_buildable(own).cast("int"), "cluster": similarity.sketch_key()("sequence")})
    coarse = kept(coarse.withColumn("quality", scoring.quality("mic_gram_neg", "surrogate")))
    short = ranking.shortlist(coarse, "cell", "quality", "row_id", shares, settings.shortlist)
    rest = [h for h in scorers if h not in settings.coarse]
    full = scoring.panel(scoring.with_scores(short, "sequence", scorers, rest)).withColumn("envelope", seq.envelope(own))
    full = kept(full.withColumns({name: scoring.objective(full.columns, name) for name in settings.objectives}).withColumn("better", scoring.quality("log2_mic50", "surrogate")))
    leaders = rescored(leading(full, settings), scorers, strains, finer or {}, settings)
    fit = kept(novel(eligible(leaders, reference, settings), reference, settings))
    tops = {name: ranked_list(fit, name, settings) for name in settings.objectives}
    forced = None
    for top in tops.values():
        forced = top.select("row_id") if forced is None else forced.union(top.select("row_id"))
    forced = forced.distinct().withColumn("forced_pos", F.col("row_id"))
    forced = kept(forced)
    mapped = ranking.quantile_map(full.select("row_id", "quality", "better"), "better", "quality", "row_id").select("row_id", "mapped")
    merged = coarse.join(mapped, "row_id", "left").withColumn("quality", F.coalesce("mapped", "quality")).select("row_id", "sequence", "cell", "cluster", "quality")
    placed, sub_quotas = sub_regions(merged, known, wanted)
    fractions = [f"frac_{a}" for a in scales.ALPHABET]
    everyone = kept(placed.withColumns({f: seq.fraction(own, a) for f, a in zip(fractions, scales.ALPHABET, strict=True)}))
    target = known.agg(*[F.avg(seq.fraction(own, a)) for a in scales.ALPHABET]).first()
    sub_quotas = kept(sub_quotas)

    def pick(rows: DataFrame) -> DataFrame:
        return selection.select(rows, wanted, settings.total, forced=forced, sub="sub", sub_quotas=sub_quotas)

    chosen, gap = selection.match_composition(everyone, pick, fractions, list(target), extra=("pos",))
    settings.log.append(f"composition gap {gap:.4f}")
    return chosen.join(everyone.select("row_id", "sequence", "cell"), "row_id"), tops
