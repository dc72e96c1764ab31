"""Heads, panels, objectives and their metrics."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scales
from .ranking import running

Scorer = Callable[[Column], Column]


def with_scores(df: DataFrame, seq: str, scorers: dict[str, Scorer], only: Iterable[str] | None = None) -> DataFrame:
    """``df`` with a column for each head; ``only`` names those that are run.

    A head is any function from the sequence to a column: an expression, a vectorised UDF or
    a fitted model's transform.
    """
    return df.withColumns({name: make(F.col(seq)) for name, make in scorers.items() if only is None or name in only})


def ensemble(folds: list[Column]) -> Column:
    """The mean of the folds' predictions."""
    return sum(folds[1:], folds[0]) / len(folds)


def weighted_mean(columns: list[str], weights: dict[str, int], fallback: tuple[str, int] | None = None) -> Column:
    """The mean of the heads that are there, by their strains; the fallback head adds its own."""
    there = [(h, n) for h, n in [*weights.items(), *([fallback] if fallback else [])] if h in columns]
    return sum((F.col(h) * n for h, n in there), F.lit(0.0)) / max(sum(n for _, n in there), 1)


def row_median(columns: list[str]) -> Column:
    """The median over some columns of a row."""
    ordered, n = F.array_sort(F.array(*columns)), len(columns)
    return (F.get(ordered, F.lit((n - 1) // 2)) + F.get(ordered, F.lit(n // 2))) / 2


def panel(df: DataFrame, ceiling: float = 7.0) -> DataFrame:
    """Adds the panel's summaries of the species heads, the hemolysis head ``hc50`` and the safety head ``safe``."""
    neg = [h for h in scales.PANEL_NEGATIVE if h in df.columns]
    pos = [h for h in scales.PANEL_POSITIVE if h in df.columns]

    def mean(heads: list[str], pooled: str) -> Column:
        return ensemble([F.col(h) for h in heads]) if heads else F.col(pooled)

    worst = F.greatest(*neg) if len(neg) > 1 else mean(neg, scales.POOLED_NEGATIVE)
    out = df.withColumns({"log2_mic_neg": mean(neg, scales.POOLED_NEGATIVE), "log2_mic_pos": mean(pos, "mic_gram_pos"), "log2_mic_worst_neg": worst, "log2_hc50": F.least(F.col("hc50"), F.lit(ceiling)), "p_safe": F.col("safe")})
    out = out.withColumn("log2_mic50", 0.75 * F.col("log2_mic_neg") + 0.25 * F.col("log2_mic_pos"))
    return out.withColumn("log2_window", F.col("log2_hc50") - F.greatest(F.col("log2_mic50"), F.lit(-1.0)))


def objective(columns: list[str], name: str = scales.DEFAULT_OBJECTIVE) -> Column:
    """A named objective over heads, panel summaries, ``amp``, ``envelope`` and ``risk``; an unknown name is the default."""
    fallback = (scales.POOLED_NEGATIVE, scales.POOLED_NEGATIVE_STRAINS)
    if name == "therapeutic":
        heads = [h for h in scales.PANEL if h in columns]
        return (
            1.20 * F.col("log2_hc50") - 1.20 * weighted_mean(columns, scales.PANEL, fallback) - 0.50 * F.greatest(F.least(*heads), F.lit(-1.0))
            + 0.90 * F.col("p_safe") + 1.60 * F.col("envelope") + 0.30 * F.col("amp") - 1.30 * F.col("risk")
        )
    chosen = {
        "broad_spectrum": (scales.PANEL, fallback), "gram_pos": ({h: scales.PANEL[h] for h in scales.PANEL_POSITIVE}, None),
        "gram_neg": ({h: scales.PANEL[h] for h in scales.PANEL_NEGATIVE}, fallback), "mdr": (scales.RESISTANT, None),
    }
    name = name if name in chosen else scales.DEFAULT_OBJECTIVE
    heads, extra = chosen[name]
    m, w, s, a, e, r = scales.OBJECTIVES[name]
    worst = F.greatest(*[h for h in heads if h in columns])
    return m * weighted_mean(columns, heads, extra) + w * worst + s * F.col("p_safe") + a * F.col("amp") + e * F.col("envelope") + r * F.col("risk")


def strain_objective(name: str = scales.DEFAULT_OBJECTIVE) -> Column:
    """An objective over the strain model's summaries gram_neg, gram_pos, resistant, median, best and worst (log2)."""
    return {
        "gram_pos": -F.col("gram_pos"), "gram_neg": -F.col("gram_neg"), "mdr": -F.col("resistant"), "therapeutic": -(0.6 * F.col("median") + 0.4 * F.col("best")),
    }.get(name, -(0.65 * F.col("gram_neg") + 0.35 * F.col("gram_pos")) - 0.4 * F.col("worst"))


def quality(potency: str, surrogate: str, *, amp: str = "amp", safe: str = "safe", buildable: str = "buildable", risk: str = "risk", reuse: str = "reuse") -> Column:
    """The quality that ranks within a cell, coarse or for the library by the potency column given."""
    values = {"amp": amp, "potency": potency, "surrogate": surrogate, "safe": safe, "buildable": buildable, "risk": risk, "reuse": reuse}
    return sum((weight * F.col(values[k]).cast("double") for k, weight in scales.COARSE.items()), F.lit(0.0))


def average_ranks(df: DataFrame, value: str, out: str) -> DataFrame:
    """Adds ranks from 1, ties at their mean: counted by value, so equal values meet as one row, and summed up by ranges of values."""
    counts = running(df.groupBy(value).agg(F.count("*").alias("ties")), [], [F.col(value)], "upto", weight="ties")
    return df.join(counts.select(value, (F.col("upto") - (F.col("ties") - 1) / 2).alias(out)), value)


def regression_report(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """One row: n, Spearman correlation, RMSE and R2 over rows that have both."""
    known = df.where(F.col(truth).isNotNull() & F.col(guess).isNotNull() & ~F.isnan(guess))
    ranked = average_ranks(average_ranks(known.select(truth, guess), truth, "rank_a"), guess, "rank_b")
    error = F.pow(F.col(truth) - F.col(guess), 2)
    return ranked.agg(F.count("*").alias("n"), F.corr("rank_a", "rank_b").alias("spearman"), F.sqrt(F.avg(error)).alias("rmse"), (1 - F.avg(error) / F.var_pop(truth)).alias("r2"))


def auroc(df: DataFrame, truth: str, score: str) -> DataFrame:
    """One row: the area under the ROC curve, by average ranks."""
    ranked = average_ranks(df.where(F.col(truth).isNotNull() & F.col(score).isNotNull()).select(truth, score), score, "rank")
    ones, all_ = F.sum(F.col(truth).cast("double")), F.count("*")
    return ranked.agg(F.try_divide(F.sum(F.when(F.col(truth) == 1, F.col("rank"))) - ones * (ones + 1) / 2, ones * (all_ - ones)).alias("auroc"))


def divergence(df: DataFrame, reference: DataFrame, bin_: str, smooth: float = 1.0) -> DataFrame:
    """One row: the Kullback-Leibler divergence of the histogram over ``bin_`` from the reference's, both smoothed."""
    both = df.groupBy(bin_).agg(F.count("*").alias("p")).join(reference.groupBy(bin_).agg(F.count("*").alias("q")), bin_, "full").na.fill(0, ["p", "q"])
    everywhere = Window.partitionBy()
    p = (F.col("p") + smooth) / F.sum(F.col("p") + smooth).over(everywhere)
    q = (F.col("q") + smooth) / F.sum(F.col("q") + smooth).over(everywhere)
    return both.select(p.alias("p"), q.alias("q")).agg(F.sum(F.col("p") * F.ln(F.col("p") / F.col("q"))).alias("kl"))


def tilted_weights(df: DataFrame, combo: list[str], tilt: Column) -> DataFrame:
    """Distinct combinations with counts and weights count * exp(tilt), summing to 1."""
    counts = df.groupBy(*combo).agg(F.count("*").alias("n")).withColumn("raw", F.col("n") * F.exp(tilt))
    return counts.withColumn("weight", F.col("raw") / F.sum("raw").over(Window.partitionBy())).drop("raw")


def top_share(controls: DataFrame, bins: list[str], weight: str = "weight") -> DataFrame:
    """For each bin column the share of the weight that lies in its highest bin."""
    top = controls.agg(*[F.max(b).alias(b) for b in bins])
    marked = controls.join(F.broadcast(top.select(*[F.col(b).alias(f"top_{b}") for b in bins])), F.lit(True))
    return marked.agg(*[(F.sum(F.when(F.col(b) == F.col(f"top_{b}"), F.col(weight)).otherwise(0)) / F.sum(weight)).alias(b) for b in bins])


def agreement(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """One row: how many keys two sources share, and the rank correlation of their values there (null values don't count)."""
    left, right = (df.where(F.col(value).isNotNull()).select(key, F.col(value).alias(n)) for df, n in ((a, "first"), (b, "second")))
    ranked = average_ranks(average_ranks(left.join(right, key).select("first", "second"), "first", "rank_a"), "second", "rank_b")
    return ranked.agg(F.count("*").alias("n"), F.corr("rank_a", "rank_b").alias("spearman"))
