"""Queries that select: quotas by cell, cluster-first picks, price loop, diverse top-k, checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scales
from ..functions import sequences as seq
from ..functions.sequences import bin_of
from ..operators import learning, selection, similarity, validation
from ..session import kept, table
from . import cascade
from .sequence_queries import SEQS, SKETCHES, SYNTHESIS_SCORES, parts
from .table_queries import _CELLED


def _pool(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents as candidates (row_id, cell, cluster, quality), and the reference: those of good quality."""
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("row_id"), F.concat_ws("/", "lang", bin_of(F.col("n_chars"), [500, 2000, 8000]).cast("string")).alias("cell"), F.col("source").alias("cluster"), F.col("n_chars").cast("double").alias("quality")
    )
    good = docs.join(table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("row_id")), "row_id")
    return docs, good


def _total(spark: SparkSession, sf_dir: str) -> int:
    return table(spark, sf_dir, "documents").count() // 5


def quota_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.quotas(_pool(spark, sf_dir)[1], "cell", _total(spark, sf_dir))


_QUOTAS = f"""{_CELLED}, total AS (SELECT count(*) // 5 AS t FROM documents), grid AS (SELECT cell, count(*) AS n FROM celled JOIN labels USING (doc_id) WHERE quality = 1 GROUP BY cell),
shares AS (SELECT cell, greatest(n / sum(n) OVER (), 0.0004) AS share FROM grid), rounded AS (SELECT cell, t, CAST(round_even(t * share / sum(share) OVER (), 0) AS BIGINT) AS q FROM shares, total),
placed AS (SELECT cell, q, t - sum(q) OVER () AS drift, row_number() OVER (ORDER BY q DESC, cell) - 1 AS k, count(*) OVER () AS m FROM rounded),
quotas AS (SELECT cell, CAST(q + sign(drift) * (abs(drift) // m + (k < abs(drift) % m)::INT) AS BIGINT) AS quota FROM placed)"""
QUOTA_TABLE = f"WITH {_QUOTAS} SELECT cell, quota FROM quotas"


def quota_roundrobin(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, good = _pool(spark, sf_dir)
    wanted = selection.quotas(good, "cell", _total(spark, sf_dir))
    picked = selection.round_robin(docs, ["cell"], "cluster", "quality", "row_id").join(wanted, "cell").where("nth <= quota")
    return picked.select(F.col("row_id").alias("doc_id"), "cell", "nth")


_TURNS = "turns AS (SELECT doc_id, cell, source, n_chars, row_number() OVER (PARTITION BY cell, source ORDER BY n_chars DESC, doc_id) AS turn FROM celled)"
QUOTA_ROUNDROBIN = f"""WITH {_QUOTAS}, {_TURNS}, ordered AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY turn, n_chars DESC, doc_id) AS nth FROM turns)
SELECT doc_id, cell, nth FROM ordered JOIN quotas USING (cell) WHERE nth <= quota"""


def full_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, good = _pool(spark, sf_dir)
    total = _total(spark, sf_dir)
    wanted = selection.quotas(good, "cell", total)
    forced = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("row_id"), F.col("doc_id").alias("forced_pos"))
    return selection.select(docs, wanted, total, forced=forced).select(F.col("row_id").alias("doc_id"), "pos")


FULL_SELECTION = f"""WITH {_QUOTAS}, forced AS (SELECT c.*, row_number() OVER (ORDER BY doc_id) AS nth FROM celled c JOIN labels USING (doc_id) WHERE toxic = 1),
open AS (SELECT * FROM celled WHERE doc_id NOT IN (SELECT doc_id FROM forced)), used AS (SELECT cell, count(*) AS u FROM forced GROUP BY cell),
turned AS (SELECT *, row_number() OVER (PARTITION BY cell, source ORDER BY n_chars DESC, doc_id) AS turn FROM open),
ordered AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY turn, n_chars DESC, doc_id) AS nth FROM turned),
filled AS (SELECT o.doc_id, o.cell, o.source, o.nth FROM ordered o JOIN quotas USING (cell) LEFT JOIN used USING (cell) WHERE nth <= quota - coalesce(u, 0)),
taken AS (SELECT doc_id, source, 0 AS phase, NULL AS cell, nth FROM forced UNION ALL SELECT doc_id, source, 1, cell, nth FROM filled),
by_source AS (SELECT source, count(*) AS u FROM taken GROUP BY source),
spare AS (SELECT doc_id, n_chars, coalesce(u, 0) + row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS turn FROM celled LEFT JOIN by_source USING (source) WHERE doc_id NOT IN (SELECT doc_id FROM taken)),
extra AS (SELECT doc_id, row_number() OVER (ORDER BY turn, n_chars DESC, doc_id) AS nth FROM spare),
everyone AS (SELECT doc_id, phase, cell, nth FROM taken UNION ALL SELECT doc_id, 2, NULL, nth FROM extra WHERE nth <= (SELECT t FROM total) - (SELECT count(*) FROM taken)),
final AS (SELECT doc_id, CAST(row_number() OVER (ORDER BY phase, cell, nth) AS INT) AS pos FROM everyone)
SELECT doc_id, pos FROM final WHERE pos <= (SELECT t FROM total)"""


def split_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, good = _pool(spark, sf_dir)
    return selection.split_quotas(good, "cell", "cluster", selection.quotas(good, "cell", _total(spark, sf_dir)))


SPLIT_QUOTAS = f"""WITH {_QUOTAS}, counts AS (SELECT cell, source AS cluster, count(*) AS n FROM celled JOIN labels USING (doc_id) WHERE quality = 1 GROUP BY ALL),
floors AS (SELECT cell, cluster, n, quota, CAST(floor(n * quota / sum(n) OVER (PARTITION BY cell)) AS BIGINT) AS f FROM counts JOIN quotas USING (cell))
SELECT cell, cluster, f + (row_number() OVER (PARTITION BY cell ORDER BY n DESC, cluster) <= quota - sum(f) OVER (PARTITION BY cell))::INT AS sub_quota FROM floors"""


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct part sequences with cells, sketch clusters, quality and composition."""
    own = F.col("s")
    rows = parts(spark, sf_dir).groupBy("s").agg(F.min("id").alias("row_id"))
    cell = bin_of(F.length(own), scales.LENGTH_EDGES) * 100 + bin_of(seq.charge(own), scales.CHARGE_EDGES) * 10 + bin_of(seq.moment(own), scales.MOMENT_EDGES)
    return rows.select("row_id", F.col("s").alias("sequence"), cell.alias("cell"), similarity.sketch_key()("s").alias("cluster"), (seq.envelope(own) - 0.3 * seq.risk(own)).alias("quality"),
                       *[seq.fraction(own, a).alias(f"frac_{a}") for a in scales.ALPHABET])


def composition_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = kept(_candidates(spark, sf_dir))
    wanted, parts_ = selection.quotas(rows, "cell", 100), [f"frac_{a}" for a in scales.ALPHABET]
    target = rows.agg(*[F.avg(p) for p in parts_]).first()
    chosen, _ = selection.match_composition(rows, lambda df: selection.select(df, wanted, 100), parts_, list(target))
    return chosen.join(rows.select("row_id", "sequence", "cell"), "row_id")


def diverse_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _candidates(spark, sf_dir).select("row_id", "sequence", "cluster", F.round(F.round(seq.envelope(F.col("sequence")), 6) - 0.3 * F.round(seq.risk(F.col("sequence")), 6), 6).alias("quality"))
    rows = kept(rows)
    left, right = rows.select(F.col("row_id").alias("a"), F.col("sequence").alias("seq_a")), rows.select(F.col("row_id").alias("b"), F.col("sequence").alias("seq_b"))
    edges = similarity.similar_pairs(left, right, 0.65).where("a < b")
    return selection.diverse_top(rows, edges, 25).join(rows.select("row_id", "sequence", "quality"), "row_id")


#: A recursion walks the candidates, best first, with the list so far; each try has its own cap and likeness.
DIVERSE_TOP = f"""WITH RECURSIVE scored AS ({SYNTHESIS_SCORES}), keyed AS ({SKETCHES}), firsts AS (WITH {SEQS} SELECT s AS sequence, min(id) AS id FROM seqs GROUP BY s),
valued AS (SELECT id AS row_id, sequence, cluster, round(envelope - 0.3 * risk, 6) AS quality FROM firsts JOIN scored USING (id) JOIN keyed USING (id)),
candidates AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY quality DESC, row_id) AS place FROM valued),
pairs AS (SELECT a.place AS a, b.place AS b, a.sequence AS x, b.sequence AS y FROM candidates a JOIN candidates b ON a.place < b.place AND least(len(a.sequence), len(b.sequence)) >= 0.48 * greatest(len(a.sequence), len(b.sequence))),
walk AS (
  SELECT a, b, x, y, 0 AS i, list_transform(range(0, len(y) + 1), lambda z: 0::BIGINT) AS line FROM pairs
  UNION ALL
  SELECT a, b, x, y, i + 1, list_reduce(list_concat([[0::BIGINT]], list_transform(range(1, len(y) + 1), lambda j: [
      greatest(line[j + 1], CASE WHEN substr(x, i + 1, 1) = substr(y, j, 1) THEN line[j] + 1 ELSE 0 END)])),
      lambda t, v: list_append(t, greatest(t[len(t)], v[1])))
  FROM walk WHERE i < len(x)),
alike AS MATERIALIZED (SELECT a, b, 2 * line[len(line)] / (len(x) + len(y)) AS ratio FROM walk WHERE i = len(x)),
tries AS (SELECT * FROM (VALUES (0, 3, 0.65::DOUBLE), (1, 5, 0.65::DOUBLE + 0.15), (2, 7, 0.65::DOUBLE + 0.15 + 0.15), (3, 9, 1.0::DOUBLE)) v(t, cap, most)),
near AS (SELECT t, b AS place, list(a) AS better FROM alike, tries WHERE ratio > most GROUP BY ALL),
listed AS (
  SELECT t, cap, 0 AS i, CAST([] AS BIGINT[]) AS chosen, CAST([] AS BIGINT[]) AS clusters FROM tries
  UNION ALL
  SELECT l.t, cap, i + 1, CASE WHEN fits THEN list_append(chosen, i + 1) ELSE chosen END, CASE WHEN fits THEN list_append(clusters, cluster) ELSE clusters END
  FROM (SELECT l.*, c.cluster, len(chosen) < 25 AND len(list_filter(clusters, lambda z: z = c.cluster)) < cap AND NOT coalesce(list_has_any(chosen, better), false) AS fits
    FROM listed l JOIN candidates c ON c.place = l.i + 1 LEFT JOIN near n ON n.t = l.t AND n.place = c.place) l),
ends AS (SELECT t, chosen, row_number() OVER (ORDER BY len(chosen) < 25, CASE WHEN len(chosen) < 25 THEN -t ELSE t END) AS best FROM listed WHERE i = (SELECT count(*) FROM candidates))
SELECT row_id, CAST(pos AS INTEGER) AS pos, sequence, quality FROM (SELECT unnest(chosen) AS place, unnest(range(1, len(chosen) + 1)) AS pos FROM ends WHERE best = 1) JOIN candidates USING (place)"""


def invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parts(spark, sf_dir).select("id", F.col("s").alias("sequence"))
    first = rows.where("id % 2 = 0")
    return validation.report(rows, first, rows.where("length(sequence) > 20"), shortest=12, longest=22)


INVARIANTS = f"""WITH {SEQS}, top AS (SELECT * FROM seqs WHERE id % 2 = 0), long AS (SELECT s FROM seqs WHERE length(s) > 20)
SELECT 'library_size' AS "check", count(*) AS value, true AS ok FROM seqs UNION ALL SELECT 'top_size', count(*), true FROM top
UNION ALL SELECT 'library_invalid', v, v = 0 FROM (SELECT count(*) AS v FROM seqs WHERE length(s) NOT BETWEEN 12 AND 22)
UNION ALL SELECT 'library_repeats', v, v = 0 FROM (SELECT count(s) - count(DISTINCT s) AS v FROM seqs)
UNION ALL SELECT 'top_repeats', v, v = 0 FROM (SELECT count(s) - count(DISTINCT s) AS v FROM top)
UNION ALL SELECT 'top_outside_library', v, v = 0 FROM (SELECT count(*) AS v FROM top WHERE s NOT IN (SELECT s FROM seqs))
UNION ALL SELECT 'library_in_reference', v, v = 0 FROM (SELECT count(*) AS v FROM seqs WHERE s IN (SELECT s FROM long))"""


STEPS, STARTS = 12, 2


def cell_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("label").alias("cell"), F.col("embedding").alias("vector"))
    wanted = selection.quotas(vectors, "cell", 1500)
    centroids = kept(learning.cell_centroids(vectors, "cell", "vector", wanted, starts=STARTS, steps=STEPS))
    return similarity.nearest(vectors, centroids.select("cell", "sub", "centroid"), "cell").select(F.col("row_id").alias("vec_id"), "sub")


def _lloyd_sql(n: int) -> str:
    return f"""homes{n} AS MATERIALIZED (SELECT cell, start, id, v, min({{'d': list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(v, c)]), 'sub': sub}}) AS home FROM rows JOIN book{n} USING (cell) GROUP BY ALL),
book{n + 1} AS MATERIALIZED (SELECT b.cell, b.start, b.sub, coalesce(f.c, b.c) AS c FROM book{n} b LEFT JOIN (
  SELECT cell, start, sub, list(m ORDER BY i) AS c FROM (SELECT cell, start, home.sub AS sub, i, avg(v[i]) AS m FROM homes{n}, range(1, 65) t(i) GROUP BY ALL) GROUP BY ALL) f USING (cell, start, sub))"""


CELL_CENTROIDS = f"""WITH rows AS MATERIALIZED (SELECT vec_id AS id, label AS cell, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), sizes AS (SELECT cell, count(*) AS n FROM rows GROUP BY cell),
shares AS (SELECT cell, n, greatest(n / sum(n) OVER (), 0.0004) AS share FROM sizes), rounded AS (SELECT cell, n, CAST(round_even(1500 * share / sum(share) OVER (), 0) AS BIGINT) AS q FROM shares),
placed AS (SELECT cell, n, q, 1500 - sum(q) OVER () AS drift, row_number() OVER (ORDER BY q DESC, cell) - 1 AS k, count(*) OVER () AS m FROM rounded),
wanted AS (SELECT cell, least(12, greatest(1, CAST(q + sign(drift) * (abs(drift) // m + (k < abs(drift) % m)::INT) AS BIGINT) // 40), n) AS k FROM placed),
book0 AS MATERIALIZED (SELECT cell, start, sub, v AS c FROM (SELECT cell, start, v, k, row_number() OVER (PARTITION BY cell, start ORDER BY md5('0:' || start || ':' || id), id) - 1 AS sub FROM rows JOIN wanted USING (cell), range({STARTS}) s(start)) WHERE k > 1 AND sub < k),
{', '.join(_lloyd_sql(n) for n in range(STEPS + 1))},
costs AS (SELECT cell, start, sum(home.d) AS cost FROM homes{STEPS} GROUP BY ALL), best AS (SELECT cell, arg_min(start, cost) AS start FROM costs GROUP BY cell)
SELECT id AS vec_id, CAST(coalesce(home.sub, -1) AS INTEGER) AS sub FROM rows LEFT JOIN best USING (cell) LEFT JOIN homes{STEPS} h USING (cell, start, id)"""


def stub_scorers() -> dict:
    """Deterministic stand-ins for heads whose weights aren't published: linear in a few descriptors."""
    def head(shift: float):
        return lambda s: shift - 0.4 * seq.charge(s) + 2 * seq.scale_mean(s, scales.EISENBERG)

    heads = {name: head(k / 3) for k, name in enumerate([*scales.PANEL, "mic_gram_neg", "mic_gram_pos", "surrogate"])}
    heads |= {"hc50": lambda s: 6 - seq.scale_mean(s, scales.HYDROPATHY), "safe": lambda s: 1 - seq.fraction(s, scales.HYDROPHOBIC), "amp": lambda s: seq.fraction(s, scales.POSITIVE)}
    return heads


def stub_strains() -> dict:
    """Deterministic stand-ins for the strain model's summaries."""
    def head(shift: float):
        return lambda s: shift - 0.3 * seq.charge(s) + 1.5 * seq.fraction(s, scales.HYDROPHOBIC)

    return {name: head(k / 4) for k, name in enumerate(["best", "gram_neg", "median", "gram_pos", "resistant", "worst"])}


def _cascade(spark: SparkSession, sf_dir: str, settings: cascade.Settings) -> DataFrame:
    rows = parts(spark, sf_dir).select(F.col("id").alias("row_id"), F.col("s").alias("sequence"))
    reference = rows.where(F.crc32(F.col("sequence").cast("binary")) % 5 == 0).select("sequence").distinct()
    return cascade.build_library(rows, reference, stub_scorers(), stub_strains(), settings)[0]


def cascade_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small library, all five objectives."""
    return _cascade(spark, sf_dir, cascade.Settings(total=60, top_k=5, shortlist=200))


def cascade_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A library of a third of the distinct sequences, so that quotas and prices choose; all else by default."""
    candidates = parts(spark, sf_dir).select("s").distinct().count()
    return _cascade(spark, sf_dir, cascade.Settings(total=max(1, candidates // 3), top_k=max(1, candidates // 60)))


def price_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.col("p_size").cast("double").alias("size"), F.length("p_name").cast("double").alias("len"), "p_retailprice")
    folded = kept(learning.grouped_folds(rows, "p_brand"))
    guessed = learning.out_of_fold(folded, ["size", "len"], "p_retailprice", depth=3, rounds=5)
    return guessed.select("p_partkey", "fold", F.round("guess", 6).alias("guess"))


QUERIES = {
    "quota_histogram_drift": (quota_table, QUOTA_TABLE), "select_quota_roundrobin": (quota_roundrobin, QUOTA_ROUNDROBIN), "select_forced_topup": (full_selection, FULL_SELECTION), "split_quotas": (split_quotas, SPLIT_QUOTAS),
    "select_match_composition": (composition_match, None), "diverse_top_k": (diverse_top, DIVERSE_TOP), "invariants_report": (invariants, INVARIANTS), "cell_centroids": (cell_centroids, CELL_CENTROIDS), "cascade_library": (cascade_library, None), "cascade_default": (cascade_default, None), "grouped_out_of_fold": (price_model, None),
}
