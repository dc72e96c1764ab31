"""Queries over descriptors: the letters of part names, types and brands are the sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parsing, scales
from ..functions import sequences as seq
from ..operators import similarity
from ..session import spread, table


def own() -> Column:
    """The sequence."""
    return F.col("s")


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, s) of every part."""
    raw = F.upper(F.concat("p_name", "p_type", "p_brand"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.regexp_replace(raw, f"[^{scales.ALPHABET}]", "").alias("s"))


def _with(spark: SparkSession, sf_dir: str, **columns: Column) -> DataFrame:
    return parts(spark, sf_dir).select("id", *[c.alias(n) for n, c in columns.items()])


def _walked(spark: SparkSession, sf_dir: str, **columns: Column) -> DataFrame:
    """As ``_with``, for columns that walk along sequences: by all cores."""
    return spread(parts(spark, sf_dir)).select("id", *[c.alias(n) for n, c in columns.items()])


def _r(column: Column, digits: int = 6) -> Column:
    return F.round(column, digits) + 0.0  # no negative zero


SEQS = f"""seqs AS (SELECT p_partkey AS id, regexp_replace(upper(p_name || p_type || p_brand), '[^{scales.ALPHABET}]', '', 'g') AS s FROM part),
chars AS (SELECT id, length(s) AS n, i, substr(s, i, 1) AS c FROM (SELECT id, s, unnest(range(1, length(s) + 1)) AS i FROM seqs))"""


def _values(name: str, scale: dict[str, float]) -> str:
    return f"{name}(c, v) AS (VALUES " + ", ".join(f"('{a}', {v}::DOUBLE)" for a, v in scale.items()) + ")"


def composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with(spark, sf_dir, **{f"frac_{a.lower()}": _r(seq.fraction(own(), a)) for a in scales.ALPHABET})


COMPOSITION = f"WITH {SEQS} SELECT id, " + ", ".join(f"round(sum((c = '{a}')::INT) / max(n), 6) AS frac_{a.lower()}" for a in scales.ALPHABET) + " FROM chars GROUP BY id"

MEANS = {"gravy": scales.HYDROPATHY, "eisenberg": scales.EISENBERG, "octanol": scales.OCTANOL, "boman": scales.BOMAN, "helix": scales.HELIX}


def scale_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with(spark, sf_dir, **{name: _r(seq.scale_mean(own(), scale)) for name, scale in MEANS.items()})


SCALE_MEANS = (
    f"WITH {SEQS}, " + ", ".join(_values(f"t_{n}", s) for n, s in MEANS.items())
    + " SELECT id, " + ", ".join(f"round(avg(t_{n}.v), 6) + 0 AS {n}" for n in MEANS) + " FROM chars " + " ".join(f"JOIN t_{n} USING (c)" for n in MEANS) + " GROUP BY id"
)


def charges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with(spark, sf_dir, length=F.length(own()), log_length=_r(F.ln(F.length(own()))), charge=_r(seq.charge(own())), charge_density=_r(seq.charge(own()) / F.length(own())), charge_at_5=_r(seq.charge(own(), 5.0)))


_PKA = "pka(c, p, sign) AS (VALUES " + ", ".join([*[f"('{a}', {p}, 1)" for a, p in scales.PKA_POSITIVE.items()], *[f"('{a}', {p}, -1)" for a, p in scales.PKA_NEGATIVE.items()]]) + ")"


def _charge_sql(ph: str) -> str:
    ends = f"1 / (1 + pow(10::DOUBLE, {ph} - {scales.PKA_FIRST})) - 1 / (1 + pow(10::DOUBLE, {scales.PKA_LAST} - {ph}))"
    return f"({ends} + coalesce(sum(sign / (1 + pow(10::DOUBLE, sign * ({ph} - p)))), 0))"


CHARGES = f"""WITH {SEQS}, {_PKA}
SELECT id, CAST(max(n) AS INT) AS length, round(ln(max(n)), 6) AS log_length, round({_charge_sql('7.4')}, 6) AS charge,
       round({_charge_sql('7.4')} / max(n), 6) AS charge_density, round({_charge_sql('5.0')}, 6) AS charge_at_5
FROM chars LEFT JOIN pka USING (c) GROUP BY id"""


def isoelectric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _walked(spark, sf_dir, isoelectric=_r(seq.isoelectric_point(own())))


ISOELECTRIC = f"""WITH RECURSIVE {SEQS}, {_PKA},
steps AS (
  SELECT id, 0 AS k, 0::DOUBLE AS lo, 14::DOUBLE AS hi FROM seqs
  UNION ALL
  SELECT t.id, t.k + 1, CASE WHEN q.q > 0 THEN (t.lo + t.hi) / 2 ELSE t.lo END, CASE WHEN q.q > 0 THEN t.hi ELSE (t.lo + t.hi) / 2 END
  FROM steps t, LATERAL (SELECT {_charge_sql('((t.lo + t.hi) / 2)')} AS q FROM chars c LEFT JOIN pka USING (c) WHERE c.id = t.id) q WHERE t.k < 40)
SELECT id, round((lo + hi) / 2, 6) AS isoelectric FROM steps WHERE k = 40"""


def moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _walked(spark, sf_dir, moment=_r(seq.moment(own())), moment_beta=_r(seq.moment(own(), 7, 180.0)), moment_full=_r(seq.moment(own(), truncate_tail=False)),
                 amphipathicity=_r(seq.moment(own()) * F.greatest(seq.scale_mean(own(), scales.EISENBERG), F.lit(0.0))))


def _moment_sql(name: str, window: int, angle: float, full: bool = False) -> str:
    some = f"WHERE a.i <= greatest(a.n - {window}, 0) + 1" if full else ""
    return f"""{name} AS (SELECT id, max(m) AS {name} FROM (
  SELECT a.id, a.i, sqrt(pow(sum(v * cos(radians({angle}) * (b.i - 1))), 2) + pow(sum(v * sin(radians({angle}) * (b.i - 1))), 2)) / count(*) AS m
  FROM chars a JOIN chars b ON a.id = b.id AND b.i >= a.i AND b.i < a.i + {window} JOIN eis ON eis.c = b.c {some} GROUP BY a.id, a.i) GROUP BY id)"""


MOMENTS = f"""WITH {SEQS}, {_values('eis', scales.EISENBERG)}, {_moment_sql('moment', 11, 100.0)}, {_moment_sql('moment_beta', 7, 180.0)}, {_moment_sql('moment_full', 11, 100.0, True)},
means AS (SELECT id, avg(v) AS e FROM chars JOIN eis USING (c) GROUP BY id)
SELECT id, round(moment, 6) AS moment, round(moment_beta, 6) AS moment_beta, round(moment_full, 6) AS moment_full, round(moment * greatest(e, 0), 6) AS amphipathicity
FROM moment JOIN moment_beta USING (id) JOIN moment_full USING (id) JOIN means USING (id)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with(spark, sf_dir, run_hydrophobic=seq.longest_run(own(), scales.HYDROPHOBIC), run_positive=seq.longest_run(own(), scales.POSITIVE), run_identical=seq.longest_repeat(own()),
                 positive_window=seq.most_in_window(own()).cast("int"), **{f"count_{a.lower()}": seq.count_of(own(), a) for a in "CMPG"})


def _run_sql(name: str, members: str) -> str:
    return f"""{name} AS (SELECT id, max(k) AS {name} FROM (SELECT id, g, count(*) AS k FROM (
  SELECT id, i - row_number() OVER (PARTITION BY id ORDER BY i) AS g FROM chars WHERE contains('{members}', c)) GROUP BY id, g) GROUP BY id)"""


RUNS = f"""WITH {SEQS}, {_run_sql('hyd', scales.HYDROPHOBIC)}, {_run_sql('pos', scales.POSITIVE)},
same AS (SELECT id, max(k) AS same FROM (SELECT id, c, g, count(*) AS k FROM (
  SELECT id, c, i - row_number() OVER (PARTITION BY id, c ORDER BY i) AS g FROM chars) GROUP BY id, c, g) GROUP BY id),
wins AS (SELECT id, max(k) AS win FROM (SELECT id, sum(contains('{scales.POSITIVE}', c)::INT) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS k FROM chars) GROUP BY id),
counts AS (SELECT id, {', '.join(f"CAST(sum((c = '{a}')::INT) AS INT) AS count_{a.lower()}" for a in 'CMPG')} FROM chars GROUP BY id)
SELECT s.id, CAST(coalesce(hyd, 0) AS INT) AS run_hydrophobic, CAST(coalesce(pos, 0) AS INT) AS run_positive, CAST(same AS INT) AS run_identical, CAST(win AS INT) AS positive_window, counts.* EXCLUDE (id)
FROM seqs s LEFT JOIN hyd USING (id) LEFT JOIN pos USING (id) JOIN same USING (id) JOIN wins USING (id) JOIN counts USING (id)"""

#: A made-up pair table: the published one is a parameter of the operator.
PAIR_WEIGHTS = {a + b: round(((i * 7 + j * 3) % 11) * 4.5 - 12, 2) for i, a in enumerate("AEGLR") for j, b in enumerate("DKNST")}


def class_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lys, both = seq.fraction(own(), "K"), seq.fraction(own(), scales.POSITIVE)
    return _with(spark, sf_dir, frac_positive=_r(both), frac_negative=_r(seq.fraction(own(), scales.NEGATIVE)), frac_hydrophobic=_r(seq.fraction(own(), scales.HYDROPHOBIC)),
                 frac_aromatic=_r(seq.fraction(own(), scales.AROMATIC)), frac_small=_r(seq.fraction(own(), scales.SMALL)), aliphatic=_r(seq.aliphatic_index(own())),
                 lys_share=_r(lys / F.greatest(both, F.lit(1e-9))), pair_index=_r(seq.pair_weight_index(own(), PAIR_WEIGHTS)))


def _share(members: str) -> str:
    return f"(sum(contains('{members}', c)::INT) / max(n))"


CLASS_FRACTIONS = f"""WITH {SEQS}, pairs AS (SELECT id, n, c || lead(c) OVER (PARTITION BY id ORDER BY i) AS p FROM chars),
weights(p, v) AS (VALUES {', '.join(f"('{p}', {v}::DOUBLE)" for p, v in PAIR_WEIGHTS.items())}),
indexed AS (SELECT id, 10 / max(n) * sum(coalesce(v, 1)) AS x FROM pairs LEFT JOIN weights USING (p) WHERE p IS NOT NULL GROUP BY id),
shares AS (SELECT id, {_share('KR')} AS pos, {_share('DE')} AS neg, {_share(scales.HYDROPHOBIC)} AS hyd, {_share('FWY')} AS aro, {_share('AGST')} AS small,
  100 * ({_share('A')} + 2.9 * {_share('V')} + 3.9 * {_share('IL')}) AS ali, {_share('K')} AS lys FROM chars GROUP BY id)
SELECT id, round(pos, 6) AS frac_positive, round(neg, 6) AS frac_negative, round(hyd, 6) AS frac_hydrophobic, round(aro, 6) AS frac_aromatic, round(small, 6) AS frac_small,
  round(ali, 6) AS aliphatic, round(lys / greatest(pos, 1e-9), 6) AS lys_share, round(x, 6) AS pair_index FROM shares JOIN indexed USING (id)"""


def face(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _walked(spark, sf_dir, face=_r(seq.face_fraction(own())))


FACE = f"""WITH {SEQS}, {_values('eis', scales.EISENBERG)},
dirs AS (SELECT id, sum(v * cos(radians(100) * (i - 1))) AS x, sum(v * sin(radians(100) * (i - 1))) AS y FROM chars JOIN eis USING (c) GROUP BY id)
SELECT id, round(avg(contains('{scales.HYDROPHOBIC}', c)::INT), 6) AS face FROM chars JOIN dirs USING (id)
WHERE cos(radians(100) * (i - 1)) * x + sin(radians(100) * (i - 1)) * y >= -1e-12 GROUP BY id"""


def motif_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with(spark, sf_dir, hard_pair=seq.has_hard_pair(own()), amide_pair=seq.has_amide_pair(own()), loose=seq.loosely_buildable(own()), has_c=own().contains("C"), starts_q=own().startswith("Q"))


MOTIF_FLAGS = f"""WITH {SEQS}, {_run_sql('sheet', scales.SHEET_PRONE)},
same AS (SELECT id, max(k) AS same FROM (SELECT id, c, g, count(*) AS k FROM (
  SELECT id, c, i - row_number() OVER (PARTITION BY id, c ORDER BY i) AS g FROM chars) GROUP BY id, c, g) GROUP BY id)
SELECT s.id, regexp_matches(s, 'D[GASTCRDN]|NG') AS hard_pair, contains(s, 'QQ') OR contains(s, 'NN') AS amide_pair,
  NOT contains(s, 'C') AND same <= 4 AND coalesce(sheet, 0) <= 6 AS loose, contains(s, 'C') AS has_c, starts_with(s, 'Q') AS starts_q
FROM seqs s LEFT JOIN sheet USING (id) JOIN same USING (id)"""


def synthesis_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with(spark, sf_dir, risk=_r(seq.risk(own())), envelope=_r(seq.envelope(own())), strict=seq.strictly_buildable(own()))


def _band_sql(value: str, lo: float, hi: float, width: float) -> str:
    return f"least(greatest(0, least(1, ({value} - ({lo} - {width})) / {width})), greatest(0, least(1, (({hi} + {width}) - {value}) / {width})))"


_ENVELOPE_SQL = {"eisenberg": "e", "gravy": "g", "hydrophobic": "hyd", "charge_density": "q / n", "leu": "leu", "lys": "lys", "arg_share": "arg / greatest(lys + arg, 1e-9)", "aromatic": "aro", "length": "n"}
SYNTHESIS_SCORES = f"""WITH {SEQS}, {_PKA}, {_values('kd', scales.HYDROPATHY)}, {_values('eis', scales.EISENBERG)},
{_run_sql('sheet', scales.SHEET_PRONE)}, {_run_sql('rr', 'R')}, {_run_sql('gg', 'G')},
same AS (SELECT id, max(k) AS same FROM (SELECT id, c, g, count(*) AS k FROM (
  SELECT id, c, i - row_number() OVER (PARTITION BY id, c ORDER BY i) AS g FROM chars) GROUP BY id, c, g) GROUP BY id),
wins AS (SELECT id, max(k) AS win FROM (SELECT id, sum(contains('KR', c)::INT) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS k FROM chars) GROUP BY id),
facts AS (SELECT id, max(n) AS n, avg(kd.v) AS g, avg(eis.v) AS e, {_charge_sql('7.4')} AS q, {_share(scales.HYDROPHOBIC)} AS hyd, {_share('FWY')} AS aro, {_share('L')} AS leu, {_share('K')} AS lys,
  {_share('R')} AS arg, {_share(scales.SHEET_FORMERS)} AS former, sum((c = 'C')::INT) AS n_c, sum((c = 'M')::INT) AS n_m
  FROM chars JOIN kd USING (c) JOIN eis USING (c) LEFT JOIN pka USING (c) GROUP BY id),
flags AS (SELECT id, s, regexp_matches(s, 'D[GASTCRDN]|NG') AS hard, contains(s, 'QQ') OR contains(s, 'NN') AS amide FROM seqs)
SELECT f.id, round(least(3, greatest(0, 0.35 * n_c + 0.10 * n_m + 0.15 * hard::INT + 0.15 * amide::INT + 0.12 * greatest(0, same - 3) + 0.12 * greatest(0, coalesce(sheet, 0) - 4)
  + 0.08 * greatest(0, coalesce(rr, 0) - 2) + 0.08 * greatest(0, coalesce(gg, 0) - 2) + 0.20 * greatest(0, g - 0.5) + 0.20 * greatest(0, 2 - q) + 0.03 * greatest(0, n - 26))), 6) AS risk,
  round(({' + '.join(f"{w} * {_band_sql(_ENVELOPE_SQL[k], lo, hi, width)}" for k, (w, lo, hi, width) in scales.ENVELOPE.items())}) / {sum(t[0] for t in scales.ENVELOPE.values())}, 6) AS envelope,
  n_c + n_m = 0 AND NOT starts_with(s, 'Q') AND NOT hard AND NOT amide AND n BETWEEN 11 AND 26 AND same <= 3 AND coalesce(sheet, 0) <= 5 AND win <= 4 AND former <= 0.42 AND q >= 2 AND g <= 1 AS strict
FROM facts f JOIN flags USING (id) LEFT JOIN sheet USING (id) LEFT JOIN rr USING (id) LEFT JOIN gg USING (id) JOIN same USING (id) JOIN wins USING (id)"""


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _walked(spark, sf_dir, length_bin=seq.bin_of(F.length(own()), scales.LENGTH_EDGES), charge_bin=seq.bin_of(seq.charge(own()), scales.CHARGE_EDGES), moment_bin=seq.bin_of(seq.moment(own()), scales.MOMENT_EDGES))


def _bin_sql(value: str, edges: list[float]) -> str:
    return "(" + " + ".join(f"({value} > {e})::INT" for e in edges) + ")"


CELLS = f"""WITH {SEQS}, {_PKA}, {_values('eis', scales.EISENBERG)}, {_moment_sql('moment', 11, 100.0)},
charged AS (SELECT id, max(n) AS n, {_charge_sql('7.4')} AS q FROM chars LEFT JOIN pka USING (c) GROUP BY id)
SELECT id, {_bin_sql('n', scales.LENGTH_EDGES)} AS length_bin, {_bin_sql('q', scales.CHARGE_EDGES)} AS charge_bin, {_bin_sql('moment', scales.MOMENT_EDGES)} AS moment_bin FROM charged JOIN moment USING (id)"""


def gram_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = similarity.gram_counts(spread(parts(spark, sf_dir)), "id", "s", 2)
    return counts.select("id", "gram", _r(F.col("n") / F.col("all")).alias("freq"))


GRAM_FREQUENCIES = f"""WITH {SEQS}, pairs AS (SELECT id, n, c || lead(c) OVER (PARTITION BY id ORDER BY i) AS gram FROM chars)
SELECT id, gram, round(count(*) / (max(n) - 1), 6) AS freq FROM pairs WHERE gram IS NOT NULL GROUP BY id, gram"""


def sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts(spark, sf_dir).select("id", similarity.sketch_key()("s").alias("cluster"))


def _fold_sql() -> str:
    out = f"{scales.SKETCH_START}::UHUGEINT"
    for k in range(4):
        out = f"((xor({out}, m{k}::UHUGEINT) * {scales.SKETCH_FACTOR}::UHUGEINT) % 18446744073709551616::UHUGEINT)"
    return f"CAST({out} % 4194304::UHUGEINT AS BIGINT)"


SKETCHES = f"""WITH {SEQS}, codes AS (
  SELECT id, (ascii(c)::UHUGEINT * 961 + ascii(lead(c, 1) OVER w)::UHUGEINT * 31 + ascii(lead(c, 2) OVER w)::UHUGEINT) AS code, lead(c, 2) OVER w AS last FROM chars WINDOW w AS (PARTITION BY id ORDER BY i)),
mins AS (SELECT id, {', '.join(f"min(xor((code * {a}::UHUGEINT) % 18446744073709551616::UHUGEINT, {b}::UHUGEINT)) AS m{k}" for k, (a, b) in enumerate(scales.SKETCH))} FROM codes WHERE last IS NOT NULL GROUP BY id)
SELECT id, {_fold_sql()} AS cluster FROM mins"""


def indel_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("seq_a")).distinct()
    left, right = names.select(F.col("seq_a").alias("a"), "seq_a"), names.select(F.col("seq_a").alias("b"), F.col("seq_a").alias("seq_b"))
    return similarity.similar_pairs(left, right, 0.75).where("a < b").select("a", "b", _r(F.col("ratio")).alias("ratio"))


INDEL_PAIRS = """WITH RECURSIVE names AS (SELECT DISTINCT p_name AS s FROM part),
pairs AS (SELECT a.s AS a, b.s AS b FROM names a JOIN names b ON a.s < b.s),
walk AS (
  SELECT a, b, 0 AS i, list_transform(range(0, length(b) + 1), lambda x: 0::BIGINT) AS line FROM pairs
  UNION ALL
  SELECT a, b, i + 1, list_reduce(list_concat([[0::BIGINT]], list_transform(range(1, length(b) + 1), lambda j: [
      greatest(line[j + 1], CASE WHEN substr(a, i + 1, 1) = substr(b, j, 1) THEN line[j] + 1 ELSE 0 END)])),
      lambda t, x: list_append(t, greatest(t[len(t)], x[1])))
  FROM walk WHERE i < length(a))
SELECT a, b, round(2 * line[len(line)] / (length(a) + length(b)), 6) AS ratio FROM walk WHERE i = length(a) AND 2 * line[len(line)] / (length(a) + length(b)) > 0.75"""


def clean_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parts(spark, sf_dir).select("id", parsing.clean_sequence(own()).alias("sequence")).where(parsing.is_sequence(F.col("sequence"), 12, 20))
    return rows.groupBy("sequence").agg(F.min("id").alias("id")).select("id", "sequence")


CLEAN_PARTS = f"WITH {SEQS} SELECT min(id) AS id, s AS sequence FROM seqs WHERE length(s) BETWEEN 12 AND 20 GROUP BY s"


def molecular_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    weight = seq.mass_residue_total(own(), parsing.MASSES, parsing.WATER)
    return _with(spark, sf_dir, weight=_r(weight, 4), micromolar=_r(parsing.to_micromolar(F.lit(32.0), F.lit("µg/ml"), weight)), passed=_r(parsing.mass_to_molar(F.lit(32.0), F.lit("mmol"), weight)))


MOLECULAR_WEIGHTS = f"""WITH {SEQS}, {_values('mass', parsing.MASSES)}, w AS (SELECT id, sum(v) + {parsing.WATER} AS w FROM chars JOIN mass USING (c) GROUP BY id)
SELECT id, round(w, 4) AS weight, round(32.0::DOUBLE * 1000 / w, 6) AS micromolar, 32.0::DOUBLE AS passed FROM w"""


def descriptor_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole descriptor row of every part, 50 columns, in one projection."""
    found = seq.descriptors(own(), PAIR_WEIGHTS)
    whole = {n for n in found if n.startswith(("count_", "run_")) or n in ("length", "positive_window")}
    return _walked(spark, sf_dir, **{n: c.cast("int") if n in whole else _r(c) for n, c in found.items()})


DESCRIPTOR_ROWS = f"""SELECT a.*, b.gravy, b.eisenberg, b.octanol, b.boman, b.helix, c.length, c.log_length, c.charge, c.charge_density, d.isoelectric, e.moment, e.moment_beta, e.amphipathicity,
  f.run_hydrophobic, f.run_positive, f.run_identical, f.positive_window, f.count_c, f.count_m, f.count_p, f.count_g,
  g.frac_positive, g.frac_negative, g.frac_hydrophobic, g.frac_aromatic, g.frac_small, g.aliphatic, g.lys_share, g.pair_index AS instability, h.face
FROM ({COMPOSITION}) a JOIN ({SCALE_MEANS}) b USING (id) JOIN ({CHARGES}) c USING (id) JOIN ({ISOELECTRIC}) d USING (id) JOIN ({MOMENTS}) e USING (id) JOIN ({RUNS}) f USING (id)
  JOIN ({CLASS_FRACTIONS}) g USING (id) JOIN ({FACE}) h USING (id)"""

QUERIES = {
    "descriptor_rows": (descriptor_rows, DESCRIPTOR_ROWS),
    "composition": (composition, COMPOSITION), "scale_means": (scale_means, SCALE_MEANS), "charges": (charges, CHARGES), "isoelectric_point": (isoelectric, ISOELECTRIC),
    "hydrophobic_moments": (moments, MOMENTS), "letter_runs": (runs, RUNS), "class_fractions": (class_fractions, CLASS_FRACTIONS), "face_fraction": (face, FACE),
    "motif_flags": (motif_flags, MOTIF_FLAGS), "synthesis_scores": (synthesis_scores, SYNTHESIS_SCORES), "property_cells": (cells, CELLS), "gram_frequencies": (gram_frequencies, GRAM_FREQUENCIES),
    "sketch_keys": (sketches, SKETCHES), "indel_pairs_gated": (indel_pairs, INDEL_PAIRS), "clean_dedup_sequences": (clean_parts, CLEAN_PARTS), "molecular_weights": (molecular_weights, MOLECULAR_WEIGHTS),
}
