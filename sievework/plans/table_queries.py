"""Queries over the shared tables: cleaning, sets, joins, aggregates, ranks, scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parsing, scales
from ..functions.sequences import bin_of
from ..operators import assays, cleaning, ranking, scoring, similarity
from ..session import table


def dedup_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.translate(F.trim("text"), "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("clean"), "lang").where("length(clean) >= 8")
    return cleaning.first_of_each(docs, "clean", "doc_id").select("doc_id", F.md5("clean").alias("digest"), "lang")


DEDUP_TEXTS = """SELECT doc_id, md5(c) AS digest, lang FROM (SELECT doc_id, translate(trim(text), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS c, lang FROM documents)
WHERE length(c) >= 8 QUALIFY row_number() OVER (PARTITION BY c ORDER BY doc_id) = 1"""


def _good_bad(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return tuple(docs.join(labels.where(f"quality = {q}"), "doc_id").select("doc_id", "text") for q in (1, 0))


_GOOD_BAD = """good AS (SELECT doc_id, text FROM documents JOIN labels USING (doc_id) WHERE quality = 1),
bad AS (SELECT doc_id, text FROM documents JOIN labels USING (doc_id) WHERE quality = 0)"""


def negatives_minus_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, bad = _good_bad(spark, sf_dir)
    return cleaning.minus(bad, good, "text").select("doc_id")


NEGATIVES = f"WITH {_GOOD_BAD} SELECT doc_id FROM bad WHERE text NOT IN (SELECT text FROM good)"


def overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, bad = _good_bad(spark, sf_dir)
    rest = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")
    return cleaning.within(rest, good.unionByName(bad), "text").select("doc_id")


OVERLAP = f"WITH {_GOOD_BAD} SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND text IN (SELECT text FROM good UNION SELECT text FROM bad)"


def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    a, b = part.where("p_size <= 25").select("p_name"), part.where("p_retailprice > 1000").select("p_name")
    kinds = {"union_all": a.union(b), "union": a.union(b).distinct(), "intersect": a.intersect(b), "except": a.exceptAll(b)}
    out = [df.groupBy("p_name").agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "p_name", "n") for k, df in kinds.items()]
    return out[0].union(out[1]).union(out[2]).union(out[3])


SET_OPERATIONS = """WITH a AS (SELECT p_name FROM part WHERE p_size <= 25), b AS (SELECT p_name FROM part WHERE p_retailprice > 1000)
SELECT 'union_all' AS kind, p_name, count(*) AS n FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY p_name
UNION ALL SELECT 'union', p_name, 1 FROM (SELECT * FROM a UNION SELECT * FROM b)
UNION ALL SELECT 'intersect', p_name, 1 FROM (SELECT * FROM a INTERSECT SELECT * FROM b)
UNION ALL SELECT 'except', p_name, count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) GROUP BY p_name"""


def _readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("l_quantity").cast("int").cast("string")
    raw = (
        F.when(F.col("l_returnflag") == "A", F.concat(F.lit(">"), number)).when(F.col("l_linenumber") == 1, F.concat(F.lit("≥"), number))
        .when(F.col("l_linenumber") == 2, F.concat(number, F.lit(",5"))).when(F.col("l_linenumber") == 3, F.concat(number, F.lit(".25-99")))
        .when(F.col("l_linenumber") == 4, F.lit("n/a")).when(F.col("l_linenumber") == 5, F.concat(F.lit(" <"), number)).otherwise(number)
    )
    unit = F.when(F.col("l_linestatus") == "F", "µM").when(F.col("l_linenumber") > 5, "pH").otherwise("µg/ml")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", raw.alias("raw"), unit.alias("unit"))


_READINGS = """readings AS (SELECT l_orderkey, l_linenumber, l_suppkey,
  CASE WHEN l_returnflag = 'A' THEN '>' || q WHEN l_linenumber = 1 THEN '≥' || q WHEN l_linenumber = 2 THEN q || ',5' WHEN l_linenumber = 3 THEN q || '.25-99'
       WHEN l_linenumber = 4 THEN 'n/a' WHEN l_linenumber = 5 THEN ' <' || q ELSE q END AS raw,
  CASE WHEN l_linestatus = 'F' THEN 'µM' WHEN l_linenumber > 5 THEN 'pH' ELSE 'µg/ml' END AS unit
  FROM (SELECT *, CAST(CAST(l_quantity AS INT) AS VARCHAR) AS q FROM lineitem)),
parsed AS (SELECT *, TRY_CAST(nullif(regexp_extract(replace(regexp_replace(trim(raw), '^[><≥≤=~ ]+', ''), ',', '.'), '^([0-9]+(\\.[0-9]+)?)', 1), '') AS DOUBLE) AS value,
  regexp_matches(trim(raw), '^[>≥]') AS censored FROM readings)"""


def concentrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.col("raw")
    value = parsing.concentration(raw)
    return _readings(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_suppkey", value.alias("value"), parsing.is_censored(raw).alias("censored"),
        F.round(parsing.to_micromolar(value, F.col("unit"), F.lit(2500.0)), 6).alias("strict"), F.round(parsing.mass_to_molar(value, F.col("unit"), F.lit(2500.0)), 6).alias("lenient"),
        parsing.ceiling_rule(value, parsing.is_censored(raw), 32.0).alias("capped"))


CONCENTRATIONS = f"""WITH {_READINGS}
SELECT l_orderkey, l_linenumber, l_suppkey, value, censored,
  round(CASE WHEN unit = 'µM' THEN value WHEN unit = 'µg/ml' THEN value * 1000 / 2500 END, 6) AS strict, round(CASE WHEN unit = 'µg/ml' THEN value * 1000 / 2500 ELSE value END, 6) AS lenient,
  CASE WHEN NOT censored THEN value WHEN value >= 32 THEN 32.0 END AS capped FROM parsed"""


def species_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    species = F.concat_ws(" ", F.when(F.col("p_size") > 25, "Bacillus").otherwise("Escherichia"), "p_name", "p_brand")
    return table(spark, sf_dir, "part").select("p_partkey", parsing.first_words(species).alias("species"), parsing.gram_of(species).alias("gram"),
        parsing.header_field(F.concat(F.lit("x activity="), "p_type"), "activity").alias("activity"), F.col("p_brand").startswith("Brand#1").cast("int").alias("flag"))


SPECIES_FIELDS = """SELECT p_partkey, CASE WHEN p_size > 25 THEN 'Bacillus' ELSE 'Escherichia' END || ' ' || string_split(p_name, ' ')[1] AS species, CASE WHEN p_size > 25 THEN '+' ELSE '-' END AS gram,
  p_type AS activity, starts_with(p_brand, 'Brand#1')::INT AS flag FROM part"""


def json_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrapped = F.when(F.col("event_id") % 3 == 0, F.to_json(F.struct(F.col("event_type").alias("name")))).when(F.col("event_id") % 3 == 1, F.to_json(F.struct(F.col("event_type").alias("value")))).otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", parsing.unwrap(wrapped).alias("leaf"), F.get_json_object("props", "$.k").cast("int").alias("k"))


JSON_LEAVES = "SELECT event_id, event_type AS leaf, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events"


def join_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority", "o_orderstatus")
    joined = assays.join_subjects(table(spark, sf_dir, "lineitem"), orders, "l_orderkey")
    return joined.groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_quantity")), 2).alias("quantity"))


JOIN_SUBJECTS = "SELECT o_orderpriority, o_orderstatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL"


def two_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    medians = assays.replicate_medians(table(spark, sf_dir, "lineitem"), ["l_partkey", "l_returnflag", "l_linestatus"], "l_quantity")
    out = assays.mean_of_logs(medians, ["l_partkey", "l_linestatus"])
    return out.select("l_partkey", "l_linestatus", F.round("y", 6).alias("y"), "n")


TWO_LEVEL = """SELECT l_partkey, l_linestatus, round(avg(log2(least(greatest(m, 0.05), 64))), 6) AS y, CAST(sum(n) AS BIGINT) AS n
FROM (SELECT l_partkey, l_returnflag, l_linestatus, median(l_quantity) AS m, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY l_partkey, l_linestatus"""


def labelled_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = assays.large_groups(table(spark, sf_dir, "lineitem"), "l_partkey", 25)
    out = assays.safe_label(rows, ["l_partkey"], "l_extendedprice", 32768.0)
    return out.select("l_partkey", F.round("y", 6).alias("y"), "n", "safe")


LABELLED_GROUPS = """SELECT l_partkey, round(avg(log2(l_extendedprice)), 6) AS y, count(*) AS n, avg(log2(l_extendedprice)) >= 15 AS safe
FROM lineitem WHERE l_extendedprice > 0 AND l_partkey IN (SELECT l_partkey FROM lineitem GROUP BY l_partkey HAVING count(*) >= 25) GROUP BY l_partkey"""


def distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_shipdate").agg(F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_suppkey").alias("suppliers"), F.count("*").alias("n"))


DISTINCT_COUNTS = "SELECT l_shipdate, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers, count(*) AS n FROM lineitem GROUP BY l_shipdate"


def control_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_totalprice", (-F.col("o_totalprice")).alias("potency"), bin_of(F.length("o_orderpriority"), [5, 6, 8]).alias("length_bin"), bin_of(F.dayofmonth("o_orderdate"), [5, 12, 20]).alias("charge_bin")
    )
    binned = ranking.quantile_bin(rows, "potency", "o_orderkey", 5).withColumnRenamed("bin", "potency_bin")
    binned = ranking.quantile_bin(binned, "o_totalprice", "o_orderkey", 4).withColumnRenamed("bin", "safety_bin")
    weights = scoring.tilted_weights(binned, ["length_bin", "charge_bin", "potency_bin", "safety_bin"], 0.55 * F.col("potency_bin") + 0.35 * F.col("safety_bin"))
    return weights.withColumn("weight", F.round("weight", 9))


CONTROL_TABLE = """WITH binned AS (SELECT (length(o_orderpriority) > 5)::INT + (length(o_orderpriority) > 6)::INT + (length(o_orderpriority) > 8)::INT AS length_bin,
  (day(o_orderdate) > 5)::INT + (day(o_orderdate) > 12)::INT + (day(o_orderdate) > 20)::INT AS charge_bin,
  CAST(least((row_number() OVER (ORDER BY -o_totalprice, o_orderkey) - 1) * 5 // count(*) OVER (), 4) AS INT) AS potency_bin,
  CAST(least((row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1) * 4 // count(*) OVER (), 3) AS INT) AS safety_bin FROM orders),
combos AS (SELECT *, count(*) AS n FROM binned GROUP BY ALL)
SELECT length_bin, charge_bin, potency_bin, safety_bin, n, round(n * exp(0.55 * potency_bin + 0.35 * safety_bin) / sum(n * exp(0.55 * potency_bin + 0.35 * safety_bin)) OVER (), 9) AS weight FROM combos"""


def ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.dayofyear("o_orderdate").alias("day"))
    blended = ranking.rank_blend(rows, "o_totalprice", "day", "o_orderkey", scales.BLEND_WEIGHT, scales.BLEND_PENALTY)
    return blended.select("o_orderkey", F.round("pct_a", 9).alias("pct_a"), F.round("pct_b", 9).alias("pct_b"), F.round("blend", 9).alias("blend"))


RANKS = """WITH r AS (SELECT o_orderkey, (row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1) / greatest(count(*) OVER () - 1, 1) AS a,
  (row_number() OVER (ORDER BY dayofyear(o_orderdate), o_orderkey) - 1) / greatest(count(*) OVER () - 1, 1) AS b FROM orders)
SELECT o_orderkey, round(a, 9) AS pct_a, round(b, 9) AS pct_b, round(0.55 * a + 0.45 * b - 0.25 * abs(a - b), 9) AS blend FROM r"""


def mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", F.length("p_name").alias("value"), "p_retailprice")
    return ranking.quantile_map(rows, "value", "p_retailprice", "p_partkey").select("p_partkey", "mapped")


MAPPED = """WITH a AS (SELECT p_partkey, row_number() OVER (ORDER BY length(p_name), p_partkey) AS k FROM part), b AS (SELECT p_retailprice AS mapped, row_number() OVER (ORDER BY p_retailprice, p_partkey) AS k FROM part)
SELECT p_partkey, mapped FROM a JOIN b USING (k)"""


def shortlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "lang", bin_of(F.col("n_chars"), [500, 2000, 8000]).cast("string")).alias("cell"), F.col("n_chars").alias("quality"))
    good = docs.join(table(spark, sf_dir, "labels").where("quality = 1").select("doc_id"), "doc_id")
    everyone = good.agg(F.count("*").alias("all"))
    shares = good.groupBy("cell").agg(F.count("*").alias("n")).join(F.broadcast(everyone)).select("cell", (F.col("n") / F.col("all")).alias("share"))
    return ranking.shortlist(docs, "cell", "quality", "doc_id", shares, 300).select("doc_id", "cell")


_CELLED = "celled AS (SELECT doc_id, lang || '/' || ((n_chars > 500)::INT + (n_chars > 2000)::INT + (n_chars > 8000)::INT) AS cell, n_chars, source FROM documents)"
SHORTLIST = f"""WITH {_CELLED}, good AS (SELECT cell, count(*) AS n FROM celled JOIN labels USING (doc_id) WHERE quality = 1 GROUP BY cell), shares AS (SELECT cell, n / sum(n) OVER () AS share FROM good)
SELECT doc_id, cell FROM celled LEFT JOIN shares USING (cell) QUALIFY row_number() OVER (PARTITION BY cell ORDER BY n_chars DESC, doc_id) <= greatest(floor(300 * coalesce(share, 0)), 40)"""


def union_of_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.union_of_best(table(spark, sf_dir, "orders").withColumn("late", F.datediff("o_orderdate", F.lit("1990-01-01"))), ["o_totalprice", "late"], "o_orderkey", 200)


UNION_OF_BEST = """(SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 200) UNION
(SELECT o_orderkey FROM orders ORDER BY date_diff('day', DATE '1990-01-01', o_orderdate::DATE) DESC, o_orderkey LIMIT 200)"""


def gram_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return similarity.kmer_hits(items, "text", "item_id", docs, "text", 24).withColumn("hit_fraction", F.round("hit_fraction", 6))


GRAM_HITS = """WITH k AS (SELECT DISTINCT substr(text, i, 24) AS g FROM (SELECT text, unnest(range(1, length(text) - 22)) AS i FROM documents WHERE length(text) >= 24)),
own AS (SELECT item_id, substr(text, i, 24) AS g FROM (SELECT item_id, text, unnest(range(1, length(text) - 22)) AS i FROM benchmark WHERE length(text) >= 24))
SELECT item_id, round(avg((k.g IS NOT NULL)::INT), 6) AS hit_fraction FROM own LEFT JOIN k ON own.g = k.g GROUP BY item_id"""


def shared_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.shares_kmer(table(spark, sf_dir, "documents"), "text", "doc_id", table(spark, sf_dir, "benchmark"), "text", 40)


SHARED_GRAMS = """WITH k AS (SELECT DISTINCT substr(text, i, 40) AS g FROM (SELECT text, unnest(range(1, length(text) - 38)) AS i FROM benchmark WHERE length(text) >= 40)),
own AS (SELECT doc_id, substr(text, i, 40) AS g FROM (SELECT doc_id, text, unnest(range(1, length(text) - 38)) AS i FROM documents WHERE length(text) >= 40))
SELECT DISTINCT doc_id FROM own SEMI JOIN k USING (g)"""


def nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("vector"), "label")
    means = vectors.select("label", F.posexplode("vector").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centroids = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centroid")).withColumnRenamed("label", "sub")
    return similarity.nearest(vectors.drop("label"), centroids).select(F.col("row_id").alias("vec_id"), "sub", F.round("dist2", 6).alias("dist2"))


NEAREST_CENTROID = """WITH x AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
m AS (SELECT label, i, avg(v) AS m FROM x GROUP BY label, i), d AS (SELECT x.vec_id, m.label AS sub, sum(pow(v - m, 2)) AS dist2 FROM x JOIN m USING (i) GROUP BY x.vec_id, m.label)
SELECT vec_id, sub, round(dist2, 6) AS dist2 FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY dist2, sub) = 1"""


def divergences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", bin_of(F.col("n_chars"), [200, 500, 1000, 2000, 4000, 8000]).alias("bin"))
    good = docs.join(table(spark, sf_dir, "labels").where("quality = 1"), "doc_id")
    return scoring.divergence(good, docs, "bin").select(F.round("kl", 9).alias("kl"))


DIVERGENCES = """WITH d AS (SELECT doc_id, (n_chars > 200)::INT + (n_chars > 500)::INT + (n_chars > 1000)::INT + (n_chars > 2000)::INT + (n_chars > 4000)::INT + (n_chars > 8000)::INT AS bin FROM documents),
p AS (SELECT bin, count(*) AS p FROM d JOIN labels USING (doc_id) WHERE quality = 1 GROUP BY bin), q AS (SELECT bin, count(*) AS q FROM d GROUP BY bin),
s AS (SELECT (coalesce(p, 0) + 1) / sum(coalesce(p, 0) + 1) OVER () AS p, (coalesce(q, 0) + 1) / sum(coalesce(q, 0) + 1) OVER () AS q FROM p FULL JOIN q USING (bin))
SELECT round(sum(p * ln(p / q)), 9) AS kl FROM s"""


def regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("truth"), (F.col("l_quantity") * 1500).alias("guess"))
    out = scoring.regression_report(rows, "truth", "guess")
    return out.select("n", *[F.round(c, 6).alias(c) for c in ("spearman", "rmse", "r2")])


REGRESSION = """WITH r AS (SELECT l_extendedprice AS t, l_quantity * 1500 AS g, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2 AS a,
  rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS b FROM lineitem)
SELECT count(*) AS n, round(corr(a, b), 6) AS spearman, round(sqrt(avg(pow(t - g, 2))), 6) AS rmse, round(1 - avg(pow(t - g, 2)) / var_pop(t), 6) AS r2 FROM r"""


def roc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return scoring.auroc(rows, "quality", "n_chars").select(F.round("auroc", 9).alias("auroc"))


ROC = """WITH r AS (SELECT quality, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2 AS k FROM labels JOIN documents USING (doc_id))
SELECT round((sum(CASE WHEN quality = 1 THEN k END) - sum(quality) * (sum(quality) + 1) / 2) / (sum(quality) * (count(*) - sum(quality))), 9) AS auroc FROM r"""

HEADS = {"mic_ecoli": "l_quantity / 10", "mic_paeru": "l_discount * 60", "mic_kpneu": "l_tax * 60", "mic_abaum": "l_linenumber", "mic_saure": "l_suppkey % 7", "mic_efaec": "l_partkey % 6", "mic_bsubt": "l_orderkey % 5", "mic_gram_neg": "l_quantity / 12", "hc50": "l_quantity / 6", "safe": "l_discount * 10", "amp": "l_tax * 12", "envelope": "l_discount * 9", "risk": "l_linenumber / 3"}
_NAMES = ["broad_spectrum", "gram_pos", "gram_neg", "mdr", "therapeutic"]


def objectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(*[F.expr(f"CAST({e} AS DOUBLE)").alias(h) for h, e in HEADS.items()], "l_orderkey", "l_linenumber", "l_suppkey")
    scored = scoring.panel(rows)
    return scored.select("l_orderkey", "l_linenumber", "l_suppkey", *[(F.round(c, 6) + 0.0).alias(c) for c in ("log2_mic50", "log2_mic_worst_neg", "log2_window")], *[(F.round(scoring.objective(scored.columns, n), 6) + 0.0).alias(n) for n in _NAMES],
        F.round(scoring.row_median(scales.PANEL_NEGATIVE + scales.PANEL_POSITIVE), 6).alias("median"))


def _objective_sql(name: str, heads: dict[str, int], fallback: bool) -> str:
    total = sum(heads.values()) + 3 * fallback
    mean = "(" + " + ".join([f"{n} * {h}" for h, n in heads.items()] + ["3 * mic_gram_neg"] * fallback) + f") / {total}"
    m, w, s, a, e, r = scales.OBJECTIVES[name]
    return f"round({m} * {mean} + {w} * greatest({', '.join(heads)}) + {s} * safe + {a} * amp + {e} * envelope + {r} * risk, 6) + 0 AS {name}"


_NEG, _ALL = {h: scales.PANEL[h] for h in scales.PANEL_NEGATIVE}, ", ".join(scales.PANEL)
OBJECTIVES = f"""WITH h AS (SELECT l_orderkey, l_linenumber, l_suppkey, {', '.join(f'CAST({e} AS DOUBLE) AS {n}' for n, e in HEADS.items())} FROM lineitem),
p AS (SELECT *, (mic_ecoli + mic_paeru + mic_kpneu + mic_abaum) / 4 AS neg, (mic_saure + mic_efaec + mic_bsubt) / 3 AS pos, greatest(mic_ecoli, mic_paeru, mic_kpneu, mic_abaum) AS worst FROM h)
SELECT l_orderkey, l_linenumber, l_suppkey, round(0.75 * neg + 0.25 * pos, 6) AS log2_mic50, round(worst, 6) AS log2_mic_worst_neg, round(least(hc50, 7) - greatest(0.75 * neg + 0.25 * pos, -1), 6) + 0 AS log2_window,
  {_objective_sql('broad_spectrum', scales.PANEL, True)}, {_objective_sql('gram_pos', {h: scales.PANEL[h] for h in scales.PANEL_POSITIVE}, False)}, {_objective_sql('gram_neg', _NEG, True)}, {_objective_sql('mdr', scales.RESISTANT, False)},
  round(1.2 * least(hc50, 7) - 1.2 * ({' + '.join(f'{n} * {h}' for h, n in scales.PANEL.items())} + 3 * mic_gram_neg) / 20 - 0.5 * greatest(least({_ALL}), -1) + 0.9 * safe + 1.6 * envelope + 0.3 * amp - 1.3 * risk, 6) + 0 AS therapeutic,
  round(list_median([{_ALL}]), 6) AS median FROM p"""

STRAINS = {"gram_neg": "o_totalprice / 1e5", "gram_pos": "o_custkey % 9", "resistant": "o_orderkey % 11", "median": "o_totalprice / 2e5", "best": "o_custkey % 4", "worst": "o_orderkey % 13"}


def strain_objectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", *[F.expr(f"CAST({e} AS DOUBLE)").alias(n) for n, e in STRAINS.items()])
    return rows.select("o_orderkey", *[(F.round(scoring.strain_objective(n), 10) + 0.0).alias(n) for n in _NAMES])


STRAIN_OBJECTIVES = f"""WITH s AS (SELECT o_orderkey, {', '.join(f'CAST({e} AS DOUBLE) AS s_{n}' for n, e in STRAINS.items())} FROM orders)
SELECT o_orderkey, round(-(0.65 * s_gram_neg + 0.35 * s_gram_pos) - 0.4 * s_worst, 10) + 0 AS broad_spectrum, round(-s_gram_pos, 10) + 0 AS gram_pos, round(-s_gram_neg, 10) + 0 AS gram_neg,
  round(-s_resistant, 10) + 0 AS mdr, round(-(0.6 * s_median + 0.4 * s_best), 10) + 0 AS therapeutic FROM s"""


def qualities(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", F.col("l_tax").alias("amp"), F.col("l_quantity").alias("mic"), F.col("l_discount").alias("surrogate"), (F.col("l_tax") * 2).alias("safe"),
        (F.col("l_linenumber") > 3).cast("int").alias("buildable"), F.col("l_linenumber").alias("risk"), (F.col("l_discount") * 3).alias("reuse"))
    return rows.select("l_orderkey", "l_linenumber", "l_suppkey", F.round(scoring.quality("mic", "surrogate"), 6).alias("quality"))


QUALITIES = """SELECT l_orderkey, l_linenumber, l_suppkey, round(1.2 * l_tax - 0.45 * l_quantity - 0.9 * l_discount + 0.55 * (l_tax * 2) + 0.4 * (l_linenumber > 3)::INT - 0.3 * l_linenumber - 0.9 * (l_discount * 3), 6) AS quality FROM lineitem"""


def rule_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = {"short": F.col("n_chars") < 500, "symbols": F.col("text").contains("%%%"), "shouting": F.col("text").contains("!!"), "license": F.lower("text").contains("license")}
    return docs.groupBy("lang").agg(*[F.round(F.avg(rule.cast("int")), 9).alias(name) for name, rule in rules.items()])


RULE_RATES = """SELECT lang, round(avg((n_chars < 500)::INT), 9) AS short, round(avg(contains(text, '%%%')::INT), 9) AS symbols, round(avg(contains(text, '!!')::INT), 9) AS shouting,
  round(avg(contains(lower(text), 'license')::INT), 9) AS license FROM documents GROUP BY lang"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    folded = orders.withColumn("fold", cleaning.hashed_part(F.col("o_custkey"), 5, 7)).withColumn("held_out", cleaning.hashed_part(F.col("o_orderkey"), 100, 3) < 3)
    sample = cleaning.hashed_sample(orders, "o_orderkey", 500, 11).select("o_orderkey", F.lit(True).alias("sampled"))
    return folded.join(sample, "o_orderkey", "left").na.fill(False, ["sampled"])


def crc32_sql(text: str) -> str:
    """The CRC of a text of ASCII letters, with the table of ``CRC_TABLE`` at hand."""
    return f"xor(list_reduce(list_prepend(4294967295, [CAST(ascii(x) AS BIGINT) FOR x IN string_split({text}, '')]), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


CRC_TABLE = "crc AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i)))"
SAMPLES = f"""WITH {CRC_TABLE}, sampled AS (SELECT o_orderkey FROM orders ORDER BY md5('11:' || o_orderkey), o_orderkey LIMIT 500)
SELECT o_orderkey, o_custkey, CAST({crc32_sql("'7:' || o_custkey")} % 5 AS INTEGER) AS fold, {crc32_sql("'3:' || o_orderkey")} % 100 < 3 AS held_out, o_orderkey IN (SELECT o_orderkey FROM sampled) AS sampled FROM orders, crc"""


def draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("w"))
    at = table(spark, sf_dir, "events").select("event_id", ((F.col("event_id") * 7919) % 10007 / 10007.0).alias("at"))
    return cleaning.weighted_draws(weights, "w", "o_orderpriority", at, "at").select("event_id", "o_orderpriority")


DRAWS = """WITH w AS (SELECT o_orderpriority, count(*) AS w FROM orders GROUP BY 1), c AS (SELECT o_orderpriority, sum(w) OVER (ORDER BY o_orderpriority) / sum(w) OVER () AS hi, sum(w) OVER (ORDER BY o_orderpriority) / sum(w) OVER () - w / sum(w) OVER () AS lo FROM w)
SELECT event_id, o_orderpriority FROM events JOIN c ON (event_id * 7919) % 10007 / 10007.0::DOUBLE >= lo AND (event_id * 7919) % 10007 / 10007.0::DOUBLE < hi"""

QUERIES = {
    "dedup_texts_first": (dedup_texts, DEDUP_TEXTS), "anti_join_negatives": (negatives_minus_positives, NEGATIVES), "semi_join_overlap": (overlap, OVERLAP), "set_operations": (set_operations, SET_OPERATIONS),
    "parse_concentrations": (concentrations, CONCENTRATIONS), "species_fields": (species_fields, SPECIES_FIELDS), "json_unwrap": (json_leaves, JSON_LEAVES), "join_inner_n1": (join_subjects, JOIN_SUBJECTS),
    "agg_two_level": (two_level, TWO_LEVEL), "agg_threshold_label": (labelled_groups, LABELLED_GROUPS), "count_distinct": (distinct_counts, DISTINCT_COUNTS), "control_table_tilt": (control_table, CONTROL_TABLE),
    "rank_pct_blend": (ranks, RANKS), "quantile_map": (mapped, MAPPED), "shortlist_per_cell": (shortlist, SHORTLIST), "topn_union": (union_of_best, UNION_OF_BEST), "kmer_hit_fraction": (gram_hits, GRAM_HITS),
    "shares_kmer": (shared_grams, SHARED_GRAMS), "nearest_centroid": (nearest_centroid, NEAREST_CENTROID), "kl_divergence": (divergences, DIVERGENCES), "regression_report": (regression, REGRESSION), "auroc": (roc, ROC),
    "objectives_panel": (objectives, OBJECTIVES), "strain_objectives": (strain_objectives, STRAIN_OBJECTIVES), "quality_weighted": (qualities, QUALITIES), "rule_trip_rates": (rule_rates, RULE_RATES),
    "folds_and_samples": (samples, SAMPLES), "weighted_draws": (draws, DRAWS),
}
