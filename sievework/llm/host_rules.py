"""Quality rules with verdicts by host: beta-shrunken failure rates, joined back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, checkpoint, table, words

#: Rules whose failures are counted by host, as SQL over a document's measures.
RULES = {
    "base": "n_words < 50 OR 100 * n_repeat_words > 50 * n_words",
    "symbols": "2 * n_symbols > n_words",
    "lines": "10 * n_dup_lines > n_words",
    "lengths": "word_chars > 15 * n_words OR word_chars < 2 * n_words",
}


#: Bits for a window's position: below so many words, so many. The rest is for the hash.
POSITION_BITS = ((1 << 16, 16), (1 << 24, 24), (1 << 31, 31))


def _neighbours(grams: Column, in_order: Column, bits: Column) -> tuple[Column, Column]:
    """(positions of three-word windows whose hash a neighbour has, whether neighbours with equal upper bits differ).

    ``in_order`` holds, sorted, each window's upper hash bits and, in the lower ``bits``,
    its position. Where neighbours with equal upper bits never differ, equal windows are neighbours.
    """
    place = lambda x: F.call_function("shiftrightunsigned", F.call_function("shiftleft", x, F.lit(64) - bits), F.lit(64) - bits).cast("int")
    top = lambda x: F.call_function("shiftright", x, bits)

    def alike(x: Column, y: Column) -> Column:
        return F.coalesce((top(x) == top(y)) & (F.get(grams, place(x)) == F.get(grams, place(y))), F.lit(False))

    found = F.filter(in_order, lambda x, j: alike(x, F.get(in_order, j + 1)) | alike(x, F.get(in_order, j - 1)))
    mixed = F.filter(in_order, lambda x, j: F.coalesce((top(x) == top(F.get(in_order, j + 1))) & ~alike(x, F.get(in_order, j + 1)), F.lit(False)))
    return F.transform(found, place), F.size(mixed) > 0


def _by_whole_hash(grams: Column) -> Column:
    """Positions of windows whose hash another window has, by a sort on whole hashes: slower, and for any text."""
    in_order = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
    return F.transform(F.filter(in_order, lambda x, j: same(x, F.get(in_order, j + 1)) | same(x, F.get(in_order, j - 1))), lambda x: x["i"])


def measures(docs: DataFrame, *, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text") -> DataFrame:
    """A row per document: id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words.

    Row-local and shuffle-free. Windows of three words are hashed to 64 bits, the hashes
    sorted with their positions, and equal neighbours found, so that a text of n words
    costs n log n. A sort holds the upper bits of a hash; the few texts where that could hide
    a repeat are sorted by whole hashes. A text's words and hashes are one row, some 30 bytes
    a byte of text. Each step is a projection of its own: one that is used more than once
    isn't merged with the next, and nothing is computed again for each element.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: F.length(F.translate(line, " " + SPACES, "")) > 0)
    n = F.size("words")
    (small, few), (large, more), (_, most) = POSITION_BITS
    bits = F.when(F.col("n_words") < small, few).when(F.col("n_words") < large, more).otherwise(most)
    step = docs.select(
        F.col(id_col).alias("id"),
        F.col(host_col).alias("host"),
        F.length(F.translate(text, " " + SPACES, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        words(F.col(text_col)).alias("words"),
    )
    kept = ["id", "host", "word_chars", "n_symbols"]
    step = step.select(
        *kept,
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        n.cast("long").alias("n_words"),
        F.when(
            n >= 3,
            F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2))),
        ).otherwise(F.array().cast("array<bigint>")).alias("grams"),
    )
    kept += ["n_dup_lines", "n_words"]
    step = step.select(*kept, "grams", bits.alias("bits"))
    step = step.select(
        *kept,
        "grams",
        "bits",
        F.sort_array(
            F.transform(
                "grams",
                lambda h, i: F.call_function("shiftleft", F.call_function("shiftright", h, F.col("bits")), F.col("bits")).bitwiseOR(i.cast("long")),
            )
        ).alias("in_order"),
    )
    at, mixed = _neighbours(F.col("grams"), F.col("in_order"), F.col("bits"))
    step = step.select(*kept, "grams", at.alias("at"), mixed.alias("mixed"))
    step = step.select(*kept, F.sort_array(F.when(F.col("mixed"), _by_whole_hash(F.col("grams"))).otherwise(F.col("at"))).alias("at"))
    covered = F.aggregate(
        F.transform("at", lambda p, j: F.least(F.lit(3), F.coalesce(F.get("at", j + 1) - p, F.lit(3))).cast("long")),
        F.lit(0).cast("long"),
        lambda total, x: total + x,
    )
    return step.select(*kept, covered.alias("n_repeat_words"))


def judge_hosts(docs: DataFrame, *, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text", limit: float = 0.5, rules: dict[str, str] | None = None) -> DataFrame:
    """Each document's measures, whether it fails the base rule, and its host's verdict.

    Failures of each rule are summed by host. Over the hosts, the rates' mean and
    variance, weighted by documents, give a beta prior by moments; a host's shrunken rate
    is (failures + a) / (documents + a + b). A host whose shrunken rate is above ``limit``
    for any rule is rejected with all its documents, so a host of few documents needs more
    than a bad few. If all rates are equal, the prior is as strong as all documents.

    ``docs`` is measured once; the measures, a few numbers a document, are kept in the
    shared folder. Hosts are summed before the shuffle, and the join back is an ordinary
    one, which AQE splits at a hot host. Null text is empty; null ids and hosts are values
    like others; repeated rows each count; an empty table gives no rows.
    """
    rules = RULES if rules is None else rules
    rows = measures(docs, id_col=id_col, host_col=host_col, text_col=text_col)
    rows = checkpoint(rows.withColumn("host_key", F.coalesce(F.concat(F.lit("h"), F.col("host").cast("string")), F.lit(""))))
    hosts = checkpoint(rows.groupBy("host_key").agg(F.count("*").cast("double").alias("n"), *[F.sum(F.expr(rule).cast("double")).alias(f"f_{name}") for name, rule in rules.items()]))
    sums = hosts.agg(F.sum("n").alias("n"), *[F.sum(f"f_{name}").alias(name) for name in rules]).first()
    total = sums.n or 0.0
    means = {name: sums[name] / total if total else 0.0 for name in rules}
    spreads = hosts.agg(*[F.sum(F.col("n") * F.pow(F.col(f"f_{name}") / F.col("n") - mean, 2)).alias(name) for name, mean in means.items()]).first() if rules else {}
    bad = F.lit(False)
    for name, mean in means.items():
        spread = spreads[name] / total if total else 0.0
        strength = max(1.0, min(total, mean * (1 - mean) / spread - 1)) if spread > 0 else total
        hosts = hosts.withColumn(f"rate_{name}", (F.col(f"f_{name}") + mean * strength) / (F.col("n") + strength))
        bad = bad | (F.col(f"rate_{name}") > limit)
    hosts = hosts.select("host_key", (~bad).alias("host_kept"), *[f"rate_{name}" for name in rules])
    return (
        rows.join(hosts, "host_key")
        .withColumn("base_failed", F.expr(RULES["base"]))
        .withColumn("kept", ~F.col("base_failed") & F.col("host_kept"))
        .drop("host_key")
        .withColumnsRenamed({"id": id_col})
    )


def op6_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdicts of all documents, with their source as host."""
    return judge_hosts(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP6_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row_id, doc_id, source, coalesce(text, '') AS text FROM documents),
listed AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM docs),
word_rows AS (
  SELECT row_id, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM listed),
windows AS (
  SELECT row_id, i, w, lead(w, 1) OVER s AS w2, lead(w, 2) OVER s AS w3 FROM word_rows WINDOW s AS (PARTITION BY row_id ORDER BY i)),
repeats AS (
  SELECT row_id, i FROM windows WHERE w3 IS NOT NULL QUALIFY count(*) OVER (PARTITION BY row_id, w, w2, w3) > 1),
covered AS (
  SELECT row_id, count(DISTINCT i + k) AS n FROM repeats, range(3) r(k) GROUP BY row_id),
measured AS (
  SELECT l.doc_id, l.source, CAST(len(l.words) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(l.text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(l.text) - length(regexp_replace(l.text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l.lines) - len(list_distinct(l.lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
  FROM listed l LEFT JOIN covered c USING (row_id)),
failed AS (
  SELECT *, unnest([(n_words < 50 OR 100 * n_repeat_words > 50 * n_words)::INT, (2 * n_symbols > n_words)::INT,
         (10 * n_dup_lines > n_words)::INT, (word_chars > 15 * n_words OR word_chars < 2 * n_words)::INT]) AS f,
         unnest([1, 2, 3, 4]) AS rule FROM measured),
hosts AS (SELECT source, rule, count(*) AS n, sum(f) AS f FROM failed GROUP BY source, rule),
means AS (SELECT *, sum(n) OVER (PARTITION BY rule) AS total, sum(f) OVER (PARTITION BY rule)::DOUBLE / sum(n) OVER (PARTITION BY rule) AS m FROM hosts),
spreads AS (SELECT *, sum(n * pow(f::DOUBLE / n - m, 2)) OVER (PARTITION BY rule) / total AS v FROM means),
priors AS (SELECT *, CASE WHEN v > 0 THEN greatest(1.0::DOUBLE, least(total::DOUBLE, m * (1 - m) / v - 1)) ELSE total::DOUBLE END AS s FROM spreads),
verdicts AS (SELECT source, max((f + m * s) / (n + s)) <= 0.5 AS host_kept FROM priors GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND v.host_kept AS kept
FROM measured d JOIN verdicts v ON d.source IS NOT DISTINCT FROM v.source
"""
