"""Repair of conversations: Dijkstra over the edits that give a legal order of turns."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import sha256
from heapq import heappop, heappush

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow_text import emptied
from .common import SPACES, bounded_batches, table, written

BLOCK = 256  # turns that one search covers
#: States of the grammar (s?(ua)+)?: nothing yet, after s, after u, after a.
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ADDED = {0: 2, 1: 2, 2: 3, 3: 2}  # the one role that may be written next, a user's unless a user has spoken
ENDS = (0, 3)
LEGAL = {"su", "ua", "au"}
REROLE = INSERT = LEFT = 3  # LEFT: for a truncated turn that stays
DELETE = 4
NAMES = {2: "user", 3: "assistant"}
Turn = tuple[str, str]  # role's initial; fault: b(lank), d(uplicate), t(runcated) or -
Best = dict[int, tuple[int, str]]


def cheapest(turns: Sequence[Turn], entry: int, *, closes: bool) -> Best:
    """By last state, (cost, audit) of the cheapest edits of ``turns`` from state ``entry``, the ASCII-least of equal cost.

    Dijkstra on nodes (turn index, state), which exist only once they are reached. Keys
    (cost, audit) grow along every edge and keep their order when both get the same
    letter: audits of one node and cost are never prefixes of each other, since they
    have a letter for each turn and each insertion costs. So the first key popped for a node is its least.
    ``closes``: stop at the first node popped that ends the conversation legally.
    """
    heap, done, found = [(0, "", 0, entry)], set(), {}
    while heap:
        cost, audit, i, state = heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(turns):
            if closes and state in ENDS:
                return {state: (cost, audit)}
            found[state] = (cost, audit)
        heappush(heap, (cost + INSERT, audit + "I", i, ADDED[state]))
        if i < len(turns):
            initial, fault = turns[i]
            heappush(heap, (cost + DELETE, audit + "D", i + 1, state))
            if fault not in "bd":
                stays = cost + (LEFT if fault == "t" else 0)
                if (state, initial) in STEP:
                    heappush(heap, (stays, audit + "K", i + 1, STEP[state, initial]))
                heappush(heap, (stays + REROLE, audit + "R", i + 1, ADDED[state]))
    return found


def joined(before: Best, crossing: dict[int, Best]) -> Best:
    """The best ways to each last state over a stretch, ``crossing[state]`` from each state that ``before`` leads to."""
    ways: Best = {}
    for state, (cost, audit) in before.items():
        for last, (more, letters) in crossing[state].items():
            way = (cost + more, audit + letters)
            if last not in ways or way < ways[last]:
                ways[last] = way
    return ways


def repaired(turns: Sequence[Turn]) -> tuple[int, str]:
    """(cost, audit) of a whole conversation; a long one in blocks, from every state that is still open."""
    if len(turns) <= BLOCK:
        return next(iter(cheapest(turns, 0, closes=True).values()))
    before: Best = {0: (0, "")}
    for at in range(0, len(turns), BLOCK):
        before = joined(before, {s: cheapest(turns[at : at + BLOCK], s, closes=False) for s in before})
    return min(before[s] for s in ENDS if s in before)


def crossings(turns: Sequence[Turn]) -> dict[int, Best]:
    """The best ways from every state to every state over a stretch of a conversation."""
    ways: dict[int, Best] = {s: {s: (0, "")} for s in ADDED}
    for at in range(0, len(turns), BLOCK):
        block = {s: cheapest(turns[at : at + BLOCK], s, closes=False) for s in ADDED}
        ways = {s: joined(before, block) for s, before in ways.items()}
    return ways


def illegal(initials: Sequence[str]) -> int:
    """How many neighbours are not a legal pair."""
    return sum(a + b not in LEGAL for a, b in zip(initials[:-1], initials[1:], strict=True))


def edited(audit: str, turns: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """(role, text) of the conversation that the edits make of ``turns``."""
    state = 0
    for letter in audit:
        if letter == "I":
            state = ADDED[state]
            yield NAMES[state], ""
            continue
        role, text = next(turns)
        if letter == "K":
            state = STEP[state, role[:1]]
            yield role, text
        elif letter == "R":
            state = ADDED[state]
            yield NAMES[state], text


def damaged(rows: DataFrame) -> DataFrame:
    """The rows (conv, turn, role, text) after the damage that the CRC of ``conv:turn`` deals, with how many ``copies`` there are; nulls are one space."""
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv", "turn")])
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    return (
        rows.withColumn("harm", F.crc32(name.cast("binary")) % 20)
        .where("harm <> 0")
        .select(
            "conv", "turn",
            F.when(F.col("harm") == 4, "user").otherwise(role).alias("role"),
            F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
            F.when(F.col("harm") == 3, 2).otherwise(1).alias("copies"),
        )
    )


def _digest(rows: DataFrame) -> DataFrame:
    """With the text's digest, by which texts are compared and rows of one turn and role are ordered."""
    return rows.withColumn("digest", F.unhex(F.md5(F.col("text").cast("binary"))))


def _turns(rows: DataFrame) -> DataFrame:
    """Distinct rows (conv, turn, role, digest) with their copies ``n``, the role's initial, and the first one's fault.

    A row that isn't blank is a duplicate if its role and text have an earlier turn; so are
    all copies but the first. Small rows only, and nothing here gathers a conversation.
    """
    last = F.right(F.rtrim("text", F.lit(" " + SPACES)), F.lit(1))
    fault = F.when(last == "", "b").when(~last.isin(".", "!", "?"), "t").otherwise("-")
    key = ["conv", "turn", "role", "digest"]
    alike = _digest(rows).withColumn("fault", fault).groupBy(*key, "fault").agg(F.sum("copies").alias("n"))
    first = alike.groupBy(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(F.min("turn").alias("first"), F.max(F.col("turn").isNull()).alias("unnumbered"))
    met = alike.join(first, F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")))
    again = F.when(F.col("unnumbered"), F.col("turn").isNotNull()).otherwise(F.col("turn") > F.col("first"))
    return met.select(*key, "n", F.substring("role", 1, 1).alias("initial"), F.when((F.col("fault") != "b") & again, "d").otherwise(F.col("fault")).alias("fault"))


_STRETCH = "whole boolean, part int, first string, last string, illegal bigint, costs array<bigint>, audits array<string>"


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each conversation of a range of sorted turns: its repair, or all crossings if it may reach into another range, as the first and the last may."""
    part, kind = TaskContext.get().partitionId(), None
    out: list[tuple] = []

    def ways(turns: list[Turn]) -> tuple[list[int | None], list[str | None]]:
        found = crossings(turns)
        flat = [found[a].get(b, (None, None)) for a in ADDED for b in ADDED]
        return [c for c, _ in flat], [x for _, x in flat]

    def add(conv, turns: list[Turn], whole: bool) -> None:
        initials = [x for x, _ in turns]
        costs, audits = (lambda c, x: ([c], [x]))(*repaired(turns)) if whole else ways(turns)
        out.append((conv, whole, part, initials[0], initials[-1], illegal(initials), costs, audits))

    def flush() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True))
        out.clear()
        kinds = [kind, pa.bool_(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string())]
        names = ["conv", "whole", "part", "first", "last", "illegal", "costs", "audits"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    current, turns, nth = None, [], 0
    for batch in batches:
        kind = batch.schema.field(0).type
        for conv, n, initial, fault in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
            if turns and conv != current:
                add(current, turns, nth > 0)
                turns, nth = [], nth + 1
                if len(out) >= 1024:
                    yield flush()
            current = conv
            turns.append((initial, fault))
            turns.extend([(initial, "b" if fault == "b" else "d")] * (n - 1))
    if turns:
        add(current, turns, False)
        yield flush()


def _stitched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations that span ranges, from their stretches in order."""
    current, before, last, wrong, kind = None, None, None, 0, None

    def finish() -> pa.RecordBatch:
        cost, audit = min(before[s] for s in ENDS if s in before)
        return pa.RecordBatch.from_arrays([pa.array([current], kind), pa.array([wrong]), pa.array([cost]), pa.array([audit])], names=["conv", "illegal", "cost", "audit"])

    for batch in batches:
        kind = batch.schema.field(0).type
        for r in batch.to_pylist():
            if before is not None and r["conv"] != current:
                yield finish()
                before = None
            if before is None:
                current, before, last, wrong = r["conv"], {0: (0, "")}, None, 0
            flat = list(zip(r["costs"], r["audits"], strict=True))
            table_ = {a: {b: flat[4 * a + b] for b in ADDED if flat[4 * a + b][0] is not None} for a in ADDED}
            before = joined(before, table_)
            wrong += r["illegal"] + (last is not None and last + r["first"] not in LEGAL)
            last = r["last"]
    if before is not None:
        yield finish()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each conversation's edits, which come first, over its rows, which stream past into the digest."""
    current: tuple | None = None
    digest, state, at, empty = sha256(), 0, 0, True
    out: list[tuple] = []

    def write(role: str, text: str) -> None:
        nonlocal empty
        digest.update((role + ":" + text if empty else "\n" + role + ":" + text).encode())
        empty = False

    def inserted() -> None:
        nonlocal state, at
        while at < len(current[3]) and current[3][at] == "I":
            state, at = ADDED[state], at + 1
            write(NAMES[state], "")

    def flush(kind: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True))
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [kind, pa.int64(), pa.int64(), pa.string(), pa.string()], strict=True)], names=["conv", "illegal", "cost", "audit", "sha"])

    kind = None
    for batch in batches:
        kind = batch.schema.field(0).type
        for conv, wrong, cost, audit, copies, role, text in zip(*[batch.column(i).to_pylist() for i in range(7)], strict=True):
            if audit is not None:
                if current is not None:
                    inserted()
                    out.append((*current, digest.hexdigest()))
                    if len(out) >= 1024:
                        yield flush(kind)
                current, digest, state, at, empty = (conv, wrong, cost, audit), sha256(), 0, 0, True
                continue
            for _ in range(copies):
                inserted()
                letter, at = current[3][at], at + 1
                if letter == "K":
                    state = STEP[state, role[:1]]
                    write(role, text)
                elif letter == "R":
                    state = ADDED[state]
                    write(NAMES[state], text)
    if current is not None:
        inserted()
        out.append((*current, digest.hexdigest()))
        yield flush(kind)


def repair(rows: DataFrame, *, copies: str | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row per conversation: conv, gaps, blank, duplicate, truncated, illegal, cost, audit, sha (of the repaired ``role:text`` lines).

    Rows are taken by turn, nulls first; those of one turn by role, then by the MD5 of the
    text (so equal rows are neighbours); ``copies`` names a column that says how often a row counts. Null roles
    and texts are one space, which is blank and no legal role; an empty role has no initial and can't be
    kept. A null conversation is one of its own; an empty table gives no rows; other columns are not read.

    Only small rows (initial, fault) are sorted for the search, in ranges of (conversation,
    turn), so that a conversation with most of the rows spreads over many tasks. A range
    solves each conversation within it by Dijkstra; of the two that may reach into other
    ranges it returns the best edits from each grammar state to each, and those stretches
    are stitched. The edits, a letter for each turn, then go before the conversation's
    rows into one sorted stream. That stream can't be split: the digest of a
    conversation needs its bytes in order. It holds the edits of one conversation, never its texts.
    """
    plain = rows.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit(" ")).alias("role"), F.coalesce(text_col, F.lit(" ")).alias("text"), (F.col(copies) if copies else F.lit(1)).cast("int").alias("copies")
    ).where("copies > 0")
    key = rows.select(F.col(conv_col).alias("conv")).schema["conv"].dataType.simpleString()
    turns = written(_turns(plain), "turns")
    counted = turns.groupBy(F.col("conv").alias("of")).agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).alias("gaps"),
        F.sum(F.when(F.col("fault") == "b", F.col("n")).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("fault") == "b", 0).otherwise(F.col("n") - F.when(F.col("fault") == "d", 0).otherwise(1))).alias("duplicate"),
        F.sum((F.col("fault") == "t").cast("long")).alias("truncated"),
    )
    order = ["conv", "turn", "role", "digest"]
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = turns.repartitionByRange(partitions, *order).sortWithinPartitions(*order).select("conv", "n", "initial", "fault")
    found = written(ranges.mapInArrow(lambda it: emptied(_searched(it)), f"conv {key}, {_STRETCH}"), "repairs")
    whole = found.where("whole").select("conv", "illegal", F.col("costs")[0].alias("cost"), F.col("audits")[0].alias("audit"))
    spread = found.where("not whole").repartition(partitions, "conv").sortWithinPartitions("conv", "part")
    repairs = whole.unionByName(spread.drop("whole").mapInArrow(lambda it: emptied(_stitched(it)), f"conv {key}, illegal bigint, cost bigint, audit string"))
    heads = repairs.select("conv", "illegal", "cost", "audit", F.lit(0).alias("copies"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit(None).cast(rows.schema[turn_col].dataType).alias("turn"), F.lit(None).cast("binary").alias("digest"))
    lines = _digest(bounded_batches(plain)).withColumns({"illegal": F.lit(None).cast("long"), "cost": F.lit(None).cast("long"), "audit": F.lit(None).cast("string")})
    stream = heads.unionByName(lines).withColumn("row", F.col("audit").isNull()).repartition(partitions, "conv").sortWithinPartitions("conv", "row", "turn", "role", "digest")
    done = stream.select("conv", "illegal", "cost", "audit", "copies", "role", "text").mapInArrow(lambda it: emptied(_hashed(it)), f"conv {key}, illegal bigint, cost bigint, audit string, sha string")
    return done.join(counted, F.col("conv").eqNullSafe(F.col("of"))).select("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "sha")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation after the damage, with its cheapest repair; one without a row left has zeros."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("conv"), "turn", "role", "text")
    fixed = repair(damaged(rows), copies="copies", conv_col="conv")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return (
        rows.select(F.col("conv").alias("conv_id")).distinct()
        .join(fixed, F.col("conv_id").eqNullSafe(F.col("conv")), "left")
        .select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.lit(sha256().hexdigest())).alias("repaired_sha256"))
    )


#: The recursion goes over the turns, with the best way to each state; insertions are a table of ways between states.
OP12_SQL = r"""
WITH RECURSIVE crc AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
named AS (SELECT conv_id AS conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
hit AS (SELECT n.*, xor(list_reduce(list_prepend(4294967295, [CAST(ascii(x) AS BIGINT) FOR x IN string_split(name, '')]), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS harm FROM named n, crc),
harmed AS (SELECT conv, turn, CASE harm WHEN 4 THEN 'user' ELSE role END AS role, CASE harm WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, harm FROM hit WHERE harm <> 0),
copied AS (SELECT conv, turn, role, text FROM harmed UNION ALL SELECT conv, turn, role, text FROM harmed WHERE harm = 3),
placed AS (SELECT *, substr(role, 1, 1) AS x, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS z,
  row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, md5(text)) AS i FROM copied),
faulty AS MATERIALIZED (SELECT *, CASE WHEN z = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY i) > 1 THEN 'd' WHEN z NOT IN ('.', '!', '?') THEN 't' ELSE '-' END AS f, lag(x) OVER (PARTITION BY conv ORDER BY i) AS before FROM placed),
facts AS (SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (f = 'b') AS blank, count(*) FILTER (f = 'd') AS duplicate, count(*) FILTER (f = 't') AS truncated,
  count(*) FILTER (before IS NOT NULL AND before || x NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM faulty GROUP BY conv),
ins AS (SELECT * FROM (VALUES (0, 0, '', 0), (0, 2, 'I', 3), (0, 3, 'II', 6), (1, 1, '', 0), (1, 2, 'I', 3), (1, 3, 'II', 6), (2, 2, '', 0), (2, 3, 'I', 3), (3, 3, '', 0), (3, 2, 'I', 3)) v(a, b, letters, price)),
step AS (SELECT * FROM (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)) v(a, x, b)),
added AS (SELECT * FROM (VALUES (0, 2), (1, 2), (2, 3), (3, 2)) v(a, b)),
edit AS MATERIALIZED (
  SELECT conv, i, a, a AS b, 'D' AS letter, 4 AS price FROM faulty, added
  UNION ALL SELECT conv, i, a, b, 'K', CASE f WHEN 't' THEN 3 ELSE 0 END FROM faulty JOIN step USING (x) WHERE f IN ('t', '-')
  UNION ALL SELECT conv, i, a, b, 'R', CASE f WHEN 't' THEN 6 ELSE 3 END FROM faulty, added WHERE f IN ('t', '-')),
way AS (
  SELECT conv, CAST(0 AS BIGINT) AS i, 0 AS s, {'cost': CAST(0 AS BIGINT), 'audit': ''} AS w FROM facts
  UNION ALL
  SELECT y.conv, y.i + 1, e.b, min({'cost': y.w.cost + n.price + e.price, 'audit': y.w.audit || n.letters || e.letter})
  FROM way y JOIN ins n ON n.a = y.s JOIN edit e ON e.conv IS NOT DISTINCT FROM y.conv AND e.i = y.i + 1 AND e.a = n.b GROUP BY ALL),
best AS (SELECT y.conv, min({'cost': y.w.cost + n.price, 'audit': y.w.audit || n.letters}) AS w FROM way y JOIN facts k ON y.conv IS NOT DISTINCT FROM k.conv AND y.i = k.n JOIN ins n ON n.a = y.s WHERE n.b IN (0, 3) GROUP BY y.conv),
spelt AS (SELECT conv, p, substr(w.audit, p, 1) AS letter, p - len(replace(replace(replace(substr(w.audit, 1, p), 'D', ''), 'R', ''), 'K', '')) AS i FROM best, LATERAL (SELECT unnest(range(1, len(w.audit) + 1)) AS p)),
kept AS (SELECT s.conv, p, letter, role, text, row_number() OVER (PARTITION BY s.conv ORDER BY p) AS nth, count(*) FILTER (letter = 'K' AND x = 's') OVER (PARTITION BY s.conv) AS system
  FROM spelt s LEFT JOIN faulty f ON f.conv IS NOT DISTINCT FROM s.conv AND f.i = s.i AND letter <> 'I' WHERE letter <> 'D'),
lines AS (SELECT conv, nth, CASE WHEN letter = 'K' THEN role WHEN (nth - system) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE letter WHEN 'I' THEN '' ELSE text END AS line FROM kept),
hashed AS (SELECT conv, sha256(string_agg(line, chr(10) ORDER BY nth)) AS sha FROM lines GROUP BY conv)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(w.cost, 0) AS cost,
  coalesce(w.audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN facts k ON c.conv_id IS NOT DISTINCT FROM k.conv LEFT JOIN best b ON c.conv_id IS NOT DISTINCT FROM b.conv LEFT JOIN hashed h ON c.conv_id IS NOT DISTINCT FROM h.conv
"""
