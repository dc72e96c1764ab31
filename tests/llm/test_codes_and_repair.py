"""Vector codes and conversation repair against plain loops, over null, empty, long, tied and clashing rows."""

from __future__ import annotations

import itertools
import math
import random
import re
import zlib
from hashlib import md5, sha256

import pytest

from sievework.llm import conversation_repair as cr
from sievework.llm import vector_codes as vc


def coded_slowly(rows, parts=8, entries=16, rounds=6, scale=4096):
    """{row: (code, error, label_error)} and the codebooks, in Python integers."""
    fine = [(i, v, label) for i, v, label in rows if v and len(v) % parts == 0 and all(x is not None and math.isfinite(x) for x in v)]
    fine.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    fine = [r for r in fine if len(r[1]) == len(fine[0][1])]
    width = len(fine[0][1]) // parts
    cut = [[tuple(math.floor(x * scale) for x in v[p * width : (p + 1) * width]) for p in range(parts)] for _, v, _ in fine]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda c, book: min(range(len(book)), key=lambda k: (far(c, book[k]), k))
    for _ in range(rounds):
        for p in range(parts):
            homes = [near(c[p], books[p]) for c in cut]
            for k in range(len(books[p])):
                mine = [c[p] for c, h in zip(cut, homes, strict=True) if h == k]
                if mine:
                    books[p][k] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    out = []
    for c, (i, _, label) in zip(cut, fine, strict=True):
        at = [near(c[p], books[p]) for p in range(parts)]
        out.append((i, label, "".join(f"{k:02x}" for k in at), sum(far(c[p], books[p][at[p]]) for p in range(parts))))
    total = {label: sum(e for _, other, _, e in out if other == label) for _, label, _, _ in out}
    return sorted((repr((i, code, e, total[label])) for i, label, code, e in out)), sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


@pytest.mark.parametrize("n,block", [(200, 4096), (200, 7), (9, 4096)])
def test_codes_are_the_loops(spark, monkeypatch, n, block):
    monkeypatch.setattr(vc, "BLOCK", block)
    rng = random.Random(n)
    rows = [(i, [rng.gauss(0, 1) for _ in range(16)], rng.choice([1, 2, None])) for i in range(n)]
    rows += [(3, rows[5][1], 1), (None, rows[6][1], 2), (n, None, 1), (n + 1, [None] * 16, 1), (n + 2, [math.nan] * 16, 1), (n + 3, [math.inf] * 16, None), (n + 4, [], 1), (n + 5, [1.0] * 8, 1), (-1, [1.0] * 12, 1)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, code string, cells int")
    found, book = vc.vector_codes(frame)
    slow, digest = coded_slowly(rows)
    assert sorted(repr((r.id, r.code, r.error, r.label_error)) for r in found.collect()) == slow
    assert vc.book_digest(book) == digest


def test_codes_of_nothing_and_of_huge_components(spark):
    none, book = vc.vector_codes(spark.createDataFrame([], "vec_id long, embedding array<float>, label int"))
    assert none.count() == 0 and book.size == 0
    huge, _ = vc.vector_codes(spark.createDataFrame([(1, [1e30] * 8, 1), (2, [-1e30] * 8, 1)], "vec_id long, embedding array<double>, label int"), rounds=0, entries=1)
    assert sorted(r.error for r in huge.collect()) == [0, 8 * (2 * vc.LARGEST) ** 2]


def test_tallies_merge_in_any_tree(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    cells = rng.integers(-9, 9, (16, 60)).astype(np.int32)
    book = cells[:, :4].reshape(8, 2, 4).transpose(0, 2, 1).astype(np.int64)
    whole = vc.learnt(spark.sparkContext.parallelize([cells], 1), book, 6)
    many = vc.learnt(spark.sparkContext.parallelize([cells[:, i : i + 3] for i in range(0, 60, 3)], 13), book, 6)
    assert (whole == many).all()


def repaired_slowly(turns):
    """(cost, audit) by relaxing all edges until nothing changes."""
    best = {(0, 0): (0, "")}
    while True:
        fresh = dict(best)
        for (i, s), (cost, audit) in best.items():
            edges = [((i, cr.ADDED[s]), 3, "I")]
            if i < len(turns):
                initial, fault = turns[i]
                edges.append(((i + 1, s), 4, "D"))
                if fault in "-t":
                    late = 3 * (fault == "t")
                    edges += [((i + 1, cr.ADDED[s]), 3 + late, "R")] + ([((i + 1, cr.STEP[s, initial]), late, "K")] if (s, initial) in cr.STEP else [])
            for node, price, letter in edges:
                way = (cost + price, audit + letter)
                if node not in fresh or way < fresh[node]:
                    fresh[node] = way
        if fresh == best:
            return min(best[len(turns), s] for s in cr.ENDS if (len(turns), s) in best)
        best = fresh


def all_edits(turns):
    """The least (cost, audit) of every string of edits with up to three insertions whose roles match the grammar."""
    ways = []
    for letters in itertools.product(*[["D"] if f in "bd" else ["D", "K", "u", "a"] for _, f in turns]):
        for added in range(4):
            for places in itertools.combinations(range(len(turns) + added), added):
                for roles in itertools.product("ua", repeat=added):
                    audit, spelt, price, rest, new = "", "", 0, iter(zip(letters, turns, strict=True)), iter(roles)
                    for at in range(len(turns) + added):
                        if at in places:
                            audit, spelt, price = audit + "I", spelt + next(new), price + 3
                            continue
                        letter, (initial, fault) = next(rest)
                        audit += "R" if letter in "ua" else letter
                        spelt += {"D": "", "K": initial}.get(letter, letter)
                        price += 4 if letter == "D" else 3 * (letter in "ua") + 3 * (fault == "t")
                    if re.fullmatch("(s?(ua)+)?", spelt):
                        ways.append((price, audit))
    return min(ways)


@pytest.mark.parametrize("block", [1, 2, 3, 256])
def test_search_finds_the_least_edits(monkeypatch, block):
    monkeypatch.setattr(cr, "BLOCK", block)
    rng = random.Random(7)
    for n in range(4):
        for _ in range(12):
            turns = [(rng.choice("suax"), rng.choice("bdt---")) for _ in range(n)]
            assert cr.repaired(turns) == repaired_slowly(turns) == all_edits(turns)
    for _ in range(60):
        turns = [(rng.choice("suaaux"), rng.choice("bdt-----")) for _ in range(rng.randrange(30))]
        assert cr.repaired(turns) == repaired_slowly(turns)
        cut = rng.randrange(len(turns) + 1)
        halves = cr.joined(cr.joined({0: (0, "")}, cr.crossings(turns[:cut])), cr.crossings(turns[cut:]))
        assert min(halves[s] for s in cr.ENDS if s in halves) == repaired_slowly(turns)


def conversation_slowly(rows):
    """What op12 returns for one conversation's (turn, role, text) after damage."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), md5(r[2].encode()).digest()))
    seen, faults = set(), []
    for _, role, text in rows:
        solid = re.sub(r"[\x20\x09-\x0D]", "", text)
        faults.append("b" if not solid else "d" if (role, text) in seen else "t" if solid[-1] not in ".!?" else "-")
        seen.add((role, text))
    turns = [r[0] for r in rows if r[0] is not None]
    cost, audit = repaired_slowly([(role[:1], f) for (_, role, _), f in zip(rows, faults, strict=True)])
    lines = [f"{role}:{text}" for role, text in cr.edited(audit, iter([r[1:] for r in rows]))]
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows[:-1], rows[1:], strict=True)]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *[faults.count(f) for f in "bdt"], sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, sha256("\n".join(lines).encode()).hexdigest())


def damaged_slowly(rows):
    out = {}
    for conv, turn, role, text in rows:
        kept = out.setdefault(conv, [])
        named = " " if conv is None else conv, " " if turn is None else turn
        harm = zlib.crc32(f"{named[0]}:{named[1]}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text
        kept += [(turn, "user" if harm == 4 else role, text)] * (0 if harm == 0 else 2 if harm == 3 else 1)
    return out


def made_conversations():
    rng = random.Random(3)
    roles = ["user", "assistant", "system", "tool", "", None, "uhu"]
    texts = ["Hello there.", "What?", "ok", "A much longer answer with words!", "", None, " \t", "é\n.", "Hello there.\n"]
    rows = []
    for conv in [*range(60), None]:
        for turn in range(rng.randrange(9)):
            rows.append((conv, None if rng.random() < 0.05 else turn + (turn > 4) * 2, rng.choice(roles[:2]) if rng.random() < 0.8 else rng.choice(roles), rng.choice(texts)))
    rows += [(1000, t, "user" if t % 2 == 0 else "assistant", f"turn {t}.") for t in range(700)]
    rows += [(1001, t, "tool", f"turn {t}.") for t in range(500)]
    rows += [(1002, 5, "user", "same.")] * 40 + [(1003, t, "user", "same.") for t in range(300)]
    rows += [(1004, 0, "user", "x" * 3_000_000 + "."), (1004, 1, "assistant", "y. " * 400_000)]
    return rows


@pytest.mark.parametrize("partitions,block", [("4", 256), ("23", 16)])
def test_conversations_are_the_loops(spark, monkeypatch, tmp_path, partitions, block):
    monkeypatch.setattr(cr, "BLOCK", block)
    rows = made_conversations()
    frame = spark.createDataFrame([(*r, 1, "z", 2) for r in rows], "conv_id long, turn long, role string, text string, cost int, digest string, n int")
    frame.write.parquet(f"{tmp_path}/conversations.parquet")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        found = {r.conv_id: tuple(r)[1:] for r in cr.op12_conversation_repair(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    slow = {conv: conversation_slowly(kept) if kept else (0, 0, 0, 0, 0, 0, "", sha256().hexdigest()) for conv, kept in damaged_slowly(rows).items()}
    assert found == slow


def test_no_conversations(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert cr.op12_conversation_repair(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", ["op12_conversation_repair", "op13_vector_codes"])
def test_queries_match_sql(spark, duck, name):
    from conftest import SMALL, same_rows

    from sievework.llm import registry

    same_rows(registry.queries()[name](spark, SMALL), duck, registry.oracle_sql()[name])
