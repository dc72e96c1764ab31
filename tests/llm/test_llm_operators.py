"""Each operator over null, empty, long, repeated and clashing rows, against brute force."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest

from sievework.llm import common, gru_lm, host_rules, jaccard_join, license_scan, metric_join, mixing, packing, quality_cnn, suffix_dedup, token_files
from sievework.llm.common import components, most_frequent, shared_dir

WORDS = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua".split()


def prose(seed: int, n: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(WORDS, n))


def rows():
    base = prose(1, 120)
    edited = base.split()
    edited[60] = "changed"
    return [
        (1, base, "s1"), (2, base, "s1"), (3, " ".join(edited), "s2"), (4, prose(2, 300), None), (5, None, "s2"), (6, "", "s3"), (7, "short one", "s3"), (None, base, "s1"),
        (8, prose(3, 5000) + " " + base, "s1"), (9, "na " * 90, "s2"), (9, "na " * 90, "s2"), (10, prose(4, 80).upper(), "s3"), (11, "x", ""),
    ]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 0, "q", 1, "c", 2) for r in rows()], "doc_id long, text string, source string, size int, score string, `key` int, kept string, range int").cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")


def split(text):
    for c in "\t\n\x0b\x0c\r":
        text = (text or "").replace(c, " ")
    return [w for w in text.split(" ") if w]


def reach(links, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("few", [0, 1 << 18])
def test_components(spark, monkeypatch, few):
    monkeypatch.setattr(common, "FEW", few)
    rng = np.random.default_rng(0)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2))] + [(100 + i, 101 + i) for i in range(20)]
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    expected = reach(links, {x for link in links for x in link})
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert found == {n: c for n, c in expected.items() if n in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("hot", [None, 2])
def test_suffix_dedup(docs, none, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(suffix_dedup, "HOT", hot)
    found = suffix_dedup.remove_repeats(docs.repartition(3)).collect()
    texts = [(i, (t or "").encode()) for i, t, _ in rows()]
    strings = Counter(t[k : k + 200] for _, t in texts for k in range(len(t) - 199))
    expected = []
    for i, t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for k in range(len(t) - 199):
            if strings[t[k : k + 200]] > 1:
                gone[k : k + 200] = True
        left = bytes(b for b, g in zip(t, gone, strict=False) if not g)
        expected.append((i, len(t), int(gone.sum()), int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(t) else 0, sha256(left).hexdigest()))
    mine = [(r.doc_id, r.n_bytes, r.n_removed, len(r.spans), sha256(bytes(r.kept)).hexdigest()) for r in found]
    assert sorted(map(repr, mine)) == sorted(map(repr, expected))
    assert suffix_dedup.remove_repeats(none).count() == 0


@pytest.mark.parametrize("costly", [256, -1])
def test_jaccard(docs, none, monkeypatch, costly):
    monkeypatch.setattr(jaccard_join, "COSTLY", costly)
    monkeypatch.setattr(jaccard_join, "FAMILY", 500)
    if costly < 0:
        monkeypatch.setattr(jaccard_join, "COSTLY_SHARE", 0.0)
    found = jaccard_join.jaccard_components(docs).collect()
    sets = []
    for i, t, _ in rows():
        w = split(t.lower() if t else t)
        sets.append((i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())))
    links = [(a, b) for a, x in sets for b, y in sets if a is not None and b is not None and x and 100 * len(x & y) >= 75 * len(x | y)]
    part = reach(links, {i for i, _ in sets if i is not None})
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=repr) == sorted(((i, len(x), part.get(i)) for i, x in sets), key=repr)
    assert jaccard_join.jaccard_components(none).count() == 0


def test_suffix_dedup_of_many_equal_rows(spark):
    """Rows that repeat, id and all, cost as much as one, and their text is found elsewhere."""
    text = prose(21, 300)
    data = [(1, text)] * 3000 + [(None, text)] * 3000 + [(2, prose(22, 50) + " " + text[100:600]), (3, "tiny"), (3, "tiny"), (4, prose(23, 300))]
    found = Counter((r.doc_id, r.n_bytes, r.n_removed) for r in suffix_dedup.remove_repeats(spark.createDataFrame(data, "doc_id long, text string").repartition(4)).collect())
    n = len(text)
    assert found == {(1, n, n): 3000, (None, n, n): 3000, (2, len(data[6000][1]), 500): 1, (3, 4, 0): 2, (4, len(data[-1][1]), 0): 1}


def test_suffix_dedup_of_long_texts_in_parts(spark, monkeypatch):
    """Parts share the bytes that strings over their edges need; names that clash are told apart."""
    monkeypatch.setattr(suffix_dedup, "PART", 700)
    body = prose(31, 2500)
    data = [(1, body), (2, prose(32, 400) + body[3000:9000]), (3, body[650:1000])]
    found = {r.doc_id: (r.n_removed, [(x.start, x.stop) for x in r.spans]) for r in suffix_dedup.remove_repeats(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    strings = Counter(t[k : k + 200] for _, t in data for k in range(len(t) - 199))
    for i, t in data:
        gone = [any(strings[t[k : k + 200]] > 1 for k in range(max(0, j - 199), min(j, len(t) - 200) + 1)) for j in range(len(t))]
        assert found[i][0] == sum(gone) and all(all(gone[a:b]) for a, b in found[i][1])


def shingle_links(data):
    sets = {}
    for i, t in data:
        w = split(t.lower() if t else t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    return sets, [(a, b) for a, x in sets.items() for b, y in sets.items() if a < b and x and 100 * len(x & y) >= 75 * len(x | y)]


@pytest.mark.parametrize("costly", [32, 3, -1])
def test_jaccard_with_shared_passages(spark, monkeypatch, costly):
    """Passages that many texts share, texts made of them, and large groups of near copies, in each way of comparing them."""
    monkeypatch.setattr(jaccard_join, "COSTLY", costly)
    monkeypatch.setattr(jaccard_join, "COSTLY_SHARE", 0.0 if costly < 32 else 0.25)
    monkeypatch.setattr(jaccard_join, "FAMILY", 700)
    rng = np.random.default_rng(11)
    word = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 5000, n))
    passages = [word(30) for _ in range(6)]
    texts = [word(int(rng.integers(5, 90))) + " " + passages[i % 3] for i in range(60)]
    texts += [" ".join(passages[k] for k in rng.permutation(6)[:5]) + " " + word(int(rng.integers(0, 12))) for _ in range(40)]
    base = word(80).split()
    for _ in range(50):
        own = list(base)
        for k in rng.integers(0, 80, 3):
            own[k] = f"e{rng.integers(0, 9)}"
        texts.append(" ".join(own))
    data = list(enumerate(texts))
    sets, links = shingle_links(data)
    part = reach(links, sets)
    found = jaccard_join.jaccard_components(spark.createDataFrame(data, "doc_id long, text string").repartition(5)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == {i: (len(sets[i]), part[i]) for i in sets}


def test_jaccard_of_many_equal_rows(spark):
    """Rows that repeat, id and all, are one document, and cost no more than one each."""
    data = [(1, prose(5, 60))] * 4000 + [(2, prose(5, 60) + " more"), (None, prose(5, 60)), (3, prose(6, 60))]
    found = Counter((r.doc_id, r.component_id) for r in jaccard_join.jaccard_components(spark.createDataFrame(data, "doc_id long, text string").repartition(4)).collect())
    assert found == {(1, 1): 4000, (2, 1): 1, (None, None): 1, (3, 3): 1}


def test_the_most_frequent_rows(spark):
    """All of the least count that leaves room, and none where even the first step has too many."""
    frame = spark.createDataFrame([(i, 2 if i < 50 else 90) for i in range(60)], "shingle long, n long")
    assert [most_frequent(frame, most).count() for most in (60, 59, 10, 9)] == [60, 10, 10, 0]
    assert sorted(r.shingle for r in most_frequent(frame, 10).collect()) == list(range(50, 60))


def test_metric_join(spark, monkeypatch):
    monkeypatch.setattr(metric_join, "CELL", 8)
    monkeypatch.setattr(metric_join, "CHUNK", 5)
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((6, 8))
    vectors = [[float(x) for x in centres[i % 6] + rng.standard_normal(8) * 0.12] for i in range(90)]
    data = [(i, v, i % 2) for i, v in enumerate(vectors)] + [(200, vectors[0], 0), (201, vectors[0], 1), (202, None, 0), (203, [0.0] * 8, 0), (204, [float("nan")] * 8, 1), (205, vectors[1], None), (206, [1e300] * 8, 0), (207, [1.0] * 8, 0), (208, [None] * 8, 0), (209, [], 1), (None, vectors[2], 0), (210, [1.0], 0), (211, [2.0], 0)]
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in metric_join.embedding_links(spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")).collect()}
    fine = {i: (np.array(v, float) / max(abs(x) for x in v), g) for i, v, g in data if i is not None and g is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    links = [(a, b) for a, (x, g) in fine.items() for b, (y, h) in fine.items() if a != b and g == h and len(x) == len(y) and x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.98]
    part, degree = reach(links, [i for i, *_ in data if i is not None]), Counter(a for a, _ in links)
    assert found == {None: (0, None, False)} | {i: (degree[i], part[i], part[i] == i) for i, *_ in data if i is not None}
    assert metric_join.embedding_links(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_metric_join_keeps_links_over_blocks():
    """A home that moves to a smaller root takes its old root along, in whichever block that happens."""
    import pyarrow as pa

    def batch(nodes, vectors, looked):
        n = len(nodes)
        columns = [pa.array(["g"] * n), pa.array([0] * n), pa.array([0] * n, pa.int32()), pa.array([looked] * n), pa.array(nodes, pa.int64()), pa.array([1] * n, pa.int64()), pa.array(vectors, pa.list_(pa.float64()))]
        return pa.RecordBatch.from_arrays(columns, names=["group", "cell", "chunk", "looked", "node", "weight", "vector"])

    at = lambda degrees: [math.cos(math.radians(degrees)), math.sin(math.radians(degrees))]
    least = math.cos(math.radians(10.5))
    # first x links r and h, then y links h to s, which takes r along
    homes = batch([1, 2, 3], [at(0), at(40), at(20)], True)
    parts = [batch([11], [at(30)], False), batch([12], [at(10)], False)]
    pairs = [(a, b) for out in metric_join._joined(iter([homes, *parts]), least) for a, b in zip(out.column(0).to_pylist(), out.column(2).to_pylist(), strict=True)]
    assert set(reach(pairs, [1, 2, 3, 11, 12]).values()) == {1}
    rng = np.random.default_rng(8)
    for _ in range(40):
        angles = rng.uniform(0, 360, 40)
        own = batch(list(range(20)), [at(a) for a in angles[:20]], True)
        streams = [batch([20 + k], [at(angles[20 + k])], False) for k in range(20)]
        pairs = [(a, b) for out in metric_join._joined(iter([own, *streams]), least) for a, b in zip(out.column(0).to_pylist(), out.column(2).to_pylist(), strict=True)]
        gap = np.abs(angles[:20, None] - angles[20:])
        links = [(int(i), int(20 + j)) for i, j in zip(*np.nonzero(np.minimum(gap, 360 - gap) <= 10.5), strict=True)]
        assert reach(pairs, range(40)) == reach(links, range(40))


def test_token_files_of_texts_that_hold_the_end_token(spark, tmp_path):
    from tokenizers import Tokenizer

    from sievework.llm.tokenise import tokenizer_file

    whole = Tokenizer.from_str(tokenizer_file())
    texts = ["one", "a<|endoftext|>b c", "two words", "<|endoftext|>", "three more words"]
    manifest = token_files.write_token_files(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), str(tmp_path))
    got = manifest.join(token_files.scan_token_files(spark, str(tmp_path)), ["file", "doc_no"], "full").select("id", "n_tokens", "closed").collect()
    assert sorted(map(tuple, got)) == [(i, len(whole.encode(t, add_special_tokens=False).ids), True) for i, t in enumerate(texts)]
    with pytest.raises(ValueError, match="separator"):
        token_files.write_token_files(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path), end=49407)


def test_token_files(spark, docs, none, tmp_path):
    from tokenizers import Tokenizer

    from sievework.llm.tokenise import tokenizer_file

    whole = Tokenizer.from_str(tokenizer_file())
    manifest = token_files.write_token_files(docs.repartition(3), str(tmp_path))
    for block in (6, 4096):
        found = token_files.scan_token_files(spark, str(tmp_path), block=block)
        got = manifest.join(found, ["file", "doc_no"], "full").select("id", "n_tokens", "closed").collect()
        expected = [(i, len(whole.encode(t or "", add_special_tokens=False).ids), True) for i, t, _ in rows()]
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, expected))
    other = tmp_path / "other"
    other.mkdir()
    (other / "a.bin").write_bytes(np.array([9, 5, 5, 9, 9, 5], "<u4").tobytes() + b"\x01")
    (other / "empty.bin").write_bytes(b"")
    got = token_files.scan_token_files(spark, str(other), end=9, width=4, block=8).orderBy("doc_no").collect()
    assert [(r.doc_no, r.start, r.n_tokens, r.closed) for r in got] == [(0, 0, 0, True), (1, 1, 2, True), (2, 4, 0, True), (3, 5, 1, False)]
    assert token_files.write_token_files(none, str(tmp_path)).count() == 0
    far = tmp_path / "far"
    far.mkdir()
    ids = np.random.default_rng(1).integers(0, 40, 5000).astype("<u2")
    (far / "x.bin").write_bytes(ids.tobytes())
    got = token_files.scan_token_files(spark, str(far), end=7, block=34).orderBy("doc_no").collect()
    stops = np.flatnonzero(ids == 7)
    begins = np.append(0, stops + 1)
    expected = [(int(b), int(e - b), True) for b, e in zip(begins[:-1], stops, strict=True)] + [(int(begins[-1]), 5000 - int(begins[-1]), False)] * int(begins[-1] < 5000)
    assert [(r.start, r.n_tokens, r.closed) for r in got] == expected


def test_packing(docs, none):
    from tokenizers import Tokenizer

    from sievework.llm.tokenise import tokenizer_file

    whole = Tokenizer.from_str(tokenizer_file())
    found = packing.pack(docs.coalesce(1)).collect()
    texts: dict = {}
    for r in sorted(found, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.doc_tokens, r.start)):
        texts.setdefault((r.doc_id, r.doc_tokens), []).append(np.frombuffer(r.ids, "<u4"))
    for i, t, _ in rows():
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 2]
        copies = sum(1 for j, u, _ in rows() if (j, u) == (i, t))
        assert sorted(np.concatenate(texts[i, len(ids)]).tolist()) == sorted(ids * copies)
    by_sequence: dict = {}
    for r in found:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(n for _, n in x) <= 4096 and sorted(x)[0][0] == 0 for x in by_sequence.values())
    assert packing.pack(none).count() == 0


def test_licenses(spark, none):
    notice = license_scan.TEMPLATES["MIT notice"]
    worn = notice.replace("free of charge", "gratis").replace("modify,", "alter,")
    data = [(1, "some text. Released under the MIT License.\nmore"), (2, notice), (3, f"é {worn} end"), (4, "released under a license"), (5, None), (6, ""), (None, "LICENSED under CC-BY-NC 4.0"), (7, "Released under the MIT License. " * 3), (8, license_scan.TEMPLATES["MIT text"])]
    found = license_scan.scan(spark.createDataFrame(data, "doc_id long, text string")).collect()
    seen = Counter((r.doc_id, r.license) for r in found)
    assert seen == {(1, "MIT line"): 1, (2, "MIT notice"): 1, (3, "MIT notice"): 1, (None, "CC-BY-NC-4.0 line"): 1, (7, "MIT line"): 3, (8, "MIT text"): 1, (8, "MIT notice"): 1}
    for r in found:
        text = dict(data)[r.doc_id].encode()
        if r.license == "MIT line":
            assert text[r.start : r.stop] == b"Released under the MIT License" and r.coverage == 1
        if r.doc_id == 3:
            assert 0.9 < r.coverage < 1 and text[r.start : r.stop].startswith(b"Permission is") and text[: r.start] == "é ".encode()
    assert license_scan.scan(none).count() == 0


def worn(words, share, rng):
    """Words with that share of them replaced, dropped, or doubled."""
    out = list(words)
    for k in sorted(rng.choice(len(out), int(share * len(out)), replace=False).tolist(), reverse=True):
        way = rng.integers(0, 3)
        out[k : k + 1] = [f"x{rng.integers(0, 99)}"] if way == 0 else ([] if way == 1 else [out[k], f"y{rng.integers(0, 99)}"])
    return out


def test_licenses_against_alignments_everywhere():
    """Of the templates that an alignment on some diagonal reports, the index misses few, however worn; it reports no other."""
    rng = np.random.default_rng(17)
    names = ["Apache-2.0 line", "MIT line", "MIT notice", "GPL-3.0 line", "BSD notice", "CC-BY-4.0 notice", "MPL-2.0 notice", "Unlicense notice"]
    index = license_scan.Index({n: license_scan.TEMPLATES[n] for n in names})
    code = lambda text: license_scan.letter_words(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))[0]
    due = hit = 0
    for share in (0, 0.05, 0.1, 0.15, 0.2):
        for name in names:
            for _ in range(4):
                text = " ".join([prose(int(rng.integers(0, 99)), 12), *worn(license_scan.TEMPLATES[name].split(), share, rng), prose(int(rng.integers(0, 99)), 12)])
                words = code(text)
                found = {names[t] for t, *_ in license_scan.find(index, words, 4, 0.8)}
                every = set()
                for k, own in enumerate(index.words):
                    if any(len(license_scan.align(own, words, d, 4)) >= 0.8 * len(own) for d in range(-4, len(words), 4)):
                        every.add(names[k])
                assert found <= every
                due += len(every)
                hit += len(found & every)
    assert due > 120 and hit / due > 0.95
    assert [names[t] for t, *_ in license_scan.find(index, code("Released under an MIT License."), 4, 0.8)] == ["MIT line"]


def test_templates_are_winnowed():
    """Each row of WINDOW grams has a fingerprint, and the index holds fewer than there are grams."""
    text = license_scan.TEMPLATES["MIT text"]
    index = license_scan.Index({"one": text})
    places = sorted(index.at.tolist())
    assert max(np.diff(places)) <= license_scan.WINDOW and places[0] < license_scan.WINDOW and len(places) < 0.8 * (len(index.words[0]) - 2)


@pytest.mark.parametrize("spare", [61, 62])
def test_repeated_windows_that_share_upper_bits(spark, monkeypatch, spare):
    """With two or three bits of a hash in the sort, equal windows are often not neighbours."""
    monkeypatch.setattr(host_rules, "POSITION_BITS", ((1 << 16, spare), (1 << 24, spare), (1 << 31, spare)))
    texts = [prose(i, 60) + " " + prose(i + i % 2, 60) for i in range(30)] + ["na " * 30, "a b", ""]
    found = {r.id: r.n_repeat_words for r in host_rules.measures(spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")).collect()}
    for i, t in enumerate(texts):
        w = split(t)
        grams = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        assert found[i] == len({k + j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(3)})


def test_host_rules(docs, none):
    found = host_rules.judge_hosts(docs).collect()
    expected = []
    for i, t, _ in rows():
        w = split(t)
        grams = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        again = {k + j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [line for line in (t or "").split("\n") if split(line)]
        expected.append((i, len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(again)))
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in found), key=repr) == sorted(expected, key=repr)
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and (not r.kept or not r.base_failed) for r in found)
    assert host_rules.judge_hosts(none).count() == 0


def test_a_bad_host_goes_and_a_small_one_is_shrunk(spark):
    data = [(i, prose(i, 60) if i % 10 else "bad", "good") for i in range(60)] + [(100 + i, "bad" if i % 10 else prose(i, 60), "bad") for i in range(60)] + [(900, prose(900, 60), "one")]
    found = {r.doc_id: r.kept for r in host_rules.judge_hosts(spark.createDataFrame(data, "doc_id long, text string, source string")).collect()}
    assert found[1] and not found[0] and not found[100] and found[900]


def test_mix(docs, none):
    found = mixing.mix(docs).collect()
    assert sorted(map(repr, found)) == sorted(map(repr, mixing.mix(docs.repartition(5)).collect()))
    sizes, taken, target = Counter(), Counter(), {}
    for r in found:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 2 * r.size and r.source_size == sum(len(split(t)) for _, t, s in rows() if s == r.source)
    weights, left, open_ = dict(zip(sorted(x for x in sizes if x is not None), [5, 2, 1] * 9, strict=False)), 1.5 * sum(sizes.values()), set(sizes)
    weights[None] = [5, 2, 1][len(weights) % 3]
    goal = {}
    while True:
        share = left / sum(weights[x] for x in open_)
        over = {x for x in open_ if weights[x] * share > 2 * sizes[x]}
        if not over:
            break
        for x in over:
            goal[x] = 2.0 * sizes[x]
            left -= goal[x]
        open_ -= over
    goal |= {x: weights[x] * share for x in open_}
    assert target == pytest.approx(goal) and all(abs(taken[x] - goal[x]) <= 1 for x in goal)
    assert mixing.mix(none).count() == 0


def test_language_model(docs, none, spark):
    two = lambda i: " ".join(np.random.default_rng(i).choice(WORDS[i % 2 :: 2], 60 + i))
    data = [(i, two(i) if i % 11 else None, "s") for i in range(80)] + [(None, "lorem", "s"), (81, "never seen words", "s"), (82, "", "s")]
    frame = spark.createDataFrame(data, "doc_id long, text string, source string")
    known = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 7 != 2
    model, vocabulary, words = gru_lm.learn(frame.where(quality_cnn.fold("doc_id", 7) != 2), start=20)
    found = gru_lm.score(frame, model, vocabulary, words).collect()
    counts = Counter(w for i, t, _ in data if known(i) for w in [*split((t or "").lower()), None])
    n, v = sum(counts.values()), len(counts)
    expected = {i: [*split((t or "").lower()), None] for i, t, _ in data}
    for r in found:
        own = expected[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(counts[w] > 0 for w in own), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own), rel=1e-9)
    assert sum(r.score for r in found) > sum(r.base_score for r in found) and all(r.score < 0 for r in found)
    assert gru_lm.score(none, model, vocabulary, words).count() == 0


def test_listed_and_rare_words_add_up(spark, monkeypatch):
    monkeypatch.setattr(gru_lm, "LISTED", 4)
    frame = spark.createDataFrame([(i, f"the cat w{i} w{i % 3} w{i}") for i in range(30)], "doc_id long, text string")
    model, vocabulary, words = gru_lm.learn(frame, start=5)
    counts = Counter(w for i in range(30) for w in ["the", "cat", f"w{i}", f"w{i % 3}", f"w{i}", None])
    for r in gru_lm.score(frame, model, vocabulary, words).collect():
        own = ["the", "cat", f"w{r.doc_id}", f"w{r.doc_id % 3}", f"w{r.doc_id}", None]
        assert r.n_known == 6 and r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (180 + len(counts) + 1)) for w in own), rel=1e-9)


def test_classifier_learns(spark, none):
    good, bad = [(i, prose(i, 40), 1) for i in range(60)], [(100 + i, prose(i, 40).upper().replace(" ", "!! "), 0) for i in range(60)]
    frame = spark.createDataFrame([(i, t, "x") for i, t, _ in good + bad] + [(300, None, "x"), (301, "", "x"), (None, "text", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, q) for i, _, q in good + bad] + [(300, None), (None, 1)], "doc_id long, quality int")
    model = quality_cnn.quality_model(frame, labels)
    again = quality_cnn.quality_model(frame.repartition(3), labels.repartition(2))
    assert all((model[k] == again[k]).all() for k in model)
    found = {r.doc_id: r.score for r in quality_cnn.score(frame, model).collect()}
    held = [(i, q) for i, _, q in good + bad if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(found[i] >= 0.5) == q for i, q in held]) > 0.95 and all(0 <= s <= 1 for s in found.values()) and found[300] == found[301]
    assert quality_cnn.score(none, model).count() == 0 and quality_cnn.score(frame, quality_cnn.fit(frame, labels.limit(0))).count() == 123


def test_long_texts_score_whole():
    model = quality_cnn.fresh_model(4)
    text = prose(9, 4000).encode()
    one = quality_cnn.score_texts(model, np.frombuffer(text, np.uint8), np.array([0, len(text)]), piece=7)
    two = quality_cnn.score_texts(model, np.frombuffer(text + b"tail" + text, np.uint8), np.array([0, len(text), len(text) + 4, 2 * len(text) + 4]))
    assert one[0] == pytest.approx(two[0], rel=1e-5) and two[0] == pytest.approx(two[2], rel=1e-5)


def test_shared_folder_is_the_set_one(spark):
    class Cluster:
        """A session on a cluster that names no shared folder."""

        class conf:  # noqa: N801
            get = staticmethod(lambda key, other=None: other)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

            class _jsc:  # noqa: N801
                sc = staticmethod(lambda: type("S", (), {"getCheckpointDir": staticmethod(lambda: type("D", (), {"isEmpty": staticmethod(lambda: True)}))}))

    with pytest.raises(ValueError, match="checkpoint"):
        shared_dir(Cluster)
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
