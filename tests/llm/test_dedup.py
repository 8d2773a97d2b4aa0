"""Repeated passages, near copies and edited lines against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillbar.llm import line_dedup, near_copies, repeats, simhash, substring_dedup, suffix_dedup
from quillbar.llm.common import components
from quillbar.llm.queries import ORACLE_SQL, QUERIES
from tests.helpers import DATA, agree, twin
from tests.llm.rows import ODD, documents, odd_documents

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LAST = (1 << 63) - 1


def repeat_rows(unit):
    """Texts with shared passages: nested, overlapping, at ends, in copies."""
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 6)))
    passages = [[word() for _ in range(n)] for n in (30, 49, 50, 51, 80, 200)]
    rows = []
    for i in range(60):
        words = []
        for _ in range(r.randint(0, 6)):
            words += r.choice(passages) if r.random() < 0.6 else [word() for _ in range(r.randint(0, 70))]
            if r.random() < 0.2:
                words += ["ab"] * r.randint(1, 200)
        rows.append((i, r.choice([" ", "  ", "\n"]).join(words), "en", "s", 0))
    rows += [(100 + i, rows[i][1], "en", "s", 0) for i in range(5)]
    return rows


def brute_words(rows, length):
    first, want = {}, {}
    words = {d: WORD.findall((x or "").encode()) for d, x, *_ in rows}
    for d in sorted(words):
        for i in range(len(words[d]) - length + 1):
            first.setdefault(tuple(words[d][i : i + length]), d)
    for d, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if first[tuple(w[i : i + length])] < d:
                gone[i : i + length] = [True] * length
        body = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        want[d] = (len(w), sum(gone), hashlib.sha256(body).hexdigest())
    return want


def brute_bytes(rows, length):
    seen, want = set(), {}
    for d, x, *_ in sorted(rows):
        raw = (x or "").encode()
        gone = np.zeros(len(raw) + 2, dtype=bool)
        for i in range(len(raw) - length + 1):
            piece = raw[i : i + length]
            if piece in seen:
                gone[i + 1 : i + 1 + length] = True
            seen.add(piece)
        spans = int((gone[1:] & ~gone[:-1]).sum())
        keep = ~gone[1:-1]
        want[d] = (len(raw), int((~keep).sum()), spans, hashlib.sha256(bytes(np.frombuffer(raw, np.uint8)[keep])).hexdigest())
    return want


@pytest.mark.parametrize("hot,small", [(False, False), (True, True)])
def test_repeated_words(spark, monkeypatch, hot, small):
    """Also where every anchor counts as hot, and where pieces are tiny."""
    if hot:
        monkeypatch.setattr(repeats, "SAMPLE", 1)
        monkeypatch.setattr(repeats, "HOT", 1)
    rows = repeat_rows("word")
    docs = documents(spark, rows).repartition(3)
    out = substring_dedup.substring_dedup(docs, 20 if small else 50, 6 if small else 12)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in out.collect()}
    assert got == brute_words(rows, 20 if small else 50)


@pytest.mark.parametrize("hot", [False, True])
def test_repeated_bytes(spark, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(repeats, "SAMPLE", 1)
        monkeypatch.setattr(repeats, "HOT", 1)
    rows = repeat_rows("byte")
    out = suffix_dedup.suffix_dedup(documents(spark, rows).repartition(3))
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out.collect()}
    assert got == brute_bytes(rows, 100)


def test_repeats_on_tables(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.substring_dedup(docs).collect()}
    assert got == brute_words(rows, 50)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.suffix_dedup(docs).collect()}
    assert got == brute_bytes(rows, 100)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql_twin(spark, name):
    agree(QUERIES[name](spark, DATA), *twin(DATA, ORACLE_SQL[name]))


def test_repeats_edges(spark):
    docs = odd_documents(spark)
    words = substring_dedup.substring_dedup(docs).collect()
    raw = suffix_dedup.suffix_dedup(docs).collect()
    assert len(words) == len(raw) == len(ODD)
    empty = hashlib.sha256(b"").hexdigest()
    assert sum(r["kept_sha256"] == empty and r["n_words"] == 0 for r in words) == 4
    second = next(r for r in raw if r["doc_id"] == 9008)
    assert second["n_removed"] == second["n_bytes"] and second["n_spans"] == 1
    run = next(r for r in raw if r["doc_id"] == 9010)
    assert run["n_removed"] == 300_000 - 1 - 0 and run["n_spans"] == 1  # all but the first start
    assert next(r for r in words if r["doc_id"] == 9010)["n_removed"] == 0
    for f in (substring_dedup.substring_dedup, suffix_dedup.suffix_dedup):
        assert f(docs.where("false")).count() == 0
    spans = substring_dedup.maximal_repeats(docs).collect()
    assert any(r["doc_id"] == 9008 and r["start"] == 0 and r["end"] == 60_000 for r in spans)


def test_repeats_of_null_ids(spark):
    """5,000 texts without an id: only the repeated passage goes, and only once each."""
    r = random.Random(17)
    said = " ".join(f"w{i}" for i in range(60))
    texts = [" ".join(f"{r.getrandbits(40):x}" for _ in range(55)) for _ in range(5000)]
    rows = [(None, t) for t in texts] + [(None, f"{texts[0]} {said}"), (None, f"{said} more"), (3, f"x {said}")]
    docs = documents(spark, [(i, t, "en", "s", 0) for i, t in rows])
    gone = {x["kept_text"]: x["n_removed"] for x in substring_dedup.substring_dedup(docs).collect()}
    removed = sorted(n for n in gone.values() if n)
    assert gone[f"x {said}"] == 0 and gone["more"] == 60 and len(removed) == 2 or removed == [55, 60, 60]
    raw = suffix_dedup.suffix_dedup(docs).collect()
    assert sum(x["n_removed"] > 0 for x in raw) in (2, 3)


def brute_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    parent = {d: d for d in fps}

    def find(d):
        while parent[d] != d:
            d = parent[d]
        return d

    ids = sorted(fps)
    for i, x in enumerate(ids):
        for y in ids[:i]:
            if (fps[x] ^ fps[y]).bit_count() <= 3:
                a, b = sorted((find(x), find(y)))
                parent[b] = a
    return {d: find(d) for d in fps}


def test_simhash(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    fps = {r["doc_id"]: brute_fingerprint(r["text"]) for r in docs.collect()}
    got = {r["doc_id"]: (r["fp"] & (1 << 64) - 1, r["component_id"]) for r in simhash.simhash_components(docs).collect()}
    roots = brute_components(fps)
    assert got == {d: (fps[d], roots[d]) for d in fps}


@pytest.mark.parametrize("pairs,block", [(64, 4096), (1, 8), (0, 2)])
def test_simhash_links(spark, monkeypatch, pairs, block):
    """Chains and a large group of near fingerprints, by every way a key can take."""
    monkeypatch.setattr(simhash, "PAIRS", pairs)
    monkeypatch.setattr(simhash, "BLOCK", block)
    r = random.Random(3)
    values = {r.getrandbits(64) for _ in range(30)}
    base = r.getrandbits(64)
    for _ in range(60):
        x = base
        for b in r.sample(range(64), r.randint(0, 5)):
            x ^= 1 << b
        values.add(x)
    for b in range(0, 40, 3):
        base ^= 7 << b
        values.add(base)
    values |= {0, (1 << 64) - 1, 7, 15, 1 << 63}
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    edges = simhash.links(spark.createDataFrame(signed, "fp long"))
    roots = {x["node"]: x["root"] for x in components(edges).collect()}
    mine = defaultdict(set)
    for (v,) in signed:
        mine[roots.get(v, v)].add(v & (1 << 64) - 1)
    want = defaultdict(set)
    for v, root in brute_components({v: v for v in values}).items():
        want[root].add(v)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, want.values()))


def test_simhash_edges(spark):
    rows = simhash.simhash_components(odd_documents(spark)).collect()
    assert len(rows) == len(ODD)
    assert {r["component_id"] for r in rows if r["fp"] == 0} == {9001}
    assert {r["component_id"] for r in rows if r["doc_id"] in (None, 9005) and r["fp"] != 0} == {9005}
    assert simhash.simhash_components(odd_documents(spark).where("false")).count() == 0
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([(1,)], "fp long"), 4)


@pytest.mark.parametrize("few,block", [(16, 512), (1, 3)])
def test_near_copies(spark, monkeypatch, few, block):
    """Groups by exact 5-word similarity of 0.8, in pairs and in blocks of large keys."""
    monkeypatch.setattr(near_copies, "FEW", few)
    monkeypatch.setattr(near_copies, "BLOCK", block)
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    rows = []
    for _ in range(25):
        base = [word() for _ in range(r.randint(60, 200))]
        rows.append(base)
        for edits in (0, 1, 2, 3, 5, 9):
            copy = list(base)
            for _ in range(edits):
                copy[r.randrange(len(copy))] = word()
            rows.append(copy)
    rows += [["Only", "three", "words"], ["only", "THREE", "words"], ["other", "words"], [], []]
    docs = documents(spark, [(i, " ".join(t), "en", "s", 0) for i, t in enumerate(rows)])
    got = defaultdict(set)
    for x in near_copies.members(docs).collect():
        got[x["root"]].add(x["doc_id"])
    sets = [{tuple(w.lower() for w in t[i : i + 5]) for i in range(max(1, len(t) - 4))} for t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and label[i] != label[j]:
                label = [label[j] if x == label[i] else x for x in label]
    want = defaultdict(set)
    for i, x in enumerate(label):
        want[x].add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def line_rows():
    r = random.Random(5)
    alphabet = "abc dé"
    base = ["".join(r.choice(alphabet) for _ in range(r.choice([1, 2, 3, 5, 8, 13, 15, 17, *range(10, 40)]))) for _ in range(30)] + ["one two three four five six", "x" * 20, "ab" * 12, "aaaa bbbb cccc dddd"]
    base += ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)) for n in range(6, 18)]

    def edited(s):
        s = list(s)
        for _ in range(r.randint(0, 4)):
            at = r.randrange(len(s) + 1)
            kind = r.random()
            if kind < 0.4:
                s.insert(at, r.choice(alphabet))
            elif kind < 0.7 and s:
                s.pop(min(at, len(s) - 1))
            elif s:
                s[min(at, len(s) - 1)] = r.choice(alphabet)
        return "".join(s)

    return [(i, "\n".join([edited(r.choice(base)) for _ in range(r.randint(0, 9))] + [""] * r.randint(0, 2)), "en", "s", 0) for i in range(50)]


@pytest.mark.parametrize("pairs,edits", [(256, 2), (0, 2), (0, 1)])
def test_edited_lines(spark, monkeypatch, pairs, edits):
    """Links and results; with pairs = 0 every segment's lines meet by rare tokens."""
    monkeypatch.setattr(line_dedup, "PAIRS", pairs)
    rows = line_rows()
    docs = documents(spark, rows)
    lines = [(d, n, x) for d, t, *_ in rows for n, x in enumerate(t.split("\n")) if x.strip(" ")]
    distinct = sorted({x for *_, x in lines})
    linked = {(x, y) for i, y in enumerate(distinct) for x in distinct[:i] if abs(len(x) - len(y)) <= edits and distance(x, y) <= edits}
    by_hash = {r["h"]: r["line"] for r in line_dedup.lines(docs).select("h", "line").distinct().collect()}
    got = {tuple(sorted((by_hash[r["u"]], by_hash[r["v"]]))) for r in line_dedup.line_links(line_dedup.lines(docs), edits).collect()}
    assert got <= linked

    def roots_of(pairs):
        parent = {x: x for x in distinct}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for x, y in pairs:
            a, b = sorted((find(x), find(y)))
            parent[b] = a
        return {x: find(x) for x in distinct}

    root = roots_of(linked)
    assert roots_of(got) == root
    assert len({x for x in distinct if len(x) < 16 and root[x] != x}) > 5
    want, roots, seen = {d: [0, 0, 0] for d, *_ in rows}, set(), set()
    for d, _, x in lines:
        want[d][0] += 1
        if root[x] in roots:
            want[d][1] += 1
            want[d][2] += x not in seen
        roots.add(root[x])
        seen.add(x)
    assert {r["doc_id"]: [r["n_lines"], r["n_removed"], r["n_edited"]] for r in line_dedup.line_dedup(docs, edits).collect()} == want
    assert line_dedup.removed_lines(docs, edits).count() == sum(w[1] for w in want.values())


@pytest.mark.parametrize("edits", [0, 1, 2, 3, 4])
def test_bit_parallel_distance(spark, edits):
    r = random.Random(edits)
    rows = [("", ""), ("", "ab"), ("ab", ""), ("\U0001f600é", "é")]
    for _ in range(400):
        x = "".join(r.choice("abé\U0001f600") for _ in range(r.randint(0, 14)))
        y = list(x)
        for _ in range(r.randint(0, 6)):
            at = r.randrange(len(y) + 1)
            y[at : at + r.randint(0, 1)] = r.choice(["", "a", "b"])
        rows.append((x, "".join(y)))
    out = spark.createDataFrame(rows, "x string, y string").select("x", "y", line_dedup.within(F.col("x"), F.col("y"), edits).alias("near")).collect()
    assert all(o["near"] == (distance(o["x"], o["y"]) <= edits) for o in out)


def test_mutually_linked_lines(spark):
    """10,000 lines that are all within two edits of each other: a few links a line."""
    number = lambda i: chr(0x4E00 + i // 100) + chr(0x5E00 + i % 100)
    text = "\n".join(f"the running foot of a long report, page {number(i)}, all rights reserved" for i in range(10_000))
    docs = documents(spark, [(1, text, "en", "s", 0)])
    assert line_dedup.line_links(line_dedup.lines(docs)).count() <= 100_000  # a pair has nine rare tokens, a group two pivots
    assert [tuple(r) for r in line_dedup.line_dedup(docs).collect()] == [(1, 10_000, 9_999, 9_999)]


def test_lines_edges(spark):
    rows = line_dedup.line_dedup(odd_documents(spark)).collect()
    assert len(rows) == len(ODD)
    by = {r["doc_id"]: r for r in rows}
    assert by[9001]["n_lines"] == by[9002]["n_lines"] == by[9003]["n_lines"] == 0
    assert (by[9011]["n_lines"], by[9011]["n_removed"], by[9011]["n_edited"]) == (40, 39, 0)
    assert by[9008]["n_removed"] == 1
    assert line_dedup.line_dedup(odd_documents(spark).where("false")).count() == 0


def test_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(80)] + [(r.randrange(300, 400), r.randrange(300, 400)) for _ in range(60)] + [(5, 5)]
    got = {x["node"]: x["root"] for x in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        a, b = sorted((find(u), find(v)))
        parent[b] = a
    linked = {x for u, v in edges if u != v for x in (u, v)}
    assert got == {x: find(x) for x in linked}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_classes_grow_by_new_links_as_by_all(spark):
    """Classes of one round and the next one's links give the classes of all links."""
    import random

    rng = random.Random(11)
    links = [[(rng.randrange(-200, 200), rng.randrange(-200, 200)) for _ in range(n)] for n in (90, 60, 40)]
    roots = None
    for part in links:
        roots = near_copies.joined(roots, spark.createDataFrame(part, "u long, v long"))
    whole = components(spark.createDataFrame(sum(links, []), "u long, v long"))
    found = {(r["node"], r["root"]) for r in roots.collect()}
    assert found == {(r["node"], r["root"]) for r in whole.collect()} and len({r for _, r in found}) > 3


def test_a_group_of_near_copies_is_settled_by_pivots(spark, monkeypatch):
    """A pair per entry and key, and no block of texts; one class for the whole group."""
    import random

    def never(*_):
        raise AssertionError("a settled key came into blocks")

    rng = random.Random(8)
    base = [f"w{rng.randrange(900)}" for _ in range(120)]
    rows = [(k, " ".join(w if i != k % 120 else f"x{k}" for i, w in enumerate(base)), "en", "a", 0) for k in range(300)]
    made, pairs = [], near_copies.pivot_pairs
    monkeypatch.setattr(near_copies, "blocks", never)
    monkeypatch.setattr(near_copies, "pivot_pairs", lambda entries, r: (made.append((entries.count(), pairs(entries, r).count())), pairs(entries, r))[1])
    found = near_copies.members(documents(spark, rows)).collect()
    assert len({r["root"] for r in found}) == 1 and len(found) == 300
    assert all(p < n for n, p in made) and made[0][0] <= 300 * near_copies.BANDS
