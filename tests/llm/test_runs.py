"""Periodic runs against a search of every stretch."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillbar.llm import periodic_runs, queries
from quillbar.llm.sql import PERIODIC_RUNS
from tests.helpers import DATA, agree, twin
from tests.llm.rows import documents, odd_documents


def brute(x, least):
    """Every period and every maximal stretch of it."""
    found = {}
    for q in range(1, len(x)):
        i = 0
        while i + q < len(x):
            j = i
            while j + q < len(x) and x[j] == x[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e, q) for (s, e), q in found.items())


def test_z_function():
    rng = random.Random(3)
    for _ in range(200):
        s = [rng.randrange(2) for _ in range(rng.randrange(1, 40))]
        z = periodic_runs.z_function(np.array(s))
        for i in range(1, len(s)):
            k = next((k for k in range(len(s) - i) if s[k] != s[i + k]), len(s) - i)
            assert z[i] == k


@pytest.mark.parametrize("letters", [1, 2, 3, 6])
@pytest.mark.parametrize("least", [2, 5, 12])
def test_runs_and_zones(letters, least):
    rng = random.Random(letters * 100 + least)
    for _ in range(150):
        docs = []
        for _ in range(rng.randrange(1, 5)):
            x = [rng.randrange(letters) for _ in range(rng.randrange(0, 60))]
            if x and rng.random() < 0.6:
                p = rng.randrange(1, len(x) + 1)
                x[len(x) // 3 :] = [x[len(x) // 3 :][i % p] for i in range(len(x) - len(x) // 3)] if p <= len(x) - len(x) // 3 else x[len(x) // 3 :]
            docs.append(x)
        for x in docs:
            assert [tuple(r) for r in periodic_runs.runs_of(np.array(x, dtype=np.int64), least).tolist()] == brute(x, least)
        if least % 2 == 0 and least > 2:
            flat = np.array([w for x in docs for w in x], dtype=np.int64)
            lengths = np.array([len(x) for x in docs])
            lo, hi = periodic_runs.zones(flat, lengths, least)
            at = 0
            for x in docs:
                for s, e, _ in brute(x, least):
                    assert any(a <= at + s and at + e <= b for a, b in zip(lo, hi, strict=True))
                assert all(b <= at or a >= at + len(x) or (a >= at and b <= at + len(x)) for a, b in zip(lo, hi, strict=True))
                at += len(x)


def plain(doc_id, text):
    """The contract's row in plain Python."""
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w]
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words, 12)
    gone = {i for s, e, q in runs for i in range(s + q, e)}
    best = min(((s - e, s, q) for s, e, q in runs), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    lines = "".join(f"{s},{e - s},{q}\n" for s, e, q in runs)
    top = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *top, sha(lines), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def rows_of(docs):
    out = periodic_runs.digests(periodic_runs.periodic_runs(periodic_runs.with_planted_runs(docs)))
    return sorted((tuple(r[c] for c in COLUMNS) for r in out.collect()), key=repr)


def test_odd_rows(spark):
    """Nulls, empty and long texts, repeated rows, extra columns of the same names."""
    docs = odd_documents(spark).withColumns({c: F.lit("clash") for c in ("runs", "collapsed", "h", "g", "p", "best")}).where("doc_id is null or doc_id not in (9007, 9008)")
    want = sorted((plain(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()), key=repr)
    assert rows_of(docs) == want
    assert rows_of(docs.where("false")) == []


def test_long_texts(spark):
    rows = [(1, "a b c d e f g " * 9_000, "", "", 0), (2, "a " * 40_000, "", "", 0), (3, " ".join(f"w{i}" for i in range(50_000)) + " x y" * 7, "", "", 0)]
    found = {r["doc_id"]: r for r in periodic_runs.periodic_runs(documents(spark, rows).select("doc_id", periodic_runs.words_of(F.col("text")).alias("words"))).collect()}
    assert [tuple(r) for r in found[1]["runs"]] == [(0, 63_000, 7)] and found[1]["collapsed"] == "a b c d e f g"
    assert [tuple(r) for r in found[2]["runs"]] == [(0, 40_000, 1)] and found[2]["collapsed"] == "a"
    assert [tuple(r) for r in found[3]["runs"]] == [(50_000, 14, 2)]


def test_periods_that_overlap(spark):
    """Runs of several periods side by side, and one repetition within another."""
    texts = ["a a b " * 8, "x y " * 7 + "x z " * 7, ("k " * 13 + "l ") * 3, "p q r s t u " * 2, "p q r s t " * 2, "one two three four five six seven eight nine ten eleven twelve"]
    docs = documents(spark, [(i, t, "en", "a", 0) for i, t in enumerate(texts * 12)])
    assert rows_of(docs) == sorted((plain(i, t) for i, t in enumerate(texts * 12)), key=repr)


def test_query_is_its_sql(spark):
    agree(queries.QUERIES["op11_periodic_runs"](spark, DATA), *twin(DATA, PERIODIC_RUNS))
