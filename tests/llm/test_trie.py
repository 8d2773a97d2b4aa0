"""The prefix trie against one built in memory."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quillbar.llm import prefix_trie, queries
from quillbar.llm.sql import PREFIX_TRIE
from tests.helpers import DATA, agree, twin

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    """Rows without ties but of equal turns."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(own[c])] for c in own}
    members, end = defaultdict(list), defaultdict(list)
    for c, l in own.items():  # noqa: E741
        h = zlib.crc32(str(c).encode()) % 4
        made = own.get(c - c % 20, [])[:h] + l[h:]
        for d in range(len(made) + 1):
            members[tuple(made[:d])].append(c)
        end[tuple(made)].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for key in members:
        if key:
            kids[key[:-1]] += 1
    for key in members:
        words = len([w for w in re.split(r"[\x20\x09-\x0D]+", key[-1][1]) if w]) if key else 0
        for d in range(len(key) + 1):
            leaves[key[:d]] += not kids[key]
            saved[key[:d]] += (len(members[key]) - 1) * words
    sha = lambda x: hashlib.sha256(",".join(map(str, sorted(x))).encode()).hexdigest()
    return sorted(((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k], sha(end[k])) for k, m in members.items()), key=repr)


def trie(spark, rows):
    table = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("d", "k1", "k2", "place", "words", "n", "path", "head", "h", "part", "size")})
    found = prefix_trie.prefix_trie(*prefix_trie.rebuilt(table)).collect()
    return sorted((tuple(r[c] for c in COLUMNS) for r in found), key=repr)


def chats(rng, count, texts, longest):
    return [(c, t, rng.choice(["user", "assistant"]) if texts > 3 else "user", f"say {rng.randrange(texts)} now") for c in range(count) for t in range(rng.randrange(longest + 1))]


@pytest.mark.parametrize("count,texts,longest", [(120, 2, 6), (60, 1, 12), (100, 5, 4)])
def test_random_chats(spark, count, texts, longest):
    rows = chats(random.Random(count), count, texts, longest)
    assert trie(spark, rows) == brute(rows)


def test_odd_rows(spark):
    """Null ids, turns, roles and texts, turnless results, repeated rows, empty tables."""
    rows = [(None, 0, "user", "a"), (40, None, None, None), (40, 1, "user", " \t "), (41, 1, "user", "x y"), (41, 1, "user", "x y"), (41, 1, "user", "x y"), (45, 0, None, ""), (60, 7, "a", "b"), (1_000_003, None, "u", "v w")]
    rows += [(c, 0, "user", "only turn") for c in range(200, 260)] + [(c, 1, "user", "two") for c in range(220, 230)]
    assert trie(spark, rows) == brute(rows)
    assert trie(spark, []) == [] and trie(spark, [(None, 1, "a", "b")]) == []
    assert trie(spark, [(5, 0, "a", "b")]) == brute([(5, 0, "a", "b")])


def test_long_conversation_and_copies(spark, monkeypatch):
    """One conversation holds a third of all rows, and many conversations are equal:
    several blocks of places and pieces of ids."""
    monkeypatch.setattr(prefix_trie, "BLOCK_BITS", 3)
    monkeypatch.setattr(prefix_trie, "PIECE", 7)
    rows = [(20, t, "user", f"w{t} of {t % 3}") for t in range(90)] + [(21, t, "user", f"w{t} of {t % 3}") for t in range(70)]
    rows += [(c, t, "user", f"common {t}") for c in range(100, 160) for t in range(4)]
    assert trie(spark, rows) == brute(rows)


def test_equal_turns_are_turns(spark):
    rows = [(20, 0, "user", "again")] * 30 + [(23, 0, "user", "again")] * 12 + [(26, 0, "user", "again")] * 40
    assert trie(spark, rows) == brute(rows)


def test_query_is_its_sql(spark):
    agree(queries.QUERIES["op12_prefix_trie"](spark, DATA), *twin(DATA, PREFIX_TRIE))
