"""Mixing, sharding, chat linking, decontamination and the pipeline."""

from __future__ import annotations

import json
import random
from collections import defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from quillbar.llm import chat, decontam, mixing, queries, sharding
from tests.helpers import DATA
from tests.llm.rows import ODD, documents, odd_documents


def brute_targets(sizes):
    """Shares of 150 % of all words; excess over 2 x a source dealt again."""
    names = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    weight = {s: Fraction((3, 1, 2)[i % 3]) for i, s in enumerate(names)}
    total, open_, target = Fraction(3, 2) * sum(sizes.values()), set(names), {}
    while open_:
        level = total / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in full:
            target[s] = Fraction(2 * sizes[s])
            total -= target[s]
        open_ -= full
    return target


@pytest.mark.parametrize("table", ["sf", "odd"])
def test_mix(spark, table):
    docs = spark.read.parquet(f"{DATA}/documents.parquet") if table == "sf" else odd_documents(spark)
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    sizes, taken, seen = defaultdict(int), defaultdict(int), {}
    for r in rows:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        seen[r["source"]] = r
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == sum(s["words"] for s in r["spans"])
        assert all(s["start"] >= 0 and s["start"] + s["words"] <= r["size"] for s in r["spans"])
    want = brute_targets(sizes)
    for s, r in seen.items():
        assert r["source_size"] == sizes[s] and abs(r["target"] - float(want[s])) < 1e-6 * (1 + float(want[s]))
        assert abs(taken[s] - float(want[s])) <= max(2 * 64, 0.05 * float(want[s]))
    again = mixing.mix(docs).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))


@pytest.mark.parametrize("table", ["sf", "odd", "long", "none"])
def test_whole_documents(spark, table):
    """Every source ends within 1 % of its target or where no one document brings it nearer,
    and never further off than by rounding passes."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet") if table == "sf" else odd_documents(spark)
    if table == "long":  # texts of 1 to 4,000 words, the last rows said twice
        sizes = [1 + (k * k * 7919) % (4000 if k % 9 == 0 else 60) for k in range(400)]
        rows = [(k, " ".join(f"w{k}" for _ in range(n)), "en", f"s{k % 3}" if k % 50 else None, 0) for k, n in enumerate(sizes)]
        docs = documents(spark, rows + rows[-5:])
    docs = docs.where("false") if table == "none" else docs
    plan, size, target, plain = mixing.mix(docs), defaultdict(int), {}, defaultdict(int)
    for r in plan.collect():
        size[r["doc_id"], r["id"], r["source"]] += r["size"]
        target[r["source"]] = r["target"]
        plain[r["source"]] += r["size"] * sum(2 * w > r["size"] for w in r["by_pass"])
    found, held = mixing.whole_documents(plan).collect(), defaultdict(int)
    for r in found:
        key = r["doc_id"], r["id"], r["source"]
        assert 1 <= r["times"] <= 2 and size[key] > 0
        held[r["source"]] += r["times"] * size[key]
    assert len({(r["doc_id"], r["id"], r["source"]) for r in found}) == len(found)
    for s, want in target.items():
        off = abs(held[s] - want)
        assert off <= abs(plain[s] - want) + 1e-6
        step = 1 if held[s] < want else -1
        times = defaultdict(int, {(r["doc_id"], r["id"], r["source"]): r["times"] for r in found})
        nearer = [k for k, n in size.items() if k[2] == s and n and 0 <= times[k] + step <= 2 and abs(off - n) < off - 1e-6]
        assert off <= 0.01 * want or not nearer
    again = mixing.whole_documents(plan).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))


@pytest.mark.parametrize("count", [1, 7, 300])
def test_house_is_filled(spark, count):
    """Quotas are the house's highest quotients, equal ones at its end apart."""
    rows = [(f"s{i:03}", 1 + (i * 7919) % 5000, float(1 + (i * 7919) % 5000) * (1 + i % 2)) for i in range(count)]
    plan = mixing.seats(spark.createDataFrame(rows, "source string, source_size long, target double"), 16).collect()
    house = round(sum(r["target"] for r in plan) / plan[0]["block"])
    quotients = sorted(((r["target"] / (2 * s + 1), r["source"]) for r in plan for s in range(r["quota"] + 2)), reverse=True)
    won = defaultdict(int)
    for q, s in quotients[:house]:
        won[s] += 1
    last = quotients[house - 1][0]
    tied = sum(abs(q - last) < 1e-9 * last for q, _ in quotients)
    assert sum(r["quota"] for r in plan) - house in range(tied)
    assert sum(abs(won[r["source"]] - r["quota"]) for r in plan) < tied


def test_mix_by_shard(spark):
    """Every prefix of shards is the highest-quotient apportionment of its seats."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    sizes = docs.select("source", F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"))
    plan = mixing.seats(mixing.targets(sizes))
    quotas = defaultdict(dict)
    for r in mixing.shard_quotas(plan, 5).collect():
        quotas[r["shard"]][r["source"]] = r["seats"]
    target = {r["source"]: r["target"] for r in plan.collect()}
    have = dict.fromkeys(target, 0)
    for shard in range(5):
        given = {s: have[s] + quotas[shard][s] for s in have}
        won = dict.fromkeys(target, 0)
        for _ in range(sum(given.values())):
            s = max(won, key=lambda s: (target[s] / (2 * won[s] + 1), s))
            won[s] += 1
        assert sum(abs(won[s] - given[s]) for s in won) <= 2  # ties
        have = given
    block = plan.first()["block"]
    assert sum(have.values()) == round(sum(target.values()) / block)
    assert mixing.mix(docs.where("false")).count() == 0


def test_shards(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sharding.shard(docs).collect()
    load, slots = defaultdict(int), defaultdict(list)
    for r in rows:
        load[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert set(load) == set(range(24)) and max(load.values()) <= 1.02 * min(load.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    # a stored map is edited, not made anew: growing moves few slots
    path = f"{tmp_path}/map"
    sharding.save_map(spark, path, 0, sharding.even_map(512, 4))
    sharding.shard(docs, 4, 512, path).count()
    first = {r["vslot"]: r["shard"] for r in sharding.load_map(spark, path).collect()}
    sharding.shard(docs, 5, 512, path).count()
    second = {r["vslot"]: r["shard"] for r in sharding.load_map(spark, path).collect()}
    assert sharding.load_map(spark, path).first()["version"] == 2 and sharding.load_map(spark, path, 0).count() == 512
    moved = [s for s in first if first[s] != second[s]]
    assert sharding.shard(docs, 3, 64, f"{tmp_path}/none-yet").count() == docs.count()
    with pytest.raises(ValueError):
        sharding.shard(docs, 5, 256, path)
    with pytest.raises(ValueError):
        sharding.shard(docs, 4, 512, path)
    assert 0 < len(moved) <= 512 * 0.5 and set(second.values()) == set(range(5))


def test_shard_edges(spark):
    import zlib

    rows = sharding.shard(odd_documents(spark), 24).collect()
    want = sorted((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for _, t, *_ in ODD)
    assert sorted((r["size"], r["text_crc32"]) for r in rows) == want
    assert sharding.shard(odd_documents(spark).where("false")).count() == 0


SCHEMAS = {"add": {"properties": {"x": {"type": "number"}, "how": {"type": "string", "enum": ["up", "down"]}}, "required": ["x"], "additionalProperties": False}}


def turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("clash") for c in ("depth", "linked", "json", "kind")})


def call(*calls):
    return json.dumps({"tool_calls": [dict(zip(("id", "name", "arguments", "after"), c, strict=False)) for c in calls]})


def test_chat(spark):
    rows = [
        (1, 0, "user", "hi"),
        (1, 1, "assistant", call(("b", "add", {"x": 1, "how": "up"}, "a"), ("a", "add", {"how": "left", "y": True}))),
        (1, 2, "tool", json.dumps({"tool_call_id": "a", "content": {"z": 1, "b": [2, "é"]}})),
        (1, 3, "tool", json.dumps({"tool_call_id": "b", "content": 3})),
        (1, 4, "tool", json.dumps({"tool_call_id": "nope", "content": 3})),
        (1, 5, "assistant", call(("c", "sub", {"x": True}))),
        (2, 0, "assistant", call(("p", "add", {"x": "1"}, "q"), ("q", "add", {"x": 2}, "p"), ("a", "add", [1]))),
        (2, 1, "assistant", None),
        (None, 0, "assistant", call(("a", "add", {"x": 1}))),
        (None, None, None, None),
        (3, 0, "tool", "{not json"),
    ]
    out = chat.link(chat.parse(turns(spark, rows + rows[:1])), SCHEMAS).collect()
    by = {(r["conv_id"], r["kind"], r["call_id"], r["turn"]): r for r in out}
    a, b = by[1, "call", "a", 1], by[1, "call", "b", 1]
    assert a["depth"] == 0 and b["depth"] == 2 and a["linked"] and b["linked"]
    assert by[1, "result", "b", 3]["depth"] == 3 and by[1, "result", "b", 3]["linked"] and not by[1, "result", "nope", 4]["linked"]
    assert b["valid"] and a["errors"] == "how: not allowed; x: missing; y: unknown"
    assert by[1, "call", "c", 5]["errors"] == "unknown tool" and not by[1, "call", "c", 5]["linked"]
    assert by[2, "call", "p", 0]["depth"] is None and by[2, "call", "p", 0]["errors"] == "x: no number" and by[2, "call", "a", 0]["errors"] == "arguments are no object"
    assert not by[None, "call", "a", 0]["linked"]
    assert by[1, "result", "a", 2]["json"] == '{"content":{"b":[2,"é"],"z":1},"role":"tool","tool_call_id":"a"}'
    assert sum(r["kind"] == "message" and r["conv_id"] == 1 for r in out) == 2
    order = sorted((r for r in out if r["conv_id"] == 1 and r["kind"] != "message"), key=lambda r: (r["order_turn"], r["depth"], r["turn"], r["part"]))
    assert [r["call_id"] for r in order[:4]] == ["a", "b", "a", "b"]
    assert all(json.dumps(json.loads(r["json"]), sort_keys=True, ensure_ascii=False, separators=(",", ":")) == r["json"] for r in out)
    assert chat.link(chat.parse(turns(spark, rows).where("false")), SCHEMAS).count() == 0


def test_chat_chain(spark):
    """A chain of 200 calls in a shuffled table: depths come from doubling."""
    rows = [(7, i, "assistant", call((f"n{i}", "add", {"x": i}, f"n{i - 1}" if i else None))) for i in range(200)]
    random.Random(2).shuffle(rows)
    out = chat.link(chat.parse(turns(spark, rows)), SCHEMAS).collect()
    assert all(r["depth"] == 2 * r["turn"] and r["turn"] == r["order_turn"] for r in out)


def brute_chats(raw):
    """(conv_id, turn, part): kind, call_id, linked, order_turn, depth, valid, json."""
    nodes, calls, answers = {}, {}, defaultdict(int)
    for r in raw:
        c, t, text = r["conv_id"], r["turn"], r["text"] or ""
        n = len(text)
        if r["role"] == "user":
            limit = str(n % 7) if n % 5 == 0 else n % 7
            found = [(f"{t}.0", "search", {"query": text, "limit": limit}, f"{t - 2}.0" if t >= 2 else None)]
            if n > 200:
                found.append((f"{t}.0" if n % 11 == 0 else f"{t}.1", "look", {"how": ("exact", "near", "loose")[n % 3]}, f"{t}.0"))
            for part, (k, name, given, after) in enumerate(found):
                valid = n % 5 != 0 if name == "search" else n % 3 != 2
                body = {"arguments": given, "id": k, "name": name, "role": "assistant"} | ({"after": after} if after else {})
                nodes[c, t, part] = ["call", k, valid, body]
                calls.setdefault((c, k), (t, part, after))
        elif r["role"] == "assistant":
            k = f"{t - 1}.1" if n % 3 == 0 else f"{t - 1}.0"
            nodes[c, t, 0] = ["result", k, True, {"content": text, "role": "tool", "tool_call_id": k}]
            answers[c, k] += 1
        else:
            nodes[c, t, 0] = ["message", None, True, {"content": r["text"], "role": r["role"]}]

    def waits(c, k):
        chain, reach = [], 0
        while (c, k) in calls:
            t, _, after = calls[c, k]
            chain.append(k)
            reach = max(reach, t)
            k = after
        return 2 * (len(chain) - 1), reach

    out = {}
    for (c, t, part), (kind, k, valid, body) in nodes.items():
        first = calls.get((c, k))
        named = first is not None and (kind == "result" or first[:2] == (t, part))
        depth, reach = waits(c, k) if named else (0, t)
        linked = named and (kind == "result" or answers[c, k] > 0)
        out[c, t, part] = (kind, k, linked, max(t, reach), depth + (kind == "result" and named), valid, json.dumps(body, sort_keys=True, ensure_ascii=False, separators=(",", ":")))
    return out


def test_chats_of_the_tables(spark):
    out = queries.op5_chat_tool_calls(spark, DATA).collect()
    raw = sorted(spark.read.parquet(f"{DATA}/conversations.parquet").collect(), key=lambda r: (r["conv_id"], r["turn"]))
    want = brute_chats(raw)
    got = {(r["conv_id"], r["turn"], r["part"]): (r["kind"], r["call_id"], r["linked"], r["order_turn"], r["depth"], r["valid"], r["json"]) for r in out}
    assert got == want and len(out) == len(want) > len(raw)
    kinds = [(x[0], x[2], x[5]) for x in want.values()]
    assert {("call", True, True), ("call", False, True), ("call", True, False), ("result", True, True)} <= set(kinds) and max(x[4] for x in want.values()) > 4
    bare = spark.createDataFrame([(1, 0, 0, "call", "a", "search", None, None), (1, 1, 0, "result", "a", None, None, None)], chat.NODE)
    assert [r["json"] for r in chat.link(bare, chat.TOOLS).orderBy("turn").collect()] == ['{"arguments":null,"id":"a","name":"search","role":"assistant"}', '{"content":null,"role":"tool","tool_call_id":"a"}']
    odd = spark.createDataFrame([(None, None, "user", None), (1, None, "assistant", "x"), (1, 0, None, None)], "conv_id long, turn long, role string, text string")
    assert len(chat.link(chat.parse(chat.as_tool_chats(odd)), chat.TOOLS).collect()) == 3


def test_alignment():
    import numpy as np

    def score(a, b):
        best, rows = 0, [[0] * (len(b) + 1)]
        for x in a:
            row = [0]
            for j, y in enumerate(b, 1):
                row.append(max(0, rows[-1][j - 1] + (2 if x == y else -1), rows[-1][j] - 1, row[j - 1] - 1))
            best = max(best, *row)
            rows.append(row)
        return best

    r = random.Random(9)
    for _ in range(40):
        a = [r.randint(1, 6) for _ in range(r.randint(1, 15))]
        windows = [[r.randint(0, 6) for _ in range(25)] for _ in range(3)]
        got, _ = decontam.align(np.array(a, np.uint64), np.array(windows, np.uint64))
        assert got.tolist() == [score(a, [10 if y == 0 else y for y in w]) for w in windows]


def test_leaks(spark, monkeypatch):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghijklm") for _ in range(r.randint(3, 9)))
    items = [(i, " ".join(word() for _ in range(r.randint(12, 40)))) for i in range(12)] + [(100, None), (101, ""), (102, "Ok.")]
    filler = lambda n: " ".join(word() for _ in range(n))

    def edited(text):
        words = text.split()
        for k in range(0, len(words), 9):
            words[k] = word()
        return " ".join(words)

    rows, want = [], set()
    for i, text in items[:12]:
        rows += [(10 * i, f"{filler(50)} {text.upper()}! {filler(30)}", "en", "s", 0), (10 * i + 1, f"{filler(9)} {edited(text)} {filler(9)}", "en", "s", 0), (10 * i + 2, filler(60), "en", "s", 0)]
        want |= {(10 * i, i), (10 * i + 1, i)}
    docs = documents(spark, rows + ODD)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]) for x in decontam.contaminated(docs, bench).collect()}
    assert {x for x in got if x[1] < 100} == want
    monkeypatch.setattr(decontam, "BITS", 8)  # a table that knows nearly everything
    assert {(x["doc_id"], x["item_id"]) for x in decontam.contaminated(docs, bench).collect() if x["item_id"] < 100} == want
    assert decontam.contaminated(docs.where("false"), bench).count() == 0
    assert decontam.contaminated(docs, bench.where("false")).count() == 0


def test_plain_text_is_not_aligned(spark):
    """Frequent and rare words as in prose, and no leak: stretches to align are few beside
    the words, and do not grow faster than these."""
    import numpy as np

    rng = np.random.default_rng(5)
    share = 1 / np.arange(1, 20_001)
    draw = lambda n: " ".join(f"w{k}" for k in rng.choice(20_000, n, p=share / share.sum()))
    bench = spark.createDataFrame([(k, draw(20)) for k in range(2_000)], "item_id long, text string")
    from quillbar.llm.common import stored

    rates = []
    for words in (20_000, 80_000):
        docs = spark.createDataFrame([(k, draw(words // 10)) for k in range(10)], "doc_id long, text string")
        source = docs.select("doc_id", F.xxhash64("text").alias("id"), "text")
        items = stored(bench.select(F.xxhash64("text").alias("item"), "text").mapInArrow(decontam._words, "item long, words array<long>"))
        rates.append(decontam.meetings(source, decontam.seeds(items, source, 0.5), False).count() / words)
    assert max(rates) < 0.01, rates


def test_leaks_among_odd_rows(spark):
    """Null ids, repeated rows, items of equal text, ties of score: every row is told."""
    said = "alpha beta gamma delta epsilon zeta eta theta"
    docs = documents(spark, [(1, f"x {said} y {said}", "en", "a", 0), (1, f"x {said} y {said}", "en", "a", 0), (None, said.upper(), "en", "a", 0), (2, None, "en", "a", 0), (3, "alpha beta", "en", "a", 0)])
    bench = spark.createDataFrame([(7, said), (8, said), (None, said), (9, None), (10, " . ")], "item_id long, text string")
    got = sorted(map(tuple, decontam.contaminated(docs, bench).collect()), key=repr)
    want = [(d, i, 1.0, e) for d, e in ((1, 9), (1, 9), (None, 8)) for i in (7, 8, None)]
    assert got == sorted(want, key=repr)


def test_leaks_edited_throughout(spark):
    """All pairs that Smith-Waterman over the whole text finds, in a corpus of few words."""
    import numpy as np

    r = random.Random(21)
    vocabulary = ["".join(r.choice("abcdefghijklm") for _ in range(5)) for _ in range(150)]
    filler = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [filler(r.randint(12, 45)) for _ in range(10)] + [filler(k) for k in (2, 3, 5)]
    changed = lambda item, step: [f"x{r.random()}"[:9].replace(".", "") if k % step == step - 1 else w for k, w in enumerate(item)]
    texts = [filler(300) for _ in range(30)]
    for item in items:
        for copy in (changed(item, 3), changed(item, 4), [y for w in item for y in (w, "zz")], item[: len(item) // 2 + 1], item[::2]):
            texts.append(filler(70) + copy + filler(r.randint(0, 70)))
    docs = documents(spark, [(i, " ".join(t), "en", "s", 0) for i, t in enumerate(texts)])
    bench = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]): x["score"] for x in decontam.contaminated(docs, bench).collect()}
    number = defaultdict(lambda: len(number) + 1)
    grid = np.zeros((len(texts), max(map(len, texts))), np.uint64)
    for i, t in enumerate(texts):
        grid[i, : len(t)] = [number[w] for w in t]
    want = {}
    for k, item in enumerate(items):
        score, _ = decontam.align(np.array([number[w] for w in item], np.uint64), grid)
        want |= {(i, k): round(float(s), 6) for i, s in enumerate(score / (2 * len(item))) if s >= 0.5}
    assert got == want and all((30 + 5 * k + e, k) in want for k in range(10) for e in range(3))


def test_pipeline(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["quality", "near_dedup", "decontaminate", "mix", "shard"]
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns
        path = f"{spark.conf.get('spark.checkpoint.dir')}/test/{name}"
        out.write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
    last = P.STAGES[-1][1](spark, docs, DATA)
    assert last.count() == docs.count() > 0
    assert P.run(spark, DATA).count() == docs.count()


def test_pipeline_stages_on_odd_rows(spark):
    import corpus_pipeline as P

    for odd in (odd_documents(spark), odd_documents(spark).where("false")):
        for _, stage in P.STAGES:
            stage(spark, odd, DATA).collect()
    kept = P.near_dedup(spark, odd_documents(spark), DATA).collect()
    ids = [r["doc_id"] for r in kept]
    # of the wordless rows the smallest id stays; a text said twice is a near copy (22 of
    # its 26 shingles), the other text under its id is not
    assert sorted(x for x in ids if x is not None) == [9001, 9004, 9005, 9006, 9007, 9009, 9010, 9011] and None not in ids
    assert [r["text"] for r in kept if r["doc_id"] == 9006] == ["another text under the same id"]


def test_pipeline_loses_no_different_texts(spark):
    import corpus_pipeline as P

    r = random.Random(12)
    text = lambda: " ".join("".join(r.choice("abcdefghijklm") for _ in range(6)) for _ in range(60))
    texts = [text() for _ in range(20)]
    for ids in ([None] * 20, [7] * 20, [None, 7] * 10):
        docs = documents(spark, [(i, t, "en", "s", 0) for i, t in zip(ids, texts, strict=True)])
        for name, stage in P.STAGES[:3]:
            assert sorted(x["text"] for x in stage(spark, docs, DATA).collect()) == sorted(texts), name
        mixed = P.mix(spark, docs, DATA).collect()
        assert {x["text"] for x in mixed} == set(texts) and len(P.shard(spark, docs, DATA).collect()) == 20


def test_stages_remove_by_id_and_text(spark):
    """Null and repeated doc_ids: only copies and leaks go, whatever shares their id."""
    import corpus_pipeline as P

    r = random.Random(11)
    text = lambda: " ".join("".join(r.choice("abcdefghijklm") for _ in range(6)) for _ in range(40))
    a, b, c, d, e, leak = (text() for _ in range(6))
    rows = [(1, a), (None, a), (None, b), (None, c), (2, d), (2, e), (3, d), (4, e), (4, e)]
    docs = documents(spark, [(i, t, "en", f"s{k}", 0) for k, (i, t) in enumerate(rows)])
    kept = sorted(((x["doc_id"] or 0, x["text"], x["source"]) for x in P.near_dedup(spark, docs, DATA).collect()), key=str)
    assert kept == sorted([(1, a, "s0"), (0, b, "s2"), (0, c, "s3"), (2, d, "s4"), (2, e, "s5")], key=str)
    again = documents(spark, [(7, a, "en", "y", 0), (7, a, "en", "x", 0), (None, b, "en", "z", 0), (None, b, "en", "w", 0)])
    assert {(x["doc_id"], x["source"]) for x in P.near_dedup(spark, again, DATA).collect()} == {(7, "x"), (None, "w")}
    bench = spark.createDataFrame([(1, leak)], "item_id long, text string")
    folder = f"{spark.conf.get('spark.checkpoint.dir')}/leaks"
    bench.write.mode("overwrite").parquet(f"{folder}/benchmark.parquet")
    rows = [(None, a), (None, f"{b} {leak}"), (5, c), (5, f"{d} {leak}")]
    left = P.decontaminate(spark, documents(spark, [(i, t, "en", "s", 0) for i, t in rows]), folder).collect()
    assert {(x["doc_id"], x["text"]) for x in left} == {(None, a), (5, c)}


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert "pipeline" in names and set(queries.QUERIES) <= names
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 11)]


def test_messages_that_json_makes_hard(spark):
    """Lone surrogates, numbers JSON has not, deep nesting, empty call lists, content
    beside calls, arguments as text: no crash, and nothing lost."""
    deep = '{"tool_calls":[{"id":"d","name":"search","arguments":' + '{"a":' * 200_000 + "1" + "}" * 200_000 + "}]}"
    deeper = '{"tool_call_id":"d","content":' + "[" * 900 + "]" * 900 + "}"
    said = [
        ("assistant", r'{"tool_calls":[{"id":"a","name":"search","arguments":{"query":"\ud800","limit":1}}]}'),
        ("tool", r'{"tool_call_id":"a","content":"\udfff and \ud83d\ude00"}'),
        ("assistant", '{"content":"hello","tool_calls":[]}'),
        ("assistant", '{"content":"I look it up","tool_calls":[{"id":"b","name":"search","arguments":{"query":"q","limit":NaN}}]}'),
        ("tool", '{"tool_call_id":"b","content":[1e999,-Infinity,1]}'),
        ("assistant", '{"tool_calls":[{"id":"c","name":"search","arguments":"{\\"query\\":\\"q\\",\\"limit\\":2}"},{"id":"e","name":"search","arguments":"no"},7]}'),
        ("assistant", deep),
        ("tool", deeper),
        ("assistant", '{"tool_calls":[]}'),
        ("tool", '{"tool_call_id":null,"content":"x"}'),
        ("assistant", r'{"tool_calls":[{"id":"\ud800","name":"look","arguments":{"how":"near"}}]}'),
    ]
    table = spark.createDataFrame([(1, t, role, text) for t, (role, text) in enumerate(said)], "conv_id long, turn long, role string, text string")
    rows = {(r["turn"], r["part"]): r for r in chat.link(chat.parse(table), chat.TOOLS).collect()}
    assert {t for t, _ in rows} == set(range(len(said)))
    text = lambda t, p=0: rows[t, p]["json"]
    assert text(0) == r'{"arguments":{"limit":1,"query":"\ud800"},"id":"a","name":"search","role":"assistant"}' and rows[0, 0]["valid"] and rows[0, 0]["linked"]
    assert text(1) == '{"content":"\\udfff and \U0001f600","role":"tool","tool_call_id":"a"}'
    assert json.loads(text(1))["content"] == "\udfff and \U0001f600"
    assert (rows[2, 0]["kind"], text(2)) == ("message", '{"content":"hello","role":"assistant"}')
    assert (rows[3, 0]["kind"], text(3)) == ("message", '{"content":"I look it up","role":"assistant"}')
    assert rows[3, 1]["linked"] and not rows[3, 1]["valid"] and json.loads(text(3, 1))["arguments"] == {"limit": None, "query": "q"}
    assert text(4) == '{"content":[null,null,1],"role":"tool","tool_call_id":"b"}' and rows[4, 0]["errors"] == "not a finite number"
    assert rows[5, 0]["valid"] and json.loads(text(5))["arguments"] == {"limit": 2, "query": "q"}
    assert not rows[5, 1]["valid"] and not rows[5, 2]["valid"] and json.loads(text(5, 2))["arguments"] == 7
    assert rows[6, 0]["kind"] == "message" and json.loads(text(6))["content"] == deep
    assert text(7) is not None or rows[7, 0]["errors"] == "nested too deeply"
    assert text(8) == '{"content":null,"role":"assistant"}'
    assert rows[9, 0]["call_id"] is None and not rows[9, 0]["linked"]
    assert rows[10, 0]["call_id"] == r"\ud800" and rows[10, 0]["valid"]
