"""Quality rules and the language-model classifier against plain Python."""

from __future__ import annotations

import math
import re
import struct
from collections import Counter

import numpy as np
import pytest
import xxhash

from quillbar.llm import kneser_ney, quality_rules
from tests.helpers import DATA
from tests.llm.rows import ODD, documents, odd_documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    words = WORD.findall(text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    covered = {j for i, w in enumerate(windows) if times[w] > 1 for j in range(i, i + 3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_base_counts(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").unionByName(odd_documents(spark).select("doc_id", "text", "lang", "source", "n_chars"))
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.where("doc_id < 9000").collect()}
    for r in quality_rules.quality_rules(docs, labels).where("doc_id < 9000").collect():
        want = base(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["base_failed"] and r["kept"])


def hashed(raw, seed=42):
    return xxhash.xxh64_intdigest(raw, seed)


def test_ratios_and_verdicts(spark):
    """llr, threshold and kept of all documents, in plain Python."""
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    marked = {r["doc_id"]: r for r in labels.collect()}
    fit = {d: hashed(struct.pack("<q", d), hashed(struct.pack("<i", 43))) % quality_rules.HOLD != 0 for d, r in marked.items() if r["quality"] == 1 and not r["toxic"]}
    features = {}
    for r in docs.collect():
        w = [hashed(x.encode()) for x in WORD.findall(r["text"] or "")]
        pairs = [hashed(struct.pack("<Q", b), hashed(struct.pack("<Q", a))) for a, b in zip(w, w[1:], strict=False)]
        features[r["doc_id"]] = [h >> 48 for h in w + pairs]
    raw, target = Counter(), Counter()
    for d, f in features.items():
        raw.update(f)
        target.update(f if fit.get(d) else [])
    ends = [sum(x.values()) + (1 << 16) for x in (target, raw)]
    ratio = {b: float(np.float32(math.log((target[b] + 1) / ends[0]) - math.log((n + 1) / ends[1]))) for b, n in raw.items()}
    llr = {d: round(sum(ratio[b] for b in f) / len(f), 9) for d, f in features.items() if f}
    low, mid = np.percentile([x for d, x in llr.items() if fit.get(d) is False], [0.5, 50])
    floor = low - (mid - low) / 2
    rows = quality_rules.quality_rules(docs, labels).collect()
    assert len(rows) == len(features) and any(fit.values()) and not all(fit.values())
    for r in rows:
        assert r["llr"] == pytest.approx(llr.get(r["doc_id"]), abs=2e-8)
        assert r["kept"] == (not r["base_failed"] and llr[r["doc_id"]] >= floor)
    assert 0 < sum(r["kept"] for r in rows) < len(rows)


def test_rules_follow_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_rules.quality_rules(docs, labels).join(labels, "doc_id").where("not base_failed").collect()
    good, bad = [r["kept"] for r in rows if r["quality"] == 1], [r["kept"] for r in rows if r["quality"] == 0]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_rules_edges(spark):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    rows = quality_rules.quality_rules(odd_documents(spark), labels).collect()
    assert len(rows) == len(ODD)
    none = [r for r in rows if r["n_words"] == 0]
    assert none and all(r["base_failed"] and not r["kept"] and r["word_chars"] == 0 for r in none)
    assert quality_rules.quality_rules(odd_documents(spark).where("false"), labels).count() == 0
    assert quality_rules.quality_rules(odd_documents(spark), labels.where("false")).count() == len(ODD)


def model(texts, order):
    """Interpolated modified Kneser-Ney over bytes, written out plainly."""
    grams = Counter()
    for t in texts:
        raw = bytes(order - 1) + t
        for i in range(len(t)):
            grams[raw[i : i + order]] += 1
    tables = {order: grams}
    for k in range(order - 1, 0, -1):
        tables[k] = Counter(g[1:] for g in tables[k + 1])
    cuts, contexts = {}, {}
    for k, table in tables.items():
        n1, n2, n3, n4 = (sum(c == j for c in table.values()) for j in (1, 2, 3, 4))
        if n1 and n2:
            y = n1 / (n1 + 2 * n2)
            d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5)
            d = tuple(min(max(x, 0.05), j + 0.95) for j, x in enumerate(d))
        else:
            d = (0.5, 0.75, 0.9)
        cuts[k] = d
        total, saved = Counter(), Counter()
        for g, c in table.items():
            total[g[:-1]] += c
            saved[g[:-1]] += d[min(c, 3) - 1]
        contexts[k] = (total, saved)

    def p(gram):
        if not gram:
            return 1 / 256
        k, low = len(gram), p(gram[1:])
        total, saved = contexts[k]
        if not total[gram[:-1]]:
            return low
        c = tables[k][gram]
        return (max(0.0, c - cuts[k][min(c, 3) - 1]) / total[gram[:-1]] if c else 0.0) + saved[gram[:-1]] / total[gram[:-1]] * low

    return p


def test_perplexity_is_kneser_ney(spark):
    order = 3
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(["abab abac", "abra cadabra", "the end of the end", "ünicode", "", "zzzz", "abab"] * 4)]
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 28, 2)], "doc_id long, quality int, toxic int")
    held = {r["doc_id"] for r in labels.where(kneser_ney.held_out()).collect()}
    p = model([t.encode() for i, t, *_ in rows if i % 2 == 0 and i not in held], order)
    for r in kneser_ney.perplexities(docs, labels, order).collect():
        raw = bytes(order - 1) + rows[r["doc_id"]][1].encode()
        want = -sum(math.log(p(raw[i : i + order])) for i in range(len(raw) - order + 1))
        assert abs(r["nats"] - want) < 1e-4 * max(1, want)


def test_classifier_in_shards(spark, monkeypatch):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    whole = {r["doc_id"]: round(r["nats"], 6) for r in kneser_ney.perplexities(docs, labels).collect()}
    monkeypatch.setattr(kneser_ney, "SHARD", 20_000)
    parts = {r["doc_id"]: round(r["nats"], 6) for r in kneser_ney.perplexities(docs, labels).collect()}
    assert whole == pytest.approx(parts, abs=1e-4)


def test_verdicts_are_quantiles(spark):
    """Scores, bounds and verdicts from the documents' nats, in plain Python."""
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    tail, prior = 0.1, 50
    nats = {r["doc_id"]: (r["nats"], r["bytes"]) for r in kneser_ney.perplexities(docs, labels).collect()}
    lang = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    marked = labels.select("doc_id", "quality", "toxic", kneser_ney.held_out().alias("held")).collect()
    good = {r["doc_id"]: r["held"] for r in marked if r["quality"] == 1 and not r["toxic"]}

    def mean(ids):
        return sum(nats[d][0] for d in ids) / sum(nats[d][1] for d in ids)

    mu = {x: mean([d for d in good if lang[d] == x]) for x in {lang[d] for d in good}}
    every = mean(good)
    score = {d: (n + prior * mu.get(lang[d], every)) / (b + prior) for d, (n, b) in nats.items()}

    def bound(held, q, langs):
        steps = [math.floor(score[d] / kneser_ney.STEP) for d, h in good.items() if h == held and lang[d] in langs]
        return (np.percentile(steps, 100 * q) + held) * kneser_ney.STEP if steps else None

    rows = kneser_ney.quality_classifier(docs, labels, prior=prior, tail=tail).collect()
    assert len(rows) == len(lang)
    for r in rows:
        d, langs = r["doc_id"], {lang[r["doc_id"]]}
        low, high = (bound(h, q, langs) or bound(h, q, set(mu)) for h, q in ((False, tail), (True, 1 - tail)))
        assert (r["score"], r["low"], r["high"]) == pytest.approx((score[d], low, high), abs=1e-9)
        assert r["kept"] == (low <= score[d] <= high)
    assert 0 < sum(not r["kept"] for r in rows) < len(rows) / 2


def test_classifier_follows_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = kneser_ney.quality_classifier(docs, labels).join(labels, "doc_id").collect()
    good, bad = [r["kept"] for r in rows if r["quality"] == 1 and not r["toxic"]], [r["kept"] for r in rows if r["quality"] == 0]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_classifier_edges(spark):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    rows = kneser_ney.quality_classifier(odd_documents(spark), labels).collect()
    assert len(rows) == len(ODD)
    assert all(r["kept"] for r in kneser_ney.quality_classifier(odd_documents(spark), labels.where("false")).collect())
    assert kneser_ney.quality_classifier(odd_documents(spark).where("false"), labels).count() == 0




def test_stages_hand_small_batches(spark):
    """Long texts reach Python workers a few megabytes at a time, not 64."""
    import corpus_pipeline
    from quillbar.llm.common import BATCH_BYTES

    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    docs = spark.createDataFrame([(1, "a b c", "en")], "doc_id long, text string, lang string")
    corpus_pipeline.quality(spark, docs, "/root/testdata/sf0.001")
    long = spark.range(400, numPartitions=1).selectExpr("repeat('x', 50000) as text")
    sizes = [r[0] for r in long.mapInArrow(lambda batches: (b.select([]).from_pydict({"n": [b.nbytes]}) for b in batches), "n long").collect()]
    assert len(sizes) > 5 and max(sizes) <= 2 * BATCH_BYTES


def test_stages_scan_few_rows_at_a_time(spark, tmp_path):
    """Long texts are decoded and stored a few hundred KB at a time, in every stage."""
    import inspect

    import corpus_pipeline
    from quillbar.llm.common import SCAN_ROWS

    names = ("spark.sql.parquet.columnarReaderBatchSize", "parquet.read.allocation.size", "parquet.page.size", "spark.sql.codegen.aggregate.map.twolevel.enabled")
    for name in names:
        spark.conf.unset(name)
    docs = spark.createDataFrame([(1, "a b c", "en", "web")], "doc_id long, text string, lang string, source string")
    corpus_pipeline.shard(spark, docs, "/root/testdata/sf0.001")
    long = spark.range(1000, numPartitions=1).selectExpr("id", "repeat(uuid(), 100) as text")
    long.write.parquet(f"{tmp_path}/long")
    read = spark.read.parquet(f"{tmp_path}/long")
    assert len(read.collect()) == 1000
    node = read._jdf.queryExecution().executedPlan()
    while node.nodeName() != "ColumnarToRow":
        node = node.children().apply(0)
    assert node.metrics().apply("numInputBatches").value() >= 1000 // SCAN_ROWS
    assert all("small_scans(spark)" in inspect.getsource(stage) for _, stage in corpus_pipeline.STAGES)


def test_small_sides_of_shuffled_joins_stay_off_the_driver(spark):
    """Sides that turn out small after their shuffle are not gathered on the driver."""
    import corpus_pipeline

    key = "spark.sql.adaptive.autoBroadcastJoinThreshold"
    spark.conf.unset(key)
    docs = spark.createDataFrame([(1, "a b c", "en", "s")], "doc_id long, text string, lang string, source string")
    for _, stage in corpus_pipeline.STAGES:
        spark.conf.unset(key)
        stage(spark, docs, "/root/testdata/sf0.001")
        few, again = (spark.range(10_000_000).where("id % 2000000 = 0").toDF(name) for name in ("a", "b"))
        both = few.join(again, few["a"] == again["b"])
        assert len(both.collect()) == 5
        assert "BroadcastHashJoin" not in both._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset(key)


def test_shuffle_files_go_with_their_query(spark):
    import glob
    import time

    import corpus_pipeline

    docs = spark.createDataFrame([(1, "a b c", "en", "s")], "doc_id long, text string, lang string, source string")
    corpus_pipeline.shard(spark, docs, "")
    held = lambda: set(glob.glob(f"{spark.conf.get('spark.local.dir')}/**/shuffle_*.data", recursive=True))
    before = held()
    assert spark.range(1000).groupBy("id").count().checkpoint().count() == 1000
    until = time.time() + 20
    while held() - before and time.time() < until:
        time.sleep(0.2)
    assert not held() - before
