"""Quality classifier: interpolated modified Kneser-Ney over byte n-grams.

The model is counted on all trusted documents (quality 1, not toxic) but every
``HOLD``-th by hash, which are held out to set thresholds. N-grams are ``order`` bytes (at most 7) packed into a long, so a count
table is a table of longs and a lower order is a mask. The corpus's own distinct
n-grams are gathered too, and sharded joins against the count tables, one order
after the other, give each its log probability. Those are handed to the scoring
pass in shards of at most ``SHARD`` n-grams, one pass over the text per shard, so
memory is bounded whatever the model's size; sums of shards add up exactly.

A document's score is nats per byte, drawn towards its language's mean as if it
had ``prior`` bytes more (short texts say little). It is kept while the score lies
between two quantiles of its language's trusted documents: ``1 - tail`` of those held
out and ``tail`` of those trained on (a document the model has seen scores lower than
one it has not; neither kind may fall outside). Quantiles are of scores in steps of
0.001, counted before they are shuffled, so they are exact to that and reruns agree.

Null or empty text: no bytes, score is the language's mean, kept. Null language: a
language of its own. A language without trusted documents: the bounds of all
trusted documents together. No trusted documents at all: every document is kept.
Repeated rows and null doc_ids each have a row of the result; equal texts of a
language score alike. A null doc_id is never trusted. Long texts are read whole.
Other columns are left out. Empty table: empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, maybe_broadcast, stored, trusted_ids
from .repeats import groups, texts

#: N-grams in a shard: at most 12 bytes each in the driver and in a Python worker.
SHARD = 2_000_000
#: Texts are counted and scored in pieces of about so many bytes: some ten longs a byte.
PIECE = 1 << 18
STEP = 0.001
#: One in so many trusted documents is held out.
HOLD = 4


def held_out() -> Column:
    return F.pmod(F.xxhash64(F.lit(41), "doc_id"), F.lit(HOLD)) == 0


def packed(raw: np.ndarray, offsets: np.ndarray, order: int) -> np.ndarray:
    """The n-gram that ends at each byte; before a text's start stand zeros."""
    n = len(raw)
    index = np.arange(n) - np.repeat(offsets[:-1], np.diff(offsets))
    out = raw.astype(np.int64)
    for k in range(1, order):
        earlier = np.zeros(n, dtype=np.int64)
        earlier[k:] = raw[: n - k]
        earlier[index < k] = 0
        out |= earlier << (8 * k)
    return out


def _count(order: int, distinct: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def fold() -> tuple[np.ndarray, np.ndarray]:
            g = np.concatenate([grams, *[x for x, _ in held]])
            c = np.concatenate([times, *[x for _, x in held]])
            held.clear()
            one, where = np.unique(g, return_inverse=True)
            return one, np.bincount(where, weights=c, minlength=len(one)).astype(np.int64)

        def rows() -> Iterator[pa.RecordBatch]:
            for lo in range(0, len(grams), 1 << 17):
                part = [pa.array(grams[lo : lo + (1 << 17)])] + ([] if distinct else [pa.array(times[lo : lo + (1 << 17)])])
                yield pa.RecordBatch.from_arrays(part, names=["g"] if distinct else ["g", "c"])

        for batch in batches:
            raw, offsets = texts(batch.column("text"))
            for i, j in groups(offsets, PIECE):
                held.append(np.unique(packed(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], order), return_counts=True))
                if len(held) == 32:
                    grams, times = fold()
                if len(grams) > SHARD:  # bounded memory: hand on what is there
                    yield from rows()
                    grams, times = grams[:0], times[:0]
        grams, times = fold()
        yield from rows()

    return run


def discounts(table: DataFrame) -> tuple[float, float, float]:
    n1, n2, n3, n4 = (x or 0 for x in table.agg(*[F.count_if(F.col("c") == k) for k in (1, 2, 3, 4)]).first())
    if not (n1 and n2):
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return tuple(min(max(x, 0.05), k + 0.95) for k, x in enumerate(d))  # type: ignore[return-value]


def log_probabilities(counts: DataFrame, wanted: DataFrame, order: int) -> DataFrame:
    """(g, logp) for every n-gram g of ``wanted`` under the model of ``counts``."""
    mask = lambda k: F.lit((1 << (8 * k)) - 1)
    tables = {order: counts}
    for k in range(order - 1, 0, -1):  # lower orders count the n-grams one longer that end in them
        tables[k] = cut(tables[k + 1].groupBy(F.col("g").bitwiseAND(mask(k)).alias("g")).agg(F.count("*").alias("c")))
    asked = {order: wanted}
    for k in range(order - 1, 0, -1):
        asked[k] = asked[k + 1].select(F.col("g").bitwiseAND(mask(k)).alias("g")).distinct()
    below: DataFrame | None = None
    for k in range(1, order + 1):
        d = discounts(tables[k])
        off = lambda c, d=d: F.when(c == 1, d[0]).when(c == 2, d[1]).otherwise(d[2])
        context = tables[k].groupBy(F.shiftright("g", 8).alias("x")).agg(F.sum("c").alias("all"), F.sum(off(F.col("c"))).alias("saved"))
        rows = asked[k].join(tables[k], "g", "left").withColumn("x", F.shiftright("g", 8)).join(context, "x", "left")
        if below is None:
            lower: Column = F.lit(1 / 256)
        else:
            rows = rows.withColumn("s", F.col("g").bitwiseAND(mask(k - 1))).join(below.withColumnRenamed("g", "s"), "s")
            lower = F.col("p")
        own = F.when(F.col("c").isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.col("c") - off(F.col("c"))) / F.col("all"))
        below = cut(rows.select("g", F.when(F.col("all").isNull(), lower).otherwise(own + F.col("saved") / F.col("all") * lower).alias("p")))
    return below.select("g", F.log("p").cast("float").alias("logp"))


def _score(order: int, shard):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, logs = shard.value
        for batch in batches:
            raw, offsets = texts(batch.column("text"))
            nats = np.zeros(batch.num_rows)
            for i, j in groups(offsets, PIECE):
                at = offsets[i : j + 1] - offsets[i]
                g = packed(raw[offsets[i] : offsets[j]], at, order)
                if not len(g):
                    continue
                one, back = np.unique(g, return_inverse=True)
                k = np.minimum(np.searchsorted(keys, one), len(keys) - 1)
                value = np.where(keys[k] == one, -logs[k].astype(np.float64), 0.0)[back]
                nats[i:j] = np.bincount(np.repeat(np.arange(j - i), np.diff(at)), weights=value, minlength=j - i)
            columns = [batch.column(c) for c in ("doc_id", "id")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(nats), pa.array(np.diff(offsets).astype(np.int64))], names=["doc_id", "id", "nats", "bytes"])

    return run


def perplexities(documents: DataFrame, labels: DataFrame, order: int = 5) -> DataFrame:
    """Distinct (doc_id, id) with nats and bytes; id is the text's hash."""
    spark = documents.sparkSession
    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("id"), "text")
    trusted = source.join(maybe_broadcast(cut(trusted_ids(labels).where(~held_out()))), "doc_id", "left_semi")
    counts = cut(trusted.mapInArrow(_count(order, False), "g long, c long").groupBy("g").agg(F.sum("c").alias("c")))
    wanted = cut(source.mapInArrow(_count(order, True), "g long").distinct())
    known = stored(log_probabilities(counts, wanted, order))
    shards = max(1, -(-known.count() // SHARD))
    parts = []
    for k in range(shards):
        rows = known.where(F.pmod(F.xxhash64("g"), F.lit(shards)) == k).toArrow()
        if not rows.num_rows:
            continue
        g, logp = (rows.column(c).to_numpy() for c in ("g", "logp"))
        by = np.argsort(g)
        shard = spark.sparkContext.broadcast((g[by], logp[by]))
        parts.append(cut(source.mapInArrow(_score(order, shard), "doc_id long, id long, nats double, bytes long")))
        shard.unpersist()
    if not parts:
        return source.select("doc_id", "id", F.lit(0.0).alias("nats"), F.lit(0).cast("long").alias("bytes")).distinct()
    if len(parts) == 1:
        return parts[0].dropDuplicates(["doc_id", "id"])
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    # rows that repeat a document repeat its sums as often in every part
    return whole.groupBy("doc_id", "id").agg((F.sum("nats") * len(parts) / F.count("*")).alias("nats"), F.first("bytes").alias("bytes"))


def bounds(scores: DataFrame, by: list[str], tail: float) -> DataFrame:
    """low and high per group: the quantiles ``tail`` and ``1 - tail``."""
    step = F.floor(F.col("score") / STEP)
    at = lambda q: F.percentile(step, F.lit(q))
    return scores.groupBy(*by).agg((at(tail) * STEP).alias("low"), ((at(1 - tail) + 1) * STEP).alias("high"))


def quality_classifier(documents: DataFrame, labels: DataFrame, order: int = 5, prior: int = 100, tail: float = 0.005) -> DataFrame:
    """One row per document: doc_id, id, lang, n_bytes, score (nats per byte,
    shrunk), perplexity (per byte), low, high, kept."""
    keys = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("id"), "lang")
    found = perplexities(documents, labels, order).select(F.col("doc_id").alias("_d"), F.col("id").alias("_i"), "nats", "bytes")
    rows = cut(keys.join(found, (F.col("id") == F.col("_i")) & F.col("doc_id").eqNullSafe(F.col("_d"))).drop("_d", "_i"))
    trusted = cut(rows.join(maybe_broadcast(cut(trusted_ids(labels))), "doc_id", "left_semi"))
    mean = trusted.groupBy("lang").agg((F.sum("nats") / F.sum("bytes")).alias("mean")).withColumnRenamed("lang", "_l")
    overall = trusted.agg(F.sum("nats") / F.sum("bytes")).first()[0] or 0.0

    def scored(df: DataFrame) -> DataFrame:
        df = df.join(maybe_broadcast(mean), F.col("lang").eqNullSafe(F.col("_l")), "left").drop("_l")
        mu = F.coalesce("mean", F.lit(overall))
        return df.withColumn("score", (F.col("nats") + prior * mu) / (F.col("bytes") + prior)).drop("mean")

    known = cut(scored(trusted))
    seen, unseen = known.where(~held_out()), known.where(held_out())
    low, high = bounds(seen, [], tail).first()["low"], bounds(unseen, [], tail).first()["high"]
    low = float("-inf") if low is None else low  # no trusted documents
    high = float("inf") if high is None else high
    per = bounds(seen, ["lang"], tail).select(F.col("lang").alias("_l"), "low")
    per = per.join(bounds(unseen, ["lang"], tail).select(F.col("lang").alias("_m"), "high"), F.col("_l").eqNullSafe(F.col("_m")), "left").drop("_m")
    out = scored(rows).join(maybe_broadcast(cut(per)), F.col("lang").eqNullSafe(F.col("_l")), "left")
    out = out.withColumns({"low": F.coalesce("low", F.lit(low)), "high": F.coalesce("high", F.lit(high))})
    return out.select("doc_id", "id", "lang", F.col("bytes").alias("n_bytes"), "score", F.exp("score").alias("perplexity"), "low", "high", F.col("score").between(F.col("low"), F.col("high")).alias("kept"))
