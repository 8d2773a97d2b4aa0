"""Mixing sources to target weights: Sainte-Lague apportionment of equal blocks.

A source's documents, in a seeded hash order, are one run of words cut into
blocks of ``block`` words. Seats (blocks) go to sources by highest quotients
target / (2 s + 1). The house is set beforehand, round(sum of targets / block), and
:func:`divisor` finds the divisor d that fills it: a source gets
floor(target / d + 1/2) seats, that is all seats whose quotient reaches d / 2, which
are the house's highest quotients of all sources. (Equal quotients at the last seat
all get one.) Shard j of S takes the next stretch of the same award
list: the seats with quotients between d * S / (2 (j+1)) and d * S / (2 j).
So every prefix of shards is an exact apportionment and quotas are whole numbers
per shard, by arithmetic, without a row per seat.

A source that gets more seats than it has blocks repeats: full passes first, then
its first blocks in seeded order.

Null text: size 0, takes 0. Null source: a source of its own, ordered last. Null or
repeated doc_ids: each row counts. Empty table: empty result. ``block`` shrinks to
1/64 of the smallest positive target, so that small sources come near theirs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, cut, maybe_broadcast, running_offsets

#: Divisors tried at once, and how often at most, until one fills the house.
TRIES, ROUNDS = 32, 10


def targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """source, source_size, target: ``share`` of all sizes dealt by weight, no
    source above ``cap`` times its size, the excess dealt again by weight.

    One row per source, so the windows below order sources, never documents.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    every = Window.partitionBy(F.lit(0))
    by_name = every.orderBy(F.col("source").asc_nulls_last())
    table = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("weight", F.get(table, (F.row_number().over(by_name) - 1) % len(weights))).withColumn("ceiling", F.lit(cap) * F.col("source_size"))
    by_level = every.orderBy(F.col("ceiling") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0.0)
    left = F.lit(share) * F.sum("source_size").over(every) - F.coalesce(F.sum("ceiling").over(before), none)
    open_weight = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), none)
    per = per.withColumns({"at": F.row_number().over(by_level), "level": left / open_weight})
    # the first source that the level does not fill ends the list of full ones
    settled = F.when(F.col("level") <= F.col("ceiling") / F.col("weight"), F.struct("at", "level"))
    per = per.withColumn("level", F.min(settled).over(every)["level"])
    return per.select("source", "source_size", F.least("ceiling", F.coalesce(F.col("level") * F.col("weight"), F.col("ceiling"))).alias("target"))


def divisor(plan: DataFrame) -> float:
    """The divisor whose quotients fill a house of round(sum of targets / block).

    Seats fall as the divisor grows, and lie within half a seat a source of
    sum / divisor, which brackets it. Each round counts the seats of ``TRIES``
    divisors in one aggregate over sources; whole numbers, so reruns agree.
    """
    total, sources, block = plan.agg(F.sum(F.round("target").cast("long")), F.count_if(F.col("target") > 0), F.max("block")).first()
    if not total:
        return float(block or 1)
    house = max(1, (2 * total + block) // (2 * block))
    low, high = total / (house + sources / 2 + 1), total / max(house - sources / 2 - 1, 0.25)
    for _ in range(ROUNDS):
        tries = [low * (high / low) ** (k / (TRIES + 1)) for k in range(1, TRIES + 1)]
        each = plan.select("target", F.posexplode(F.array(*[F.lit(d) for d in tries])).alias("k", "d"))
        seats_of = dict(each.groupBy("k").agg(F.sum(F.floor(F.col("target") / F.col("d") + 0.5)).alias("n")).collect())
        for k, d in enumerate(tries):
            if seats_of[k] == house:
                return d
        low = max([low, *[d for k, d in enumerate(tries) if seats_of[k] > house]])
        high = min([high, *[d for k, d in enumerate(tries) if seats_of[k] < house]])
    return low  # equal quotients at the last seat


def seats(plan: DataFrame, block: int = 64) -> DataFrame:
    """Adds block, blocks (of the source), divisor and quota (seats of the whole mix)."""
    every = Window.partitionBy(F.lit(0))
    least = F.min(F.when(F.col("target") > 0, F.col("target"))).over(every)
    plan = cut(plan.withColumn("block", F.greatest(F.lit(1), F.least(F.lit(block), F.floor(F.coalesce(least, F.lit(1.0)) / 64))).cast("long")))
    d = divisor(plan)
    return plan.withColumns({"divisor": F.lit(d), "blocks": F.ceil(F.col("source_size") / F.col("block")).cast("long"), "quota": F.floor(F.col("target") / d + 0.5).cast("long")})


def shard_quotas(plan: DataFrame, shards: int) -> DataFrame:
    """(source, shard, seats): whole-number quotas; every prefix of shards is an
    apportionment of its seats by highest quotients."""
    j = plan.select("*", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    upto = lambda k: F.floor(F.col("target") * k / (F.col("divisor") * F.lit(shards)) + 0.5)
    return j.select("source", "shard", (upto(F.col("shard") + 1) - upto(F.col("shard"))).cast("long").alias("seats"))


def mix(documents: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, block: int = 64, shards: int = 16, seed: int = 0) -> DataFrame:
    """One row per document: doc_id, id (the text's hash), source, size, source_size, target, quota,
    taken (words the mix takes, repeats counted), by_pass (the same for each pass that
    takes some) and spans, an array of
    (shard, pass, start, words): the stretches of the document each shard takes."""
    text_id = F.xxhash64(F.lit(seed), "doc_id", "text")
    sizes = cut(documents.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), text_id.alias("order"), F.xxhash64("text").alias("id")))
    plan = seats(targets(sizes, weights, share, cap), block)
    plan = maybe_broadcast(plan.withColumnRenamed("source", "_source"))
    placed = running_offsets(sizes, ["source"], F.col("order"), "size", "offset")
    placed = placed.join(plan, F.col("source").eqNullSafe(F.col("_source")))
    s = {"shards": shards}
    limit = "case when quota >= (p + 1) * blocks then source_size else greatest(0, least(source_size, (quota - p * blocks) * block)) end"
    placed = placed.withColumn("ends", F.expr(f"transform(sequence(0, {int(-(-cap // 1)) - 1}), p -> named_struct('p', p, 'end', least(offset + size, {limit})))"))
    placed = placed.withColumn("ends", F.expr("filter(ends, e -> e.end > offset)"))
    taken = F.expr("aggregate(ends, 0L, (t, e) -> t + e.end - offset)")
    shard_of = "cast(least({shards} - 1, greatest(0, ceil((e.p * blocks + floor({x} / block) + 0.5) * divisor * {shards} / target) - 1)) as int)"
    first, last = (shard_of.format(x=x, **s) for x in ("offset", "(e.end - 1)"))
    edge = "(cast(floor(target * {k} / (divisor * {shards}) + 0.5) as bigint) - e.p * blocks) * block"
    lo, hi = (edge.format(k=k, **s) for k in ("j", "(j + 1)"))
    spans = F.expr(
        f"filter(flatten(transform(ends, e -> transform(sequence(greatest(0, {first} - 1), least({shards} - 1, {last} + 1)), j -> named_struct('shard', j, 'pass', e.p,"
        f" 'start', greatest(offset, {lo}) - offset, 'words', least(e.end, case when j = {shards} - 1 then e.end else {hi} end) - greatest(offset, {lo}))))), s -> s.words > 0)"
    )
    return placed.select("doc_id", "id", "source", "size", "source_size", "target", "quota", taken.alias("taken"), F.transform("ends", lambda e: e["end"] - F.col("offset")).alias("by_pass"), spans.alias("spans"))


def whole_documents(plan: DataFrame, cap: float = 2.0) -> DataFrame:
    """doc_id, id, source, times (at least 1): how often each document of a :func:`mix` is
    taken whole. A pass that takes the larger part of a document takes it, else not. What
    a source then lacks, or has too much, is made up: first by documents that fit into the
    rest, in the order of a hash, as long as they fit together; then twice by the one whose
    size is nearest to the rest. A change is made only if it brings the source nearer to
    its target, and no document is taken more than ``cap`` times.

    Rows that repeat a document are taken together. Documents without words are not taken.
    """
    passes = F.size(F.filter("by_pass", lambda words: 2 * words > F.col("size")))
    rows = plan.select("doc_id", "id", "source", "size", "target", passes.cast("long").alias("times")).groupBy("doc_id", "id", "source")
    rows = rows.agg(F.sum("size").alias("size"), F.max("target").alias("target"), F.max("times").alias("times"))
    rows = cut(rows.where("size > 0"))
    most = int(cap // 1)

    def measured() -> DataFrame:
        """Rows with ``rest`` of their source and ``step``, the change that makes it smaller."""
        rest = rows.groupBy(F.col("source").alias("_source")).agg((F.max("target") - F.sum(F.col("size") * F.col("times"))).alias("rest"))
        step = F.when((F.col("rest") > 0) & (F.col("times") < most), 1).when((F.col("rest") < 0) & (F.col("times") > 0), -1).otherwise(0)
        both = rows.join(maybe_broadcast(cut(rest)), F.col("source").eqNullSafe(F.col("_source")))
        return both.drop("_source").withColumns({"step": step, "rest": F.abs("rest")})

    columns = rows.columns
    fits = (F.col("step") != 0) & (F.col("size") <= F.col("rest"))
    found = cut(measured().withColumn("order", F.xxhash64(F.lit(31), "doc_id", "id")))
    placed = running_offsets(found.where(fits), ["source"], F.col("order"), "size", "before")
    placed = placed.withColumn("times", F.col("times") + F.when(F.col("before") + F.col("size") <= F.col("rest"), F.col("step")).otherwise(0))
    rows = cut(placed.select(columns).unionByName(found.where(~fits).select(columns)))
    for _ in range(2):
        found = measured()
        left = F.abs(F.col("rest") - F.col("size"))
        key = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "id")
        best = found.where((F.col("step") != 0) & (left < F.col("rest"))).groupBy(F.col("source").alias("_source")).agg(F.min(F.struct(left.alias("left"), key.alias("key"))).alias("best"))
        found = found.join(maybe_broadcast(cut(best)), F.col("source").eqNullSafe(F.col("_source")), "left")
        rows = cut(found.withColumn("times", F.col("times") + F.when(key.eqNullSafe(F.col("best.key")), F.col("step")).otherwise(0)).select(columns))
    return rows.where("times > 0").select("doc_id", "id", "source", "times")
