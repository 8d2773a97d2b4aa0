"""Sharding by fixed virtual slots and a versioned slot-to-shard map.

Records are hashed into thousands of virtual slots that never change. Bytes are
summed per slot, and a map (version, vslot, shard) says which shard holds a slot.
Rebalancing edits the map: it moves or swaps as few slots as bring the shards'
bytes together, and stores the result as the next version. Only the map and the
sums of slots (a fixed number of rows, ``slots``) are ever on the driver.

Null text: 8 bytes, checksum 0. Null doc_id: hashed by its text. Repeated rows are
dealt as any other. Empty table: empty result, an even map. A stored map with another
number of slots, or of more shards than asked for: an error.
"""

from __future__ import annotations

import uuid
from bisect import bisect_left

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, running_offsets, shared_dir


def even_map(slots: int, shards: int) -> list[int]:
    return [slot * shards // slots for slot in range(slots)]


def rebalance(shard_of: list[int], load: list[int], shards: int, edits: int = 20_000) -> list[int]:
    """The map after moves and swaps between the fullest and the emptiest shard,
    each the one that halves their gap best, until none makes it smaller or ``edits``
    of them are made: a bound on how many slots change their shard at once. What it
    leaves uneven, the next edit of the stored map goes on with."""
    now = list(shard_of)
    held = [sorted((load[s], s) for s in range(len(now)) if now[s] == k) for k in range(shards)]
    total = [sum(x for x, _ in h) for h in held]
    for _ in range(edits):
        top, low = max(range(shards), key=lambda k: (total[k], -k)), min(range(shards), key=lambda k: (total[k], k))
        gap = total[top] - total[low]
        best = None  # (distance from half the gap, moved slot, slot given back)
        for x in held[top]:
            options = [(0, None)] if x[0] else []
            at = bisect_left(held[low], (x[0] - gap // 2, -1))
            options += [(y[0], y) for y in held[low][max(0, at - 1) : at + 1]]
            for back, y in options:
                step = x[0] - back
                if 0 < step < gap and (best is None or abs(2 * step - gap) < best[0]):
                    best = (abs(2 * step - gap), x, y)
        if best is None:
            break
        for item, a, b in ((best[1], top, low), (best[2], low, top)):
            if item is not None:
                held[a].remove(item)
                held[b].insert(bisect_left(held[b], item), item)
                total[a] -= item[0]
                total[b] += item[0]
                now[item[1]] = b
    return now


def save_map(spark: SparkSession, path: str, version: int, shard_of: list[int]) -> None:
    rows = [(version, slot, shard) for slot, shard in enumerate(shard_of)]
    spark.createDataFrame(rows, "version int, vslot int, shard int").coalesce(1).write.mode("append").parquet(path)


def has_map(spark: SparkSession, path: str) -> bool:
    try:
        return not spark.read.schema("version int, vslot int, shard int").parquet(path).isEmpty()
    except AnalysisException:  # nothing there yet
        return False


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The map of one version (the latest if None)."""
    every = spark.read.schema("version int, vslot int, shard int").parquet(path)
    if version is None:
        version = every.agg(F.max("version")).first()[0]
    return every.where(F.col("version") == version)


def shard(documents: DataFrame, shards: int = 24, slots: int = 4096, path: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, vslot, version, shard and slot, the record's place
    in its shard. The map is read from ``path`` if it has one and edited; else an
    even one is stored there as version 0 and its edit as version 1."""
    spark = documents.sparkSession
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    key = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id"))
    rows = documents.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"), key.alias("key"))
    rows = cut(rows.withColumn("vslot", F.pmod("key", F.lit(slots)).cast("int")))
    load = [0] * slots
    for vslot, size in rows.groupBy("vslot").agg(F.sum("size")).collect():  # at most ``slots`` rows
        load[vslot] = size
    if path is None:
        path = f"{shared_dir(spark)}/shard-maps/{uuid.uuid4().hex}"
    if not has_map(spark, path):
        save_map(spark, path, 0, even_map(slots, shards))
    known = load_map(spark, path).collect()  # one row a slot
    old = [r["shard"] for r in sorted(known, key=lambda r: r["vslot"])]
    if len(old) != slots:
        raise ValueError(f"the map at {path} has {len(old)} slots, not {slots}: slots never change")
    if max(old) >= shards:
        raise ValueError(f"the map at {path} uses {max(old) + 1} shards; emptying shards is not offered")
    version = known[0]["version"] + 1
    save_map(spark, path, version, rebalance(old, load, shards))
    placed = rows.join(F.broadcast(load_map(spark, path, version)), "vslot")  # ``slots`` rows
    ordered = running_offsets(placed.withColumn("one", F.lit(1).cast("long")), ["shard"], F.xxhash64(F.lit(17), "key"), "one", "slot")
    return ordered.select("doc_id", "size", "text_crc32", "vslot", "version", "shard", "slot")
