"""SimHash near-dedup by multi-index hashing.

A 64-bit fingerprint is cut into two 32-bit segments. Fingerprints at distance 3
or less agree in one of them up to one bit, so each fingerprint enumerates the
Hamming ball of radius 1 (33 keys) of each segment, fetches the table entries
with that very key, and verifies complete distances. Work is 66 keys per
*distinct* fingerprint; a key of a 32-bit table stays selective at any size.

Keys with few matches are verified in a join. A key shared by many fingerprints
(a large group of near copies) is cut into blocks of entries and probes; each
block is compared in numpy and returns a spanning forest of its links, not its
pairs, so output stays linear in the group and no task holds more than a block.

Null or wordless text: fingerprint zero, linked like any other. Null doc_id:
fingerprinted and linked; it never names a component unless all members are null.
Repeated rows each have a row of the result, of one component. Long texts are read
whole. Other columns are left out. Empty table: empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, stored
from .repeats import texts

#: Keys with up to this many (entry, probe) combinations are verified in the join.
PAIRS = 64
#: Entries and probes in a block of a larger key.
BLOCK = 4096


def fingerprints(documents: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, ``id`` (hash of the text) and ``fp`` (long): bit i is set if it is set in over half of the
    XXH64 hashes (seed 42) of the lower-cased (A-Z) word shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = texts(batch.column("text"))
            whole = raw.tobytes()
            out = np.zeros(batch.num_rows, dtype=np.uint64)
            for i in range(batch.num_rows):
                out[i] = fingerprint(whole[offsets[i] : offsets[i + 1]], shingle)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("id"), pa.array(out.view(np.int64))], names=["doc_id", "id", "fp"])

    return documents.select("doc_id", "text", F.xxhash64("text").alias("id")).mapInArrow(run, "doc_id long, id long, fp long")


WEIGHTS = np.uint64(1) << np.arange(63, -1, -1, dtype=np.uint64)


def fingerprint(text: bytes, shingle: int) -> int:
    words = text.lower().split()  # bytes: A-Z and the six ASCII spaces only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    n = max(1, len(words) - shingle + 1)
    last = ends[min(shingle, len(words)) - 1 :] - 1
    first = np.concatenate(([0], ends[: n - 1]))
    hash_of = xxhash.xxh64_intdigest
    h = np.array([hash_of(joined[a:b], 42) for a, b in zip(first.tolist(), last.tolist(), strict=True)], dtype=">u8")
    total = np.zeros(64, dtype=np.int64)
    for lo in range(0, n, 1 << 16):
        total += np.unpackbits(h[lo : lo + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(WEIGHTS[total * 2 > n].sum(dtype=np.uint64))


def links(fps: DataFrame, distance: int = 3) -> DataFrame:
    """(u, v): links between the distinct longs of column ``fp``, enough of them
    to connect all fingerprints within ``distance`` (at most 3) bits."""
    if not 0 <= distance <= 3:
        raise ValueError("two segments with balls of radius 1 find distances up to 3")
    half = (F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)))
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << i).cast("long") for i in range(32)])
    # the table's number stands in bit 32 of the key
    keys = [h if t == 0 else h.bitwiseOR(F.lit(1 << 32)) for t, h in enumerate(half)]
    table = fps.select("fp", F.explode(F.array(*keys)).alias("k"))
    sizes = table.groupBy("k").agg(F.count("*").alias("ne"))
    ball = fps.select("fp", F.explode(F.array(*keys)).alias("k0")).select("fp", F.explode(flips).alias("flip"), "k0").select("fp", F.col("k0").bitwiseXOR(F.col("flip")).alias("k"), (F.col("flip") == 0).alias("own"))
    hits = stored(ball.join(sizes, "k").where("not own or ne > 1").select("k", "fp", "ne"))
    keyed = hits.groupBy("k").agg(F.first("ne").alias("ne"), F.count("*").alias("np"))
    few = keyed.where(F.col("ne") * F.col("np") <= PAIRS).select("k")
    many = keyed.where(F.col("ne") * F.col("np") > PAIRS).select("k", F.ceil(F.col("ne") / BLOCK).cast("int").alias("ec"), F.ceil(F.col("np") / BLOCK).cast("int").alias("pc"))
    near = F.bit_count(F.col("p.fp").bitwiseXOR(F.col("e.fp"))) <= distance
    light = hits.join(few, "k").alias("p").join(table.alias("e"), (F.col("p.k") == F.col("e.k")) & (F.col("p.fp") != F.col("e.fp")) & near)
    light = light.select(F.col("p.fp").alias("u"), F.col("e.fp").alias("v"))
    entry = table.join(many, "k").select("k", "fp", F.lit(True).alias("entry"), F.pmod(F.xxhash64("fp"), "ec").cast("int").alias("eb"), F.explode(F.sequence(F.lit(0), F.col("pc") - 1)).alias("pb"))
    probe = hits.join(many, "k").select("k", "fp", F.lit(False).alias("entry"), F.explode(F.sequence(F.lit(0), F.col("ec") - 1)).alias("eb"), F.pmod(F.xxhash64("fp"), "pc").cast("int").alias("pb"))
    heavy = entry.unionByName(probe).groupBy("k", "eb", "pb").applyInPandas(_forest(distance), "u long, v long")
    return light.unionByName(heavy)


def _forest(distance: int):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        """A forest over the links between a block's entries and probes."""
        fp = block["fp"].to_numpy().view(np.uint64)
        is_entry = block["entry"].to_numpy()
        entries, probes = fp[is_entry], fp[~is_entry]
        label = np.arange(len(probes))
        out = []
        for e in entries:
            near = np.flatnonzero(np.bitwise_count(probes ^ e) <= distance)
            if not len(near):
                continue
            roots, first = np.unique(label[near], return_index=True)
            out += [(int(e), int(probes[near[i]])) for i in first]
            if len(roots) > 1:
                label[np.isin(label, roots)] = roots[0]
        pairs = np.array(out, dtype=np.uint64).reshape(-1, 2).view(np.int64)
        pairs = pairs[pairs[:, 0] != pairs[:, 1]]
        return pd.DataFrame({"u": pairs[:, 0], "v": pairs[:, 1]})

    return run


def members(documents: DataFrame, shingle: int = 3, distance: int = 3) -> DataFrame:
    """doc_id, id, fp, component_id and ``root``, which names the component even
    where doc_ids are null or repeated; one row per row of ``documents``."""
    marked = cut(fingerprints(documents, shingle))
    distinct = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("low")))
    roots = components(links(distinct.select("fp"), distance))
    joined = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    ids = joined.groupBy("root").agg(F.min("low").alias("component_id"))
    by_fp = joined.join(ids, "root").select("fp", "component_id", "root")
    return marked.join(by_fp, "fp").select("doc_id", "id", "fp", "component_id", "root")


def simhash_components(documents: DataFrame, shingle: int = 3, distance: int = 3) -> DataFrame:
    """doc_id, fp and component_id, the smallest doc_id of the fingerprint's
    connected component; one row per row of ``documents``."""
    return members(documents, shingle, distance).select("doc_id", "fp", "component_id")
