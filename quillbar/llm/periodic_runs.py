"""Periodic run detection: Main-Lorentz divide and conquer over word ids.

A run is a stretch of at least ``least`` words with smallest period q and at least
2 q words, that no neighbouring word extends keeping the period. In every half of the
divide and conquer, two Z-functions say for each period p how far the words around
the midpoint repeat at distance p, ahead and behind. Where that makes a repetition, it
is taken if no word beyond the half's ends extends it: if one does, the run crosses
the midpoint of a larger half and is found there. Equal intervals are one run, with
the smallest of their periods.

Before that, words that cannot be in a run are set aside. A run repeats every window
of ``least / 2`` words, but for fewer than ``least / 2`` in a row about its middle; so
only zones of repeated windows are searched, and zones are narrowed by windows that
repeat within them until they no longer shrink. That leaves out no run.

Documents are independent: rows stream through Arrow batches without a shuffle, and a
task holds one batch. Words are interned per batch, exactly.

Null text or no words: no runs, empty text. Null doc_id: carried along. Repeated rows
each have their own result. Other columns are left out. Empty table: empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE

RUNS = "array<struct<start: long, length: long, period: long>>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def z_function(s: np.ndarray) -> np.ndarray:
    """z[i]: how many values from i on equal those from 0 on; z[0] is 0. Only places
    that hold the first value are visited."""
    values, z = s.tolist(), [0] * len(s)
    n, left, right = len(values), 0, 0
    for i in (np.flatnonzero(s[1:] == s[0]) + 1).tolist():
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and values[k] == values[i + k]:
            k += 1
        if i + k > right:
            left, right = i, i + k
        z[i] = k
    return np.array(z, dtype=np.int64)


def _crossing(x: np.ndarray, lo: int, hi: int, least: int) -> np.ndarray:
    """(start, end, period) of repetitions about the midpoint of x[lo:hi] that end
    inside it or at words that differ."""
    mid = (lo + hi) // 2
    u, v, both = x[lo:mid], x[mid:hi], x[lo:hi]
    gap = np.array([-1], dtype=x.dtype)
    ahead = z_function(np.concatenate((v, gap, both)))  # of v, and of v at every place
    behind = z_function(np.concatenate((u[::-1], gap, both[::-1])))
    p = np.arange(1, len(v) + 1)  # pairs (mid, mid + p)
    k1 = np.where(p < len(v), ahead[p], 0)
    k2 = behind[len(u) + 1 + hi - mid - p]
    right = np.stack((mid - k2, mid + p + k1, p), axis=1)
    q = np.arange(1, len(u) + 1)  # pairs (mid - q, mid)
    k3 = ahead[len(v) + 1 + mid - lo - q]
    k4 = np.where(q < len(u), behind[q], 0)
    left = np.stack((mid - q - k4, mid + k3, q), axis=1)
    found = np.concatenate((right, left))
    start, end, p = found.T
    long = end - start >= np.maximum(least, 2 * p)
    if not long.any():
        return found[:0]
    start, end, p = found[long].T
    more = np.zeros(len(p), dtype=bool)
    if lo > 0:
        more |= (start == lo) & (x[lo - 1] == x[lo - 1 + p])
    if hi < len(x):
        more |= (end == hi) & (x[hi] == x[hi - p])
    return found[long][~more]


def runs_of(x: np.ndarray, least: int = 12) -> np.ndarray:
    """(start, end, period) of all runs of the ids ``x`` (none negative), by start,
    then period."""
    found, todo = [], [(0, len(x))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo >= least:
            found.append(_crossing(x, lo, hi, least))
            mid = (lo + hi) // 2
            todo += [(lo, mid), (mid, hi)]
    rows = np.concatenate(found) if found else np.empty((0, 3), dtype=np.int64)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    first = np.ones(len(rows), dtype=bool)  # of an interval: the smallest period
    first[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    rows = rows[first]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def _zones(ids: np.ndarray, group: np.ndarray, at: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the stretches of ``at`` (places in ids, in order) that can hold runs.
    ``group``: of each of these places, what its windows must stay and repeat in."""
    half = least // 2
    if len(at) < least:
        return at[:0], at[:0]
    x = ids[at].astype(np.uint64)
    n = len(x) - half + 1
    key = np.zeros(n, dtype=np.uint64)
    for j in range(half):
        key = key * np.uint64(0x9E3779B97F4A7C15) + x[j : j + n] + np.uint64(1)
        key ^= key >> np.uint64(29)
    key += group[:n].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    whole = (at[half - 1 :] - at[:n] == half - 1) & (group[half - 1 :] == group[:n])
    place = np.flatnonzero(whole)
    order = place[np.argsort(key[place], kind="stable")]
    same = key[order[1:]] == key[order[:-1]]
    again = np.zeros(n, dtype=bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    found = np.flatnonzero(again)
    if not len(found):
        return at[:0], at[:0]
    opens = np.ones(len(found), dtype=bool)
    opens[1:] = (at[found[1:]] - at[found[:-1]] > half) | (group[found[1:]] != group[found[:-1]])
    lo = at[found[opens]]
    hi = at[found[np.append(np.flatnonzero(opens)[1:] - 1, len(found) - 1)]] + half
    wide = hi - lo >= least
    return lo[wide], hi[wide]


def zones(ids: np.ndarray, lengths: np.ndarray, least: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Bounds in ``ids`` (documents of ``lengths`` words, one behind the other) of
    the stretches that hold all runs."""
    at, group = np.arange(len(ids)), np.repeat(np.arange(len(lengths)), lengths)
    while True:
        lo, hi = _zones(ids, group, at, least)
        size = hi - lo
        if size.sum() == len(at) or not len(lo):
            return lo, hi
        group = np.repeat(np.arange(len(lo)), size)
        at = np.arange(size.sum()) + np.repeat(lo - np.concatenate(([0], np.cumsum(size)[:-1])), size)


def _batch(words: pa.ListArray, least: int) -> tuple[pa.Array, pa.Array]:
    """Of a batch of documents: the runs, and the text without their repetitions."""
    flat, lengths = words.flatten(), words.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    ids = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.concatenate(([0], np.cumsum(lengths)))
    keep, each = np.ones(len(ids), dtype=bool), []
    for lo, hi in zip(*zones(ids, lengths, least), strict=True):
        for start, end, period in runs_of(ids[lo:hi], least):
            each.append((lo + start, end - start, period))
            keep[lo + start + period : lo + end] = False
    found = np.array(each, dtype=np.int64).reshape(-1, 3)
    found = found[np.lexsort((found[:, 2], found[:, 0]))]
    doc = np.searchsorted(starts, found[:, 0], "right") - 1  # the last document that starts there has words
    columns = (found[:, 0] - starts[doc], found[:, 1], found[:, 2])
    structs = pa.StructArray.from_arrays([pa.array(c) for c in columns], fields=list(_RUN))
    bounds = np.searchsorted(doc, np.arange(len(lengths) + 1))
    left = np.concatenate(([0], np.cumsum(keep)))[starts]
    kept = pa.ListArray.from_arrays(pa.array(left, pa.int32()), flat.filter(pa.array(keep)))
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), structs), pc.binary_join(kept, " ")


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def with_planted_runs(documents: DataFrame) -> DataFrame:
    """doc_id, words: of one document in ten, by the checksum h of its decimal id,
    the words from a on repeat the first p of them. g = h / 10, a = g % n for n
    words, p = 1 + (n - a) / (3 + g % 8). A null id repeats nothing."""
    rows = documents.select("doc_id", words_of(F.col("text")).alias("words"), F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")).alias("h"))
    n = F.size("words").cast("long")
    g = F.floor(F.col("h") / 10)
    rows = rows.select("doc_id", "words", ((F.col("h") % 10 == 0) & (n > 0)).alias("made"), n.alias("n"), g.alias("g"), F.when(n > 0, F.pmod(g, n)).cast("int").alias("a"))
    rows = rows.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.pmod("g", F.lit(8))))).cast("int"))
    again = F.transform(F.sequence(F.lit(0), F.col("n").cast("int") - F.col("a") - 1), lambda i: F.get("words", F.col("a") + i % F.col("p")))
    return rows.select("doc_id", F.when(F.col("made"), F.concat(F.slice("words", F.lit(1), F.col("a")), again)).otherwise(F.col("words")).alias("words"))


def periodic_runs(documents: DataFrame, least: int = 12) -> DataFrame:
    """doc_id, runs (start, length, period; by start, then period) and ``collapsed``,
    the words that no run repeats, of rows with doc_id and ``words`` (an array)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, text = _batch(batch.column(1), least)
            yield pa.RecordBatch.from_arrays([batch.column(0), found, text], names=["doc_id", "runs", "collapsed"])

    rows = documents.select("doc_id", "words")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, runs {RUNS}, collapsed string")


def digests(found: DataFrame) -> DataFrame:
    """n_runs, the longest run, and checksums of the runs and the collapsed text."""
    # the greatest length first, then the smallest start and period
    best = F.get(F.sort_array(F.transform("runs", lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("start"), r["period"].alias("period")))), F.lit(0))
    rows = found.withColumn("best", best)
    line = lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        (-F.col("best.n")).alias("length"),
        F.col("best.period").alias("period"),
        F.expr("(-1000 * best.n) div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
