"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman.

Words are lower-cased (A-Z) with ASCII punctuation taken as space. A document and a
test item of n words are aligned (match 2, mismatch -1, gap -1) and reported if the
best local score reaches ``least`` of the item's full score, 2n.

A seed is an ordered pair of words that stand at most two apart. Two matches that follow
each other in an alignment make such a pair in both texts, or cost 2 between them; so a
reported alignment has at least c = ``least`` * n - 1 of them, each at a place of its own
in the item, on diagonals at most R = 2n(1 - least) apart. Of any n - 1 - c + t places t
are among them. An item's seeds are those of the n - 1 - c + t places whose pairs are
rarest in the corpus, t being an eighth of the item. No pair of texts is lost by this, whatever
the words' frequencies and however the copy's edits are spread. Items so short that c is 0
take single words.

Pairs are counted, and seeds are found, in two passes over the corpus. Tasks get a bit
table of the pairs, of at most 2 ** ``BITS`` bits however large the benchmark is, and let
through what it knows; counts and places then meet items in joins by pair. Only where t
places of an item meet a text within 2R diagonals, the stretch is cut out and aligned.
Texts are known by their hash: copies are one text until the end.

Null or empty texts and items match nothing. Null doc_ids and item_ids are carried along.
Repeated rows are reported as often as they stand. Of equal scores the first end is told.
Long texts are read whole. Empty tables: no rows. Other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import maybe_broadcast, stored
from .repeats import groups, mix, texts, word_tokens

#: The largest bit table of pairs that tasks are given: 16 MB.
BITS = 27
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
FOLD[[ord(c) for c in PUNCTUATION]] = 32


def tokens(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, end, word hashes, their bounds) by groups of texts."""
    raw, offsets = texts(column)
    for i, j in groups(offsets):
        words, at = word_tokens(FOLD[raw[offsets[i] : offsets[j]]], 0, offsets[i : j + 1] - offsets[i])
        yield i, j, words, at


def grams(words: np.ndarray, text: np.ndarray, single: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes, places of their first words): pairs of words of one text that stand one or
    two apart; single words, too, if asked for. ``text``: which text a word is of."""
    for d in (1, 2):
        at = np.flatnonzero(text[d:] == text[:-d])
        yield mix(mix(words[at]) * np.uint64(0x9E3779B97F4A7C15) + words[at + d]), at
    if single:
        yield mix(words ^ np.uint64(0xD6E8FEB86659FD93)), np.arange(len(words))


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, words) of (item, text)."""
    for batch in batches:
        for i, j, words, at in tokens(batch.column("text")):
            held = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(words.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("item").slice(i, j - i), held], names=["item", "words"])


def _item_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, place, gram) of (item, words, single)."""
    for batch in batches:
        for item, held, single in zip(*(batch.column(c).to_pylist() for c in ("item", "words", "single")), strict=True):
            words = np.array(held, dtype=np.int64).view(np.uint64)
            found = list(grams(words, np.zeros(len(words)), single))
            gram, place = found[-1] if single else [np.concatenate(x) for x in zip(*found, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(gram), item)), pa.array(place), pa.array(gram.view(np.int64))], names=["item", "place", "gram"])


def bit_table(grams_: DataFrame) -> np.ndarray:
    """Bits of the leading digits of ``gram``, in 64-bit words; about one in 32 is set, until
    the table has 2 ** BITS. The driver gets a row per word that is not zero."""
    bits = min(BITS, max(16, (32 * grams_.count()).bit_length()))
    at = F.shiftrightunsigned("gram", 64 - bits)
    rows = grams_.select(F.shiftrightunsigned(at, 6).alias("w"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(gram, {64 - bits}) & 63 as int))").alias("b"))
    held = rows.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()  # at most 2 ** (BITS - 6) rows
    table = np.zeros(1 << (bits - 6), dtype=np.uint64)
    table[held.column("w").to_numpy()] = held.column("b").to_numpy().view(np.uint64)
    return table


def _known(table: np.ndarray, gram: np.ndarray) -> np.ndarray:
    shift = np.uint64(64 - len(table).bit_length() - 5)
    at = gram >> shift
    return (table[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def _passing(given, single: bool, counted: bool):
    """Grams of texts that the table knows: (gram, n), or (id, pos, gram) by text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = given.value
        for batch in batches:
            for i, _, words, at in tokens(batch.column("text")):
                text = np.repeat(np.arange(len(at) - 1), np.diff(at))
                found = []
                for gram, place in grams(words, text, single):
                    on = np.flatnonzero(_known(table, gram))
                    found.append((gram[on], place[on]))
                gram, place = (np.concatenate(x) for x in zip(*found, strict=True))
                if not len(gram):
                    continue
                if counted:
                    each, n = np.unique(gram, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(each.view(np.int64)), pa.array(n.astype(np.int64))], names=["gram", "n"])
                else:
                    of = text[place]
                    ids = batch.column("id").take(pa.array(of + i))
                    yield pa.RecordBatch.from_arrays([ids, pa.array((place - at[of]).astype(np.int64)), pa.array(gram.view(np.int64))], names=["id", "pos", "gram"])

    return run


def any_single(items: DataFrame, least: float) -> bool:
    """Whether an item is too short for pairs."""
    return not items.where((F.size("words") > 0) & (F.ceil(least * F.size("words") - 1 - 1e-9) < 1)).isEmpty()


def seeds(items: DataFrame, corpus: DataFrame, least: float) -> DataFrame:
    """gram, item, place, meet (t), reach (R) of ``items`` (item, words)."""
    sc = corpus.sparkSession.sparkContext
    n = F.size("words").cast("long")
    close = F.ceil(least * n - 1 - 1e-9)
    sized = items.where("size(words) > 0").withColumns({"n": n, "close": close, "single": close < 1, "reach": F.greatest(F.lit(1), F.ceil(2 * n * (1 - least) - 1e-9))})
    sized = sized.withColumn("meet", F.when(F.col("single"), 1).otherwise(F.least("close", F.ceil(F.col("n") / 8))))
    keep = F.when(F.col("single"), F.col("n") - F.greatest(F.lit(1), F.ceil(least * F.col("n") - 1e-9)) + 1).otherwise(F.col("n") - 1 - F.col("close") + F.col("meet"))
    sized = stored(sized.withColumn("keep", keep))
    every = stored(sized.select("item", "words", "single").mapInArrow(_item_grams, "item long, place long, gram long"))
    given = sc.broadcast(bit_table(every.select("gram").distinct()))
    single = any_single(items, least)
    counts = stored(corpus.select("text").mapInArrow(_passing(given, single, True), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("seen")))
    given.unpersist()
    known = every.join(counts, "gram", "left").withColumn("seen", F.coalesce("seen", F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("item").orderBy("common", "place"))  # of one item's places
    places = known.groupBy("item", "place").agg(F.sum("seen").alias("common")).withColumn("rank", rank)
    chosen = places.join(sized.select("item", "keep", "meet", "reach"), "item").where("rank <= keep").select("item", "place", "meet", "reach")
    return stored(every.join(chosen, ["item", "place"]).select("gram", "item", "place", "meet", "reach").distinct())


def meetings(corpus: DataFrame, seeds_: DataFrame, single: bool) -> DataFrame:
    """id, item, b: where enough seeds meet on the diagonals b * R to (b + 2) * R."""
    sc = corpus.sparkSession.sparkContext
    given = sc.broadcast(bit_table(seeds_.select("gram").distinct()))
    hits = stored(corpus.select("id", "text").mapInArrow(_passing(given, single, False), "id long, pos long, gram long").distinct())
    given.unpersist()
    b = F.floor((F.col("pos") - F.col("place")) / F.col("reach"))
    met = hits.join(maybe_broadcast(seeds_), "gram").select("id", "item", "place", "meet", F.explode(F.array(b, b - 1)).alias("b")).distinct()  # a place counts once
    return met.groupBy("id", "item", "b").agg(F.count("*").alias("n"), F.first("meet").alias("meet")).where("n >= meet").select("id", "item", "b")


def align(item: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best local scores of ``item`` against each row of ``windows`` (0: no word),
    and the columns where they end."""
    rows, width = windows.shape
    up = np.zeros((rows, width + 1), dtype=np.int32)
    best, end = np.zeros(rows, np.int32), np.zeros(rows, np.int64)
    ramp = np.arange(width + 1, dtype=np.int32)
    for word in item:
        now = np.zeros_like(up)
        np.maximum(up[:, :-1] + np.where(windows == word, 2, -1), up[:, 1:] - 1, out=now[:, 1:])
        np.maximum(now, 0, out=now)
        now = np.maximum.accumulate(now + ramp, axis=1) - ramp  # gaps along the row, 1 each
        at = now.argmax(axis=1)
        top = now[np.arange(rows), at]
        better = top > best
        best[better], end[better] = top[better], at[better]
        up = now
    return best, end


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, item, begin, stretch) of (text, cases): the words about each meeting."""
    for batch in batches:
        for text, cases in zip(batch.column("text").to_pylist(), batch.column("cases").to_pylist(), strict=True):
            words = next(tokens(pa.array([text])))[2].view(np.int64)
            bounds = [(max(0, c["b"] * c["reach"]), c["b"] * c["reach"] + c["n"] + 2 * c["reach"]) for c in cases]
            held = [words[a:z] for a, z in bounds]
            ends = np.concatenate(([0], np.cumsum([len(h) for h in held]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array([c["id"] for c in cases]), pa.array([c["item"] for c in cases]), pa.array([a for a, _ in bounds]), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(held)))],
                names=["id", "item", "begin", "stretch"],
            )


def _aligned(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = batch.column("item").to_numpy()
            edges = np.flatnonzero(np.diff(items, prepend=items[:1] - 1, append=items[-1:] + 1)) if len(items) else []
            stretch, begin, words = batch.column("stretch"), batch.column("begin").to_numpy(), batch.column("words")
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                item = words[int(lo)].values.to_numpy().view(np.uint64)
                for first in range(lo, hi, 256):
                    held = [stretch[k].values.to_numpy().view(np.uint64) for k in range(first, min(first + 256, hi))]
                    grid = np.zeros((len(held), max(1, max(map(len, held)))), dtype=np.uint64)
                    for r, h in enumerate(held):
                        grid[r, : len(h)] = h
                    best, end = align(item, grid)
                    score = best / (2 * len(item))
                    on = np.flatnonzero(score >= least)
                    ids = batch.column("id").take(pa.array(first + on))
                    ends = begin[first : first + len(held)][on] + end[on]
                    yield pa.RecordBatch.from_arrays([ids, pa.array(items[first + on]), pa.array(np.round(score[on], 6)), pa.array(ends)], names=["id", "item", "score", "end_word"])

    return run


def contaminated(documents: DataFrame, benchmark: DataFrame, least: float = 0.5) -> DataFrame:
    """(doc_id, item_id, score, end_word): pairs of a document and a test item that
    it holds, whole or edited; score is the part of the item's full score."""
    return found(documents, benchmark, least).drop("id")


def found(documents: DataFrame, benchmark: DataFrame, least: float = 0.5) -> DataFrame:
    """:func:`contaminated` with ``id``, the hash of the document's text."""
    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("id"), "text")
    bench = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.xxhash64("text").alias("item"), "text")
    items = stored(bench.groupBy("item").agg(F.first("text").alias("text")).mapInArrow(_words, "item long, words array<long>"))
    cases = stored(meetings(source, seeds(items, source, least), any_single(items, least)))
    n = F.size("words").cast("long")
    sizes = items.select("item", n.alias("n"), F.greatest(F.lit(1), F.ceil(2 * n * (1 - least) - 1e-9)).alias("reach"))
    cases = cases.join(maybe_broadcast(sizes), "item").groupBy("id").agg(F.collect_list(F.struct("id", "item", "b", "n", "reach")).alias("cases"))  # of one text
    asked = stored(cases)
    held = source.join(maybe_broadcast(asked.select("id")), "id").groupBy("id").agg(F.first("text").alias("text"))
    stretches = held.join(asked, "id").select("text", "cases").mapInArrow(_stretches, "id long, item long, begin long, stretch array<long>")
    both = stretches.join(items, "item").select("id", "item", "begin", "stretch", "words").sortWithinPartitions("item")
    scored = both.mapInArrow(_aligned(least), "id long, item long, score double, end_word long")
    best = stored(scored.groupBy("id", "item").agg(F.max(F.struct("score", (-F.col("end_word")).alias("e"))).alias("m")))
    named = best.join(bench.select("item", "item_id"), "item").select("id", "item_id", F.col("m.score").alias("score"), (-F.col("m.e")).alias("end_word"))
    return source.select("doc_id", "id").join(maybe_broadcast(named), "id").select("doc_id", "id", "item_id", "score", "end_word")
