"""Windows of a fixed number of tokens that also start earlier in the corpus.

Shared core of the substring and the suffix operators. Tokens are words or
UTF-8 bytes. A *run* is a stretch of consecutive windows whose lowest-hashed
k-gram (winnowed anchor, leftmost of equals) is the same. Equal windows have the
same anchor at the same distance, wherever they stand, so anchors are a sample
of positions that lines up by content. One row per run is enough to find:

* runs whose whole block of text stands earlier: all its windows are covered;
* runs with an anchor of their own: none is;
* the rest, runs of differing blocks that share an anchor (the ends of repeated
  passages): their windows are compared one by one, in the bucket of the anchor.

Rows are dealt by anchor, sorted, and read as a stream, so a task holds a few
buckets. Copies are told apart before that, piece by piece of a task's input, so
that a block which millions of documents share reaches its bucket once a piece. An
anchor with very many different blocks is dealt by block, and its windows by name.

Names are 2 x 64-bit polynomial hashes (two runs are equal only if both the
anchor's and the block's agree, two windows only if both do).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, stored

U = np.uint64
#: Text is hashed in pieces of about this many bytes, so that work arrays stay small.
PIECE = 1 << 20
#: Fixed odd multipliers, = 3 modulo 8.
MULTIPLIERS = (0x9E3779B97F4A7C1B, 0xD6E8FEB86659FD93)
#: Of a place: the lower bits are the start in the text (under 2 GB), the rest tells
#: apart texts under one doc_id.
START_BITS = 31
#: Rows that are compared at a time in a task (36 bytes each), and rows of a batch
#: that a task hands on.
ROWS, OUT = 1 << 18, 1 << 15
#: Hot anchors are looked for in one of so many documents, and have at least so
#: many runs there.
SAMPLE, HOT = 64, 32


@dataclass(frozen=True)
class Span:
    """``length`` tokens make a window; anchors are ``gram``-grams."""

    unit: str
    length: int
    gram: int
    same_doc: bool

    def is_later(self, doc: np.ndarray, pos: np.ndarray, first_doc: np.ndarray, first_pos: np.ndarray) -> np.ndarray:
        """Whether (doc, pos) counts as behind the first of its kind."""
        behind = doc > first_doc
        return behind | ((doc == first_doc) & (pos > first_pos)) if self.same_doc else behind


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@lru_cache(4)
def byte_table(which: int) -> np.ndarray:
    return mix((np.arange(1, 257, dtype=U) + U(1000 * which)) * U(0x9E3779B97F4A7C15))


@lru_cache(4)
def powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """m**i and m**-i modulo 2**64 for i < n."""
    m = MULTIPLIERS[which]
    out = []
    for base in (m, pow(m, -1, 1 << 64)):
        p = np.full(n, base, dtype=U)
        p[0] = 1
        out.append(np.cumprod(p, dtype=U))
    return out[0], out[1]


class Rolling:
    """Hashes of any slice of a token array, by prefix sums modulo 2**64."""

    def __init__(self, tokens: np.ndarray, which: int) -> None:
        n = len(tokens)
        self.up, down = powers(which, 1 << max(12, n.bit_length()))
        self.sums = np.zeros(n + 1, dtype=U)
        np.cumsum(tokens * down[:n], out=self.sums[1:])

    def at(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        end = start + length
        return mix((self.sums[end] - self.sums[start]) * self.up[end - 1])

    def every(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return mix((self.sums[length:] - self.sums[:n]) * self.up[length - 1 : length - 1 + n])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    n = len(x)
    rows = -(-n // w)
    padded = np.full(rows * w, np.iinfo(U).max, dtype=U)
    padded[:n] = x
    grid = padded.reshape(rows, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def is_space(raw: np.ndarray) -> np.ndarray:
    return (raw == 32) | ((raw >= 9) & (raw <= 13))


def word_edges(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end in the concatenated texts ``raw``, whose byte bounds
    are ``bounds``."""
    gap = np.ones(len(raw) + 2, dtype=bool)
    gap[1:-1] = is_space(raw)
    first = ~gap[1:-1] & gap[:-2]
    last = ~gap[1:-1] & gap[2:]
    inner = bounds[1:-1]
    inner = inner[(inner > 0) & (inner < len(raw))]  # a text's end also ends a word
    first[inner] |= ~gap[1:-1][inner]
    last[inner - 1] |= ~gap[1:-1][inner - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def word_tokens(raw: np.ndarray, which: int, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash per word, and the word bounds of the texts."""
    start, end = word_edges(raw, bounds)
    table = byte_table(which)
    hashes = np.zeros(len(start), dtype=U)
    for lo in range(0, len(start), PIECE // 8):
        s, e = start[lo : lo + PIECE // 8], end[lo : lo + PIECE // 8]
        hashes[lo : lo + len(s)] = Rolling(table[raw[s[0] : e[-1]]], which).at(s - s[0], e - s)
    return hashes + (end - start).astype(U) * U(0x9E3779B97F4A7C15), np.searchsorted(start, bounds)


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column and the n+1 offsets; null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def groups(offsets: np.ndarray, size: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` bytes together; a larger text is alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def tokens_of(raw: np.ndarray, bounds: np.ndarray, unit: str) -> Iterator[np.ndarray]:
    """Two token-hash arrays, then the token bounds of the texts."""
    if unit == "byte":
        yield byte_table(0)[raw]
        yield byte_table(1)[raw]
        yield bounds
    else:
        first, at = word_tokens(raw, 0, bounds)
        yield first
        yield word_tokens(raw, 1, bounds)[0]
        yield at


def winnow(grams: np.ndarray, w: int) -> np.ndarray:
    """For every ``w`` neighbouring grams, the place of the lowest, leftmost of equals."""
    low = U((1 << 21) - 1)
    packed = (grams & ~low) | np.arange(len(grams), dtype=U)
    return (sliding_min(packed, w) & low).astype(np.int64)


def runs_of(tok1: np.ndarray, tok2: np.ndarray, bounds: np.ndarray, span: Span) -> tuple[np.ndarray, ...]:
    """(text, first window, windows, anchor name, block name) of every run."""
    none = tuple(np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.int64, np.int64, np.int64))
    if not len(tok1) or (np.diff(bounds) < span.length).all():
        return none
    parts = []
    margin = span.length + 1
    text_of = np.repeat(np.arange(len(bounds) - 1, dtype=np.int32), np.diff(bounds))
    last_start = bounds[1:] - span.length
    for lo in range(0, len(tok1), PIECE):
        # windows that start in [lo, hi) are this piece's; it reads on as far as they do
        hi = min(lo + PIECE, len(tok1))
        a, b = max(0, lo - margin), min(len(tok1), hi + 2 * margin)
        if b - a < span.length:
            continue
        one, two = Rolling(tok1[a:b], 0), Rolling(tok2[a:b], 1)
        grams = one.every(span.gram)
        anchor = winnow(grams, span.length - span.gram + 1)
        p = np.arange(a, a + len(anchor))
        text = text_of[a : a + len(anchor)]
        valid = (p <= last_start[text]) & (p >= lo) & (p < hi)
        change = np.ones(len(p), dtype=bool)
        change[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]) | ~valid[:-1]
        start = np.flatnonzero(valid & change)
        if not len(start):
            continue
        ends = valid.copy()
        ends[:-1] &= change[1:] | ~valid[1:]
        count = np.flatnonzero(ends) - start + 1
        shift = anchor[start] - start
        block = mix(two.at(start, count + (span.length - 1)) + U(0x632BE59BD9B4E019) * (count * 4096 + shift).astype(U))
        parts.append((text[start].astype(np.int64), start + a - bounds[text[start]], count, grams[anchor[start]].view(np.int64), block.view(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else none


def runs_in(batches: Iterator[pa.RecordBatch], span: Span) -> Iterator[tuple[np.ndarray, ...]]:
    """(doc, pos, windows, anchor, block) of all runs, by groups of texts."""
    for batch in batches:
        raw, offsets = texts(batch.column("text"))
        doc, sub = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "sub"))
        for i, j in groups(offsets):
            tok1, tok2, at = tokens_of(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], span.unit)
            text, start, count, a, b = runs_of(tok1, tok2, at, span)
            if len(text):
                yield doc[i + text], (sub[i + text] << START_BITS) + start, count, a, b


def gathered(parts: Iterator[tuple[np.ndarray, ...]], rows: int) -> Iterator[tuple[np.ndarray, ...]]:
    """The same columns in pieces of about ``rows`` rows."""
    held: list[tuple[np.ndarray, ...]] = []
    for part in parts:
        held.append(part)
        if sum(len(x[0]) for x in held) >= rows:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def after_first(one: np.ndarray, two: np.ndarray, doc: np.ndarray, pos: np.ndarray, span: Span) -> np.ndarray:
    """Whether a row's (one, two) stands earlier among these rows."""
    order = np.lexsort((pos, doc, two, one))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (one[order[1:]] != one[order[:-1]]) | (two[order[1:]] != two[order[:-1]])
    first = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    later = np.empty(len(order), dtype=bool)
    later[order] = span.is_later(doc[order], pos[order], doc[first], pos[first])
    return later


def batch_of(columns: dict[str, np.ndarray | pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()], names=list(columns))


def spread(doc: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """A key that deals out rows which need not meet any other."""
    return mix(doc.view(U) * U(0x9E3779B97F4A7C15) + pos.view(U)).view(np.int64)


def is_in(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), dtype=bool)
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


def _sample(span: Span):
    """Anchors with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, a, _ in gathered(runs_in(batches, span), ROWS):
            names, times = np.unique(a, return_counts=True)
            yield batch_of({"a": names, "c": times})

    return run


ROW = "k long, a long, b long, doc long, pos long, n int, later boolean"


def _scan(span: Span, hot):
    """Runs, dealt by anchor. Of equal blocks in one piece only the first has to
    meet others, the rest are told here; hot anchors are dealt by block, too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, pos, n, a, b in gathered(runs_in(batches, span), ROWS):
            later = after_first(a, b, doc, pos, span)
            k = np.where(is_in(a, hot.value), a ^ mix(b.view(U)).view(np.int64), a)
            k = np.where(later, spread(doc, pos), k)
            for lo in range(0, len(k), OUT):
                s = slice(lo, lo + OUT)
                yield batch_of({"k": k[s], "a": a[s], "b": b[s], "doc": doc[s], "pos": pos[s], "n": n[s].astype(np.int32), "later": later[s]})

    return run


def whole_keys(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches sorted by k, cut so that no value of k is in two of them."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < rows:
            continue
        k = batch.column("k").to_numpy()
        cut_at = int(np.searchsorted(k, k[-1], "left"))
        if cut_at == 0 and len(held) > 1 and held[-2].column("k")[-1].as_py() == int(k[-1]):
            continue  # the key of the end began before this batch
        yield _joined([*held[:-1], batch.slice(0, cut_at)])
        held, n = [batch.slice(cut_at)], batch.num_rows - cut_at
    if n:
        yield _joined(held)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(parts).combine_chunks().to_batches()[0] if sum(p.num_rows for p in parts) else parts[0].slice(0, 0)


def _judge(span: Span):
    """Of rows sorted by k: those told to be later, and the open ones, firsts of
    blocks whose anchor has other blocks too. An anchor's only block is done."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_keys(batches, ROWS):
            if not batch.num_rows:
                continue
            k, a, b, doc, pos, n, told = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("k", "a", "b", "doc", "pos", "n", "later"))
            later = told.copy()
            rest = np.flatnonzero(~told)
            later[rest] = after_first(a[rest], b[rest], doc[rest], pos[rest], span)
            order = rest[np.lexsort((b[rest], a[rest]))]
            new = np.ones(len(order), dtype=bool)
            new[1:] = a[order[1:]] != a[order[:-1]]
            group = np.cumsum(new) - 1
            change = np.zeros(len(order), dtype=bool)
            change[1:] = ~new[1:] & (b[order[1:]] != b[order[:-1]])
            differ = np.zeros(len(k), dtype=bool)
            differ[order] = np.bincount(group, weights=change, minlength=1)[group] > 0 if len(order) else False
            keep = later | differ | (~told & (k != a))
            yield batch_of({"doc": doc[keep], "pos": pos[keep], "n": n[keep], "later": later[keep]})

    return run


PIECES = "k long, w1 long, w2 long, doc long, pos long, n int, block binary, later boolean"


def _open_pieces(span: Span, hot):
    """What open runs have to be compared by, dealt by anchor: bytes of a run's
    block; or, for hot anchors, a row per window, dealt by its name."""

    def windows(first: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        w1, w2, doc, pos = first
        later = after_first(w1, w2, doc, pos, span)
        k = np.where(later, spread(doc, pos), w1)
        for lo in range(0, len(k), OUT):
            s = slice(lo, lo + OUT)
            m = len(k[s])
            yield batch_of({"k": k[s], "w1": w1[s], "w2": w2[s], "doc": doc[s], "pos": pos[s], "n": np.ones(m, np.int32), "block": pa.nulls(m, pa.binary()), "later": later[s]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            size = batch.column("n").to_numpy()
            offsets = np.concatenate(([0], np.cumsum(size)))
            doc, sub = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "sub"))
            lists = batch.column("runs")
            at, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            for i, j in groups(offsets):
                piece = np.frombuffer(b"".join(unpacked(batch.column("z").slice(i, j - i), size[i:j])), np.uint8)
                bounds = offsets[i : j + 1] - offsets[i]
                tok1, tok2, tok_at = tokens_of(piece, bounds, span.unit)
                packed = values[at[i] : at[j]]
                if not len(packed):
                    continue
                text = np.repeat(np.arange(j - i), np.diff(at[i : j + 1]))
                start, count = packed >> 20, packed & 0xFFFFF
                a = np.zeros(len(packed), dtype=np.int64)
                where = tok_at[text] + start
                for lo in range(0, len(packed), 4096):
                    s = slice(lo, lo + 4096)
                    first, last = int(where[s].min()), int(where[s].max()) + span.length
                    inner = np.arange(span.length - span.gram + 1)
                    grams = Rolling(tok1[first:last], 0).at((where[s] - first)[:, None] + inner, span.gram)
                    a[s] = grams[np.arange(len(grams)), (grams >> U(21)).argmin(axis=1)].view(np.int64)
                by_window = is_in(a, hot.value)
                begin_at, end_at = word_edges(piece, bounds) if span.unit == "word" else (None, None)
                m = np.flatnonzero(~by_window)
                for lo in range(0, len(m), OUT // 8):
                    s = m[lo : lo + OUT // 8]
                    x, y = where[s], where[s] + count[s] + span.length - 2
                    edges = (x, y + 1) if span.unit == "byte" else (begin_at[x], end_at[y])
                    blocks = pa.array([piece[x:y].tobytes() for x, y in zip(*(e.tolist() for e in edges), strict=True)], pa.binary())
                    d = doc[i + text[s]]
                    none = np.zeros(len(s), np.int64)
                    yield batch_of({"k": a[s], "w1": none, "w2": none, "doc": d, "pos": (sub[i + text[s]] << START_BITS) + start[s], "n": count[s].astype(np.int32), "block": blocks, "later": np.zeros(len(s), bool)})
                m = np.flatnonzero(by_window)
                for lo in range(0, len(m), 4096):
                    s = m[lo : lo + 4096]
                    t, begin = np.repeat(text[s], count[s]), expand(start[s], count[s])
                    where = tok_at[t] + begin
                    first, last = int(where.min()), int(where.max()) + span.length
                    names = [Rolling(tok[first:last], q).at(where - first, span.length).view(np.int64) for q, tok in enumerate((tok1, tok2))]
                    held.append([*names, doc[i + t], (sub[i + t] << START_BITS) + begin])
                    if sum(len(x[0]) for x in held) >= ROWS:
                        yield from windows([np.concatenate(x) for x in zip(*held, strict=True)])
                        held.clear()
        if held:
            yield from windows([np.concatenate(x) for x in zip(*held, strict=True)])

    return run


def expand(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of every run, one after another."""
    return np.repeat(start - np.cumsum(count) + count, count) + np.arange(int(count.sum()))


def _settle(span: Span):
    """(doc, pos, length) of what is covered, of pieces sorted by k: in a bucket of
    blocks that share an anchor, and among rows of single windows, the windows
    that stand earlier."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_keys(batches, ROWS // 32):
            if not batch.num_rows:
                continue
            w1, w2, doc, pos, n, later = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("w1", "w2", "doc", "pos", "n", "later"))
            has = np.asarray(batch.column("block").is_valid())
            single = np.flatnonzero(~has)
            told = later[single].copy()
            open_ = np.flatnonzero(~told)
            r = single[open_]
            told[open_] = after_first(w1[r], w2[r], doc[r], pos[r], span)
            r = single[told]
            if len(r):
                yield batch_of({"doc": doc[r], "pos": pos[r], "length": np.full(len(r), span.length, np.int32)})
            r = np.flatnonzero(has)
            if not len(r):
                continue
            raw, at = texts(batch.column("block").take(pa.array(r)))
            *tokens, at = tokens_of(raw, at, span.unit)
            run_of = np.repeat(np.arange(len(r)), n[r])
            start = expand(at[:-1], n[r].astype(np.int64))
            names = [Rolling(tok, q).at(start, span.length).view(np.int64) for q, tok in enumerate(tokens)]
            place = pos[r][run_of] + start - at[run_of]
            hit = np.flatnonzero(after_first(*names, doc[r][run_of], place, span))
            if not len(hit):
                continue
            begins = np.ones(len(hit), dtype=bool)
            begins[1:] = (hit[1:] != hit[:-1] + 1) | (run_of[hit[1:]] != run_of[hit[:-1]])
            b = np.flatnonzero(begins)
            length = np.diff(np.append(b, len(hit))) + span.length - 1
            yield batch_of({"doc": doc[r][run_of[hit[b]]], "pos": place[hit[b]], "length": length.astype(np.int32)})

    return run


def text_key() -> Column:
    """Tells apart different texts under one doc_id."""
    return F.xxhash64("text").bitwiseAND(F.lit((1 << 63 - START_BITS) - 1))


def order_key() -> Column:
    """doc_id; null ids stand behind all others (below 2**62), by a hash of the text."""
    return F.coalesce(F.col("doc_id").cast("long"), F.shiftrightunsigned(F.xxhash64(F.lit(29), "text"), 2).bitwiseOR(F.lit(1 << 62)))


def keyed(documents: DataFrame) -> DataFrame:
    """text with its key: doc (see order_key) and sub, which tells apart different
    texts under one doc_id."""
    return documents.select(order_key().alias("doc"), text_key().alias("sub"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def packed_texts(documents: DataFrame) -> DataFrame:
    """doc, sub, doc_id, n (bytes) and z, the text in zstd: it is what a shuffle of
    whole texts moves, at about half its size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                raw, offsets = texts(part.column("text"))
                whole = raw.tobytes()
                z = [pa.compress(whole[x:y], codec="zstd", asbytes=True) for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc", "sub", "doc_id")), pa.array(np.diff(offsets)), pa.array(z, pa.binary())], names=["doc", "sub", "doc_id", "n", "z"])

    columns = (order_key().alias("doc"), text_key().alias("sub"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return documents.select(*columns).mapInArrow(run, "doc long, sub long, doc_id long, n long, z binary")


def unpacked(z: pa.Array, n: np.ndarray) -> list[bytes]:
    return [pa.decompress(x.as_buffer(), decompressed_size=int(m), codec="zstd", asbytes=True) if m else b"" for x, m in zip(z, n, strict=True)]


def hot_anchors(scanned: DataFrame, span: Span) -> np.ndarray:
    """Anchors that hold over 1e-5 of the runs (so at most 100,000 of them) in a
    sample of documents. They are dealt out finer; which ones are found changes
    the balance of the tasks and nothing else."""
    part = scanned.where(F.pmod(F.xxhash64(F.lit(5), "doc", "sub"), F.lit(SAMPLE)) == 0)
    counts = cut(part.mapInArrow(_sample(span), "a long, c long").groupBy("a").agg(F.sum("c").alias("c")).where(f"c >= {HOT}"))
    total = counts.agg(F.sum("c")).first()[0] or 0
    rows = counts.where(F.col("c") > total * 1e-5).select("a").toArrow()
    return np.sort(rows.column("a").to_numpy())


def covered_spans(documents: DataFrame, span: Span) -> DataFrame:
    """Per (doc, sub) with something covered: ``spans``, the sorted starts and
    lengths (start << 20 | length) of covered stretches, which may overlap."""
    sc = documents.sparkSession.sparkContext
    scanned = keyed(documents).where(F.octet_length("text") >= span.length)
    hot = sc.broadcast(hot_anchors(scanned, span))
    runs = scanned.mapInArrow(_scan(span, hot), ROW).repartition("k").sortWithinPartitions("k")
    told = stored(runs.mapInArrow(_judge(span), "doc long, pos long, n int, later boolean"))
    open_runs = _lists(told.where("not later").select("doc", "pos", F.col("n").alias("length")), "runs")
    with_runs = packed_texts(documents).join(open_runs, ["doc", "sub"])
    pieces = with_runs.mapInArrow(_open_pieces(span, hot), PIECES)
    hit = pieces.repartition("k").sortWithinPartitions("k").mapInArrow(_settle(span), "doc long, pos long, length int")
    spans = told.where("later").select("doc", "pos", (F.col("n") + (span.length - 1)).alias("length"))
    return _lists(spans.unionByName(hit), "spans")


def _lists(rows: DataFrame, out: str) -> DataFrame:
    start = F.col("pos").bitwiseAND(F.lit((1 << START_BITS) - 1))
    packed = F.shiftleft(start, 20).bitwiseOR(F.col("length").cast("long"))
    return rows.groupBy("doc", F.shiftright("pos", START_BITS).alias("sub")).agg(F.sort_array(F.collect_list(packed)).alias(out))


def merged(packed: np.ndarray | None) -> list[tuple[int, int]]:
    """Disjoint, non-touching (start, end) from sorted packed spans."""
    if packed is None or not len(packed):
        return []
    start = packed >> 20
    end = np.maximum.accumulate(start + (packed & 0xFFFFF))
    cuts = np.flatnonzero(start[1:] > end[:-1]) + 1
    return list(zip(start[np.concatenate(([0], cuts))].tolist(), end[np.concatenate((cuts - 1, [len(end) - 1]))].tolist(), strict=True))
