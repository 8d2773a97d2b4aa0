"""Substring dedup over words: seed and extend.

Seeds are winnowed anchors (12-word grams, lowest hash of each 50-word window);
documents meet where they share one, in the anchor's bucket. First the whole stretch
of windows around an anchor is compared at once, so copies are done with. Where the
stretches differ, they are brought to the bucket as text, and the seed is extended
both ways there: by l words to the left and by what the threshold then lacks to the
right, for every l that the stretch has room for. An extension that a document with a
smaller id has too is covered. Covered extensions, merged, are the maximal repeats of
at least ``length`` words. Passages that thousands of documents share never form
document pairs, and an anchor with very many different stretches is dealt by its
extensions' names instead.

Null text: no words. Null doc_id: behind every other id (ids are below 2**62), among
themselves by a hash of the text.
Rows that repeat a doc_id are one document for the rule (none is smaller). Texts
under ``length`` words: nothing to remove. Other columns are left out of the way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import Span, covered_spans, merged, packed_texts, unpacked


def maximal_repeats(documents: DataFrame, length: int = 50, gram: int = 12) -> DataFrame:
    """(doc_id, start, end): word spans, maximal and disjoint, that are covered
    by windows which also start in a document with a smaller id (null ids: null)."""
    lists = covered_spans(documents, Span("word", length, gram, False))
    spans = lists.mapInPandas(_merge, "doc long, sub long, start long, end long")
    return spans.select(F.when(F.col("doc") < 1 << 62, F.col("doc")).alias("doc_id"), "sub", "start", "end")


def _merge(frames):
    import pandas as pd

    for f in frames:
        rows = [(d, s, a, b) for d, s, x in zip(f["doc"], f["sub"], f["spans"], strict=True) for a, b in merged(np.asarray(x))]
        yield pd.DataFrame(rows, columns=["doc", "sub", "start", "end"])


def substring_dedup(documents: DataFrame, length: int = 50, gram: int = 12) -> DataFrame:
    """Each document without its repeated words: doc_id, n_words, n_removed,
    kept_text (kept words joined by one space), kept_sha256."""
    lists = covered_spans(documents, Span("word", length, gram, False))
    source = packed_texts(documents).join(lists, ["doc", "sub"], "left")
    out = source.mapInArrow(_remove, "doc_id long, n_words long, n_removed long, kept_text binary, kept_sha256 string")
    return out.withColumn("kept_text", F.col("kept_text").cast("string"))


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 64):
            part = batch.slice(lo, 64)
            total, gone, kept, digests = [], [], [], []
            lists = part.column("spans")
            for i, text in enumerate(unpacked(part.column("z"), part.column("n").to_numpy())):
                words = text.split()
                n = len(words)
                if lists[i].is_valid:
                    for a, b in reversed(merged(lists[i].values.to_numpy())):
                        del words[a:b]
                body = b" ".join(words)
                total.append(n)
                gone.append(n - len(words))
                kept.append(body)
                digests.append(hashlib.sha256(body).hexdigest())
            ids = part.column("doc_id").cast(pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()), pa.array(digests, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256"])
