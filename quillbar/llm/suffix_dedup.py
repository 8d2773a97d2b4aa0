"""Suffix dedup over UTF-8 bytes, blockwise.

Suffixes are dealt into buckets by a leading sample: two suffixes that share
``length`` bytes share the sample at the same distance, and one bucket is worked
on at a time, in as many tasks as there are partitions. Ties that the leading
sample leaves are resolved by names ("ranks") of longer blocks that were made
beforehand, one name per sampled position and not per byte, so that memory is
bounded by a piece of text plus its samples. Only suffixes whose block name does
not settle them are named on their own.

The sample positions are winnowed rather than fixed residues modulo the period
of a difference cover: residues line up within one text, but equal strings of
two documents start at unrelated residues, and each suffix would have to enter
one bucket per residue of the cover (seven for period 32, 0.22 sampled positions
per byte against 0.024 here). See the README.

Null text: no bytes. Null doc_id: behind all others (ids are below 2**62), by a hash of
the text. Rows that repeat a doc_id
with another text are ordered by a hash of the text; identical rows count as one.
Texts under ``length`` bytes: nothing to remove.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .repeats import Span, covered_spans, merged, packed_texts, unpacked


def suffix_dedup(documents: DataFrame, length: int = 100, gram: int = 20) -> DataFrame:
    """Each document without the bytes covered by ``length``-byte strings that
    also start earlier: doc_id, n_bytes, n_removed, n_spans, kept (binary),
    kept_sha256."""
    lists = covered_spans(documents, Span("byte", length, gram, True))
    source = packed_texts(documents).join(lists, ["doc", "sub"], "left")
    return source.mapInArrow(_remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 64):
            part = batch.slice(lo, 64)
            total, gone, runs, kept, digests = [], [], [], [], []
            lists = part.column("spans")
            for i, raw in enumerate(unpacked(part.column("z"), part.column("n").to_numpy())):
                n, body = len(raw), raw
                spans = merged(lists[i].values.to_numpy()) if lists[i].is_valid else []
                if spans:
                    edges = np.concatenate(([0], np.array(spans).ravel(), [n])).tolist()
                    body = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                total.append(n)
                gone.append(n - len(body))
                runs.append(len(spans))
                kept.append(body)
                digests.append(hashlib.sha256(body).hexdigest())
            ids = part.column("doc_id").cast(pa.int64())
            numbers = [pa.array(x, pa.int64()) for x in (total, gone, runs)]
            yield pa.RecordBatch.from_arrays([ids, *numbers, pa.array(kept, pa.binary()), pa.array(digests, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])
