"""Cutting a long history into chunks of time, with a halo of the rows before.

A chunk is a stretch of whole time buckets of about ``size`` rows. Window frames that
look back over at most ``reach`` rows give the same values inside a chunk as in the
whole history, if the chunk's own rows come with at least that many rows from before: its halo, copied from
the neighbours. So a history of any length is dealt over many tasks, and the largest
holds a chunk and its halo.

The halo has two parts. In its ``warm`` part columns that windows made are right, so
that a recurrence may run over it; its ``cold`` part is there for these windows only.
Chunks are planned from the number of rows per bucket: a row per bucket, never a row
per bar.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.bars import stored
from .kernels import DATE, SYMBOL

CHUNK, ROLE, LATER, BUCKET = "_chunk", "_role", "_later", "_bucket"
COLD, WARM, OWN = 0, 1, 2

#: Rows a chunk has at least, but for the last of a history.
ROWS = 8192

#: A plan of at most so many rows (of a key, a date and three numbers) is broadcast.
PLAN_ROWS = 200_000


def bucket_of(df: DataFrame) -> Column:
    """Months of dates, days of times."""
    daily = isinstance(df.schema[DATE].dataType, T.DateType)
    return F.trunc(DATE, "month") if daily else F.date_trunc("day", DATE)


def cuts(counts: Sequence[int], size: int, cold: int, warm: int) -> list[tuple[int, int, int, bool]]:
    """(bucket, chunk, role, later) of buckets of ``counts`` rows, in order. ``later``:
    the bucket is in the warm part of the next chunk, too, or behind it."""

    def back(at: int, rows: int) -> int:
        while at > 0 and rows > 0:
            at -= 1
            rows -= counts[at]
        return at

    starts, held = [0], 0
    for k, n in enumerate(counts):
        if held >= size:
            starts.append(k)
            held = 0
        held += n
    firsts = [back(s, warm) for s in starts] + [len(counts)]
    out = []
    for chunk, (start, end) in enumerate(zip(starts, [*starts[1:], len(counts)], strict=True)):
        first = firsts[chunk]
        for k in range(back(first, cold), end):
            out.append((k, chunk, COLD if k < first else WARM if k < start else OWN, k >= firsts[chunk + 1]))
    return out


def plan(df: DataFrame, keys: tuple[str, ...], size: int, cold: int, warm: int, bucket: Column) -> DataFrame:
    """keys, _bucket, _chunk, _role, _later: where the rows of a bucket go."""
    counts = df.groupBy(*keys, bucket.alias(BUCKET)).agg(F.count("*").alias("n"))
    fields = [counts.schema[c] for c in (*keys, BUCKET)]
    schema = T.StructType([*fields, T.StructField(CHUNK, T.LongType()), T.StructField(ROLE, T.IntegerType()), T.StructField(LATER, T.BooleanType())])

    def each(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(BUCKET, na_position="first", ignore_index=True)  # as a window's order has it
        found = cuts(rows["n"].tolist(), size, cold, warm)
        out = rows.loc[[k for k, *_ in found], [*keys, BUCKET]].reset_index(drop=True)
        return out.assign(**{CHUNK: [x[1] for x in found], ROLE: [x[2] for x in found], LATER: [x[3] for x in found]})

    return counts.groupBy(*keys).applyInPandas(each, schema)


def dealt(df: DataFrame, keys: tuple[str, ...] = (SYMBOL,), size: int | None = None, cold: int = 0, warm: int = 0, bucket: Column | None = None) -> tuple[DataFrame, int]:
    """``df`` with _chunk, _role and _later, halo rows copied in and dealt by keys and
    chunk; and the number of chunks of the longest history. df is read twice."""
    bucket = bucket_of(df) if bucket is None else bucket
    ways = stored(plan(df, keys, size or ROWS, cold, warm, bucket))
    one = F.countDistinct(F.struct(*keys, CHUNK))
    rows, chunks, most = ways.agg(F.count("*"), one, F.coalesce(F.max(CHUNK), F.lit(-1)) + 1).first()
    placed = df.withColumn(BUCKET, bucket)
    side = ways.withColumnsRenamed({k: f"_key_{k}" for k in keys} | {BUCKET: "_key_bucket"})
    side = F.broadcast(side) if rows <= PLAN_ROWS else side
    same = placed[BUCKET].eqNullSafe(side["_key_bucket"])
    for k in keys:
        same = same & placed[k].eqNullSafe(side[f"_key_{k}"])
    placed = placed.join(side, same).select(*[placed[c] for c in df.columns], CHUNK, ROLE, LATER)
    tasks = min(chunks, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return placed.repartition(max(1, tasks), *keys, CHUNK), most
