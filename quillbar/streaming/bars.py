"""Bars and exponential means over streams.

Bars are a watermarked window aggregation whose state is one row per symbol and
open window. The mean keeps one double per symbol. Sinks are written per batch
with the batch's number, so a batch that runs twice leaves the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.kernels import SYMBOL
from ..sources.bars import work_folder


def bars(ticks: DataFrame, every: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Bars of a stream of (symbol, ts, seq, price, size); rows later than ``late``
    are left out once their window has closed."""
    place = F.struct("ts", "seq")
    grouped = ticks.withWatermark("ts", late).groupBy(SYMBOL, F.window("ts", every).alias("w"))
    made = grouped.agg(
        F.min_by("price", place).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", place).alias("close"),
        F.sum("size").cast("double").alias("volume"),
    )
    return made.select(SYMBOL, F.col("w.start").cast("timestamp_ntz").alias("dt"), "open", "high", "low", "close", "volume")


def event_ticks(spark: SparkSession, path: str) -> DataFrame:
    """The stream of event files under ``path`` (a folder or a glob; a glob may also name one file)."""
    schema = spark.read.parquet(path).schema
    events = spark.readStream.schema(schema).parquet(path)
    return events.where("value is not null").select(F.col("event_type").alias(SYMBOL), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.col("value").alias("price"), F.lit(1).alias("size"))


def upsert(stream: DataFrame, folder: str) -> None:
    """Runs ``stream`` over what is there and writes each batch's updates."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/rows/n={number}")

    query = stream.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()


def latest(spark: SparkSession, folder: str, *key: str) -> DataFrame:
    """The last update of every key."""
    rows = spark.read.parquet(f"{folder}/rows")
    rest = [c for c in rows.columns if c not in (*key, "batch", "n")]
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), "batch").alias("r"))
    return last.select(*key, "r.*")


def hourly_bars_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_folder(spark, "streams")
    upsert(bars(event_ticks(spark, f"{sf_dir}/events.parque[t]"), late="40 days"), folder)
    return latest(spark, folder, SYMBOL, "dt")


def running_mean(closes: DataFrame, alpha: float) -> DataFrame:
    """symbol, dt, mean of a stream of (symbol, dt, close): one double of state per
    symbol. Rows of a batch are taken in date order; batches must not overlap."""

    def step(key: tuple[Any, ...], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        y = state.get[0] if state.exists else None
        rows = pd.concat(list(parts)).sort_values("dt")
        out = []
        for x in rows["close"]:
            if pd.notna(x):
                y = x if y is None else (1 - alpha) * y + alpha * x
            out.append(y)
        if y is not None:
            state.update((float(y),))
        yield pd.DataFrame({"symbol": key[0], "dt": rows["dt"].to_numpy(), "mean": out})

    return closes.groupBy(SYMBOL).applyInPandasWithState(step, "symbol string, dt date, mean double", "mean double", "append", GroupStateTimeout.NoTimeout)
