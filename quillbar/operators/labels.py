"""First-touch labels: -1 stop loss, 1 take profit, 0 neither in time.

A row's path is a range frame over day numbers, at most as many rows as the
horizon has days; there is no self-join. On one bar the stop loss comes first.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.kernels import DATE, SYMBOL, following


@dataclass(frozen=True)
class Barrier:
    """Calendar days, and multiples of the average true range."""

    days: int
    loss: float
    gain: float


LONG = Barrier(15, 2.0, 3.0)
SHORT = Barrier(5, 1.0, 1.5)


def path(days: int) -> Column:
    """(high, low) of the bars from this one up to ``days`` calendar days on."""
    frame = Window.partitionBy(SYMBOL).orderBy(F.unix_date(DATE)).rangeBetween(0, days)
    return F.collect_list(F.struct(F.unix_date(DATE).alias("n"), "high", "low")).over(frame)


def touched(bars: Column, price: Column, atr: Column, rule: Barrier) -> Column:
    """The first barrier that a bar touches; null without price or range."""
    loss, gain = price - rule.loss * atr, price + rule.gain * atr
    hits = F.filter(F.array_sort(bars), lambda x: (x["low"] <= loss) | (x["high"] >= gain))
    hit = F.get(hits, F.lit(0))
    found = F.when(hit.isNull(), 0.0).when(hit["low"] <= loss, -1.0).otherwise(1.0)
    return F.when(price.isNotNull() & atr.isNotNull(), found)


def evaluate_trade(df: DataFrame, price: Column, atr: Column, rule: Barrier, out: str) -> DataFrame:
    """The outcome of entering at ``price`` on every row: its own bar is the first of
    the path and the horizon counts from its date. Null only without price or range."""
    return df.withColumn("_path", path(rule.days)).withColumn(out, touched(F.col("_path"), price, atr, rule)).drop("_path")


def label_open(df: DataFrame, rule: Barrier, out: str) -> DataFrame:
    """Entry at the open, its own bar included. Null if no later bar lies within
    the horizon. Needs ``atr``."""
    with_path = df.withColumn("_path", path(rule.days))
    label = F.when(F.size("_path") > 1, touched(F.col("_path"), F.col("open"), F.col("atr"), rule))
    return with_path.withColumn(out, label).drop("_path")


def label_worst(df: DataFrame, rule: Barrier = LONG, out: str = "label") -> DataFrame:
    """The worse of entering at this close or at the next open; both walk from the
    next bar on, and the horizon counts from it. Null on a symbol's last row."""
    with_path = df.withColumn("_path", path(rule.days))
    ahead = with_path.withColumns({"_next": following("_path"), "_open": following("open"), "_atr": following("atr")})
    at_close = touched(F.col("_next"), F.col("close"), F.col("atr"), rule)
    at_open = touched(F.col("_next"), F.col("_open"), F.col("_atr"), rule)
    label = F.when(F.col("_next").isNotNull(), F.least(at_close, at_open))
    return ahead.withColumn(out, label).drop("_path", "_next", "_open", "_atr")


def binary(label: str = "label") -> Column:
    """1 for a take profit, else 0; a row without a label counts as 0."""
    return F.when(F.col(label) == 1, 1).otherwise(0)


def multiclass(label: str = "label") -> Column:
    """-1, 0, 1 become 0, 1, 2; null stays."""
    return (F.col(label) + 1).cast("int")


def trade_labels(df: DataFrame) -> DataFrame:
    """long_label and short_label of bars with ``atr``."""
    return label_open(label_open(df, LONG, "long_label"), SHORT, "short_label")


def check_tail(labelled: DataFrame, plot_end: date, labels: tuple[str, ...] = ("long_label", "short_label")) -> DataFrame:
    """Rows up to ``plot_end``; an error unless the last row with all labels
    reaches it (so it fails when plot_end has no bar)."""
    shown = labelled.where(F.col(DATE) <= F.lit(plot_end))
    last = shown.na.drop(subset=list(labels)).agg(F.max(DATE)).first()[0]
    if last is None or last < plot_end:
        raise ValueError(f"labels end on {last}, before {plot_end}")
    return shown


def label_summary(df: DataFrame, labels: tuple[str, ...] = ("long_label", "short_label")) -> DataFrame:
    """symbol, horizon, label, n; rows without a label are not counted."""
    long = df.unpivot(SYMBOL, list(labels), "horizon", "label").where("label is not null")
    return long.groupBy(SYMBOL, "horizon", F.col("label").cast("int").alias("label")).agg(F.count("*").alias("n"))
