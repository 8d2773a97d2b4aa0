"""Rows ready for a chart; drawing is the caller's."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import chunks
from ..functions.chunks import CHUNK, LATER, ROLE
from ..functions.kernels import DATE, SYMBOL, by_date, within
from ..sources.bars import stored
from .labels import LONG, SHORT

# Names and colours of the signals' and labels' spans.
SIGNAL_STYLES = {
    "signal_macd": ("MACD Golden Cross", "#f94144"),
    "signal_kdj": ("KDJ Golden Cross", "#577590"),
    "signal_ema": ("EMA Bullish Break", "#f3722c"),
    "signal_sar": ("SAR Flip", "#43aa8b"),
    "signal_dmi": ("DMI Cross", "#90be6d"),
    "signal_adtm": ("ADTM Break", "#f9c74f"),
    "signal_ddi": ("DDI Positive", "#277da1"),
    "signal_dpo": ("DPO Positive", "#7209b7"),
    "signal_osc": ("OSC Cross", "#ff9f1c"),
    "signal_srmi": ("SRMI Positive", "#2ec4b6"),
}
WIN, LOSS = "#ffaaaa", "#90ee90"


def candles(bars: DataFrame, every: int = 10, last: bool = True) -> DataFrame:
    """x (place in the symbol), colour, body_low, body_height (at least 1e-10) and
    whether x carries a tick: every max(n // every, 1) rows and, if ``last``, the
    last one."""
    n = F.count("*").over(Window.partitionBy(SYMBOL))
    rows = bars.withColumns({"x": (F.row_number().over(by_date()) - 1).cast("long"), "_n": n})
    pace = F.greatest(F.floor(F.col("_n") / every), F.lit(1))
    tick = F.col("x") % pace == 0
    if last:
        tick = tick | (F.col("x") == F.col("_n") - 1)
    return rows.select(
        *bars.columns,
        "x",
        F.when(F.col("close") >= F.col("open"), "red").otherwise("green").alias("colour"),
        F.least("open", "close").alias("body_low"),
        F.greatest(F.abs(F.col("close") - F.col("open")), F.lit(1e-10)).alias("body_height"),
        tick.alias("tick"),
    )


def places(df: DataFrame, size: int | None = None) -> DataFrame:
    """``df`` with x, the row's place in its symbol from 0: numbered within chunks of
    ``size`` rows, whose counts (a row per chunk) give the offsets."""
    placed, _ = chunks.dealt(stored(df), size=size)
    with within(SYMBOL, CHUNK):
        placed = placed.withColumn("_at", F.row_number().over(by_date()) - 1)
    counts = placed.groupBy(F.col(SYMBOL).alias("_s"), F.col(CHUNK).alias("_c")).agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_s").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_s", "_c", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    same = placed[SYMBOL].eqNullSafe(counts["_s"]) & (placed[CHUNK] == counts["_c"])
    return placed.join(counts, same).withColumn("x", (F.col("_at") + F.col("_before")).cast("long")).drop("_at", "_before", "_s", "_c", CHUNK, ROLE, LATER)


def spans(df: DataFrame, kinds: dict[str, Column]) -> DataFrame:
    """symbol, kind, from_x, to_x: the maximal stretches of neighbouring x where a kind
    is true, half a bar wider on both sides. Null counts as false."""
    long = df.select(SYMBOL, "x", *[c.alias(k) for k, c in kinds.items()]).unpivot([SYMBOL, "x"], list(kinds), "kind", "_on").where("_on")
    island = F.col("x") - F.row_number().over(Window.partitionBy(SYMBOL, "kind").orderBy("x"))
    runs = long.withColumn("_run", island).groupBy(SYMBOL, "kind", "_run")
    return runs.agg((F.min("x") - 0.5).alias("from_x"), (F.max("x") + 0.5).alias("to_x")).drop("_run")


def signal_spans(found: DataFrame, lines: Sequence[str], size: int | None = None) -> DataFrame:
    """symbol, signal, caption, colour, from_x, to_x of every signal that ``found`` has.
    Rows that lack a price or one of the ``lines`` are not drawn and have no place."""
    shown = found.na.drop(subset=[*lines, "open", "high", "low", "close"])
    names = [n for n in SIGNAL_STYLES if n in found.columns]
    made = spans(places(shown.select(SYMBOL, DATE, *names), size), {n: F.col(n) for n in names})
    styles = found.sparkSession.createDataFrame([(n, *SIGNAL_STYLES[n]) for n in names], "kind string, caption string, colour string")
    return made.join(F.broadcast(styles), "kind").select(SYMBOL, F.col("kind").alias("signal"), "caption", "colour", "from_x", "to_x")  # a literal table


def label_spans(labelled: DataFrame, size: int | None = None) -> DataFrame:
    """symbol, horizon, label, colour, from_x, to_x: stretches of wins and of losses."""
    kinds = {f"{h}{v:+d}": F.col(f"{h}_label") == v for h in ("long", "short") for v in (1, -1)}
    made = spans(places(labelled.select(SYMBOL, DATE, "long_label", "short_label"), size), kinds)
    label = F.when(F.col("kind").endswith("+1"), 1).otherwise(-1)
    return made.select(SYMBOL, F.regexp_extract("kind", "[a-z]+", 0).alias("horizon"), label.alias("label"), F.when(label == 1, WIN).otherwise(LOSS).alias("colour"), "from_x", "to_x")


def barrier_lines(bars: DataFrame, size: int | None = None) -> DataFrame:
    """symbol, dt, x, horizon, stop_loss, take_profit about the open, and atr: two rows
    per row of bars with ``atr``."""
    of = lambda name, b: F.struct(F.lit(name).alias("horizon"), (F.col("open") - b.loss * F.col("atr")).alias("stop_loss"), (F.col("open") + b.gain * F.col("atr")).alias("take_profit"))
    placed = places(bars.select(SYMBOL, DATE, "open", "atr"), size)
    return placed.select(SYMBOL, DATE, "x", "atr", F.inline(F.array(of("long", LONG), of("short", SHORT))))
