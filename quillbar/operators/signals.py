"""Boolean buy signals over indicator columns; never null.

The stop and the stochastic signal stay false by construction: the stop never
passes a low, and the stochastic is never below zero. They are kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import by_date, crossed_up, prev, runs, turns_positive, yes
from .indicators import Params, indicators

#: The indicator families each signal reads.
NEEDS = {
    "macd": ("macd",),
    "kdj": ("kdj",),
    "ema": ("ema",),
    "sar": ("sar",),
    "dmi": ("dmi",),
    "adtm": ("adtm",),
    "ddi": ("ddi",),
    "dpo": ("dpo",),
    "osc": ("osc",),
    "srmi": ("srmi",),
}
SIGNALS = tuple(f"signal_{k}" for k in NEEDS)


def rules() -> dict[str, Column]:
    c, o = F.col("close"), F.col("open")
    return {
        "macd": crossed_up("macd_dif", "macd_dea") & yes(F.col("macd_hist") > 0),
        "kdj": crossed_up("kdj_k", "kdj_d") & yes(F.col("kdj_k") <= 70),
        "ema": yes((F.col("ema_20") > F.col("ema_60")) & (c > o) & (c >= F.col("ema_20")) & (o <= F.col("ema_20")) & (prev("close") <= prev("ema_20"))),
        "sar": yes((prev("sar") > F.greatest(prev("open"), prev("close"))) & (F.col("sar") <= F.least("open", "close"))),
        "dmi": crossed_up("pdi", "mdi") | crossed_up("adx", "adxr"),
        "adtm": crossed_up("adtm", "adtmma") & yes(F.col("adtm") < 0.5),
        "ddi": turns_positive("ddi"),
        "dpo": turns_positive("dpo"),
        "osc": crossed_up("osc", "osc_signal"),
        "srmi": turns_positive("srmi"),
    }


def signals(bars: DataFrame, which: Iterable[str] = tuple(NEEDS), params: Params | None = None) -> DataFrame:
    """``bars`` with the indicators that are needed and a column per signal. The
    rules read the default column names; params may change their periods."""
    which = list(which)
    needed = list(dict.fromkeys(f for k in which for f in NEEDS[k]))
    every = rules()
    return indicators(bars, needed, params).withColumns({f"signal_{k}": every[k] for k in which})


def valid_for(df: DataFrame, signal: str, rows: int = 3) -> DataFrame:
    """The signal kept alive for ``rows`` rows, its own included."""
    frame = by_date().rowsBetween(-(rows - 1), 0)
    return df.withColumn(f"{signal}_valid", F.bool_or(signal).over(frame))


def segments(df: DataFrame, signal: str) -> DataFrame:
    """Stretches of consecutive rows with the signal."""
    return runs(df, signal)


def counts(df: DataFrame, names: Iterable[str] = SIGNALS) -> DataFrame:
    """symbol, signal, n: how often each signal fires; 0 where it never does."""
    wide = df.groupBy("symbol").agg(*[F.count_if(n).alias(n) for n in names])
    return wide.unpivot("symbol", list(names), "signal", "n")
