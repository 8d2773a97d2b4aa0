"""Exits of trades: half out at a target, the rest behind a stop that only rises.

A trade is entered at a row's close, in an upward trend only (a fast average of closes above
a slow one), and looks at the bars after it. Before the target is
reached it ends whole at ``price - loss * atr``. On the bar that reaches
``price + gain * atr`` half is sold; from the next bar on the rest ends at the highest of
the first stop, the highest price since the entry less ``trail * atr`` (the entry's range)
and every fast average since the half was sold, all of bars before. On one bar the stop
comes before the target. Exits are at the level that was touched.

No trade walks its path. A stretch of bars is summed up by its lowest low, highest high,
highest average, the deepest fall from a high to a later low and from an average to a later
low; that tells whether a trade ends or turns inside it. Summaries merge, so each trade
finds its bar in as many steps as the number of bars has binary digits, all trades of a chunk
together. Trades still open at a chunk's end jump over whole chunks by the chunks' own
summaries, and go on in the one that may end them: a few rounds, however long they are open.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import chunks
from ..functions.chunks import CHUNK, OWN, ROLE
from ..functions.kernels import DATE, SYMBOL, mean, ratio, within
from ..sources.bars import stored


@dataclass(frozen=True)
class Rule:
    """Multiples of the average true range on the day of entry, rows of the two averages.
    Averages and ranges are rounded to ``digits``, so that ties do not hang on rounding."""

    loss: float = 2.0
    gain: float = 3.0
    trail: float = 2.0
    fast: int = 20
    slow: int = 60
    digits: int = 6


class Stretch(NamedTuple):
    """Of stretches of bars; ``fall`` from a high and ``under`` an average to a later low."""

    low: np.ndarray
    high: np.ndarray
    mean: np.ndarray
    fall: np.ndarray
    under: np.ndarray

    def part(self, at: np.ndarray | slice) -> Stretch:
        return Stretch(*[x[at] for x in self])


def joined(a: Stretch, b: Stretch) -> Stretch:
    """Of each stretch of ``a`` and the one of ``b`` that follows it."""
    fall = np.maximum(np.maximum(a.fall, b.fall), a.high - b.low)
    under = np.maximum(np.maximum(a.under, b.under), a.mean - b.low)
    return Stretch(np.minimum(a.low, b.low), np.maximum(a.high, b.high), np.maximum(a.mean, b.mean), fall, under)


def of_bars(bars: pd.DataFrame) -> Stretch:
    """Single bars; a missing price touches nothing."""
    low, high, mean = (bars[c].to_numpy(dtype=np.float64, copy=True) for c in ("low", "high", "mean"))
    low[np.isnan(low)] = np.inf
    high[np.isnan(high)] = -np.inf
    mean[np.isnan(mean)] = -np.inf
    never = np.full(len(low), -np.inf)
    return Stretch(low, high, mean, never, never)


class Ladder:
    """Stretches of 1, 2, 4, ... items from every item on."""

    def __init__(self, items: Stretch):
        self.n, self.levels, size = len(items.low), [items], 1
        while 2 * size <= self.n:
            last = self.levels[-1]
            self.levels.append(joined(last.part(slice(None, -size)), last.part(slice(size, None))))
            size *= 2

    def whole(self) -> Stretch:
        """One stretch of all items."""
        done, at = None, 0
        for k in reversed(range(len(self.levels))):
            if at + (1 << k) <= self.n:
                next_one = self.levels[k].part(slice(at, at + 1))
                done = next_one if done is None else joined(done, next_one)
                at += 1 << k
        return done

    def reach(self, trades: pd.DataFrame, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The first item from ``at`` on in which each trade may end or turn (or the number
        of items), and top and floor before it."""
        stop, target, gap, half, top, floor = (trades[c].to_numpy() for c in ("stop", "target", "gap", "half", "top", "floor"))
        slack = 1e-9 * np.maximum(1.0, np.abs(target))  # differences are rounded; single items decide
        moved = self.n > 0 and len(at) > 0
        while moved:
            before = at
            for k in reversed(range(len(self.levels))):
                fits = at + (1 << k) <= self.n
                s = self.levels[k].part(np.where(fits, at, 0))
                turns = (s.low <= stop) | (s.high >= target)
                ends = (s.low <= np.maximum(top - gap, floor)) | (s.fall >= gap - slack) | (s.under >= 0)
                go = fits & ~np.where(half, ends, turns)
                top = np.where(go, np.maximum(top, s.high), top)
                floor = np.where(go & half, np.maximum(floor, s.mean), floor)
                at = np.where(go, at + (1 << k), at)
            moved = bool((at > before).any())
        return at, top, floor


def walk(bars: pd.DataFrame, trades: pd.DataFrame, at: np.ndarray) -> pd.DataFrame:
    """``trades`` as they stand after ``bars`` (one chunk, in order) from bar ``at`` on."""
    items = of_bars(bars)
    ladder, dates = Ladder(items), bars[DATE].to_numpy(dtype=object)
    trades = trades.reset_index(drop=True)

    def move(rows: np.ndarray) -> np.ndarray:
        if len(rows):
            at[rows], top, floor = ladder.reach(trades.loc[rows], at[rows])
            trades.loc[rows, "top"], trades.loc[rows, "floor"] = top, floor
        return rows[at[rows] < len(bars)]

    hit = move(np.flatnonzero(~trades["half"].to_numpy()))
    stopped = items.low[at[hit]] <= trades["stop"].to_numpy()[hit]
    out, half = hit[stopped], hit[~stopped]
    trades.loc[out, "exit_dt"], trades.loc[out, "reason"], trades.loc[out, "level"] = dates[at[out]], "stop", trades.loc[out, "stop"]
    trades.loc[half, "half"], trades.loc[half, "half_dt"] = True, dates[at[half]]
    trades.loc[half, "top"] = np.maximum(trades["top"].to_numpy()[half], items.high[at[half]])
    trades.loc[half, "floor"] = np.maximum(trades["floor"].to_numpy()[half], items.mean[at[half]])
    at[half] += 1

    out = move(np.flatnonzero(trades["half"].to_numpy()))
    level = np.maximum(trades["top"] - trades["gap"], trades["floor"]).to_numpy()[out]
    trades.loc[out, "exit_dt"], trades.loc[out, "reason"], trades.loc[out, "level"] = dates[at[out]], "trail", level
    return trades


def _schema(df: DataFrame) -> T.StructType:
    date = df.schema[DATE].dataType
    double, kinds = T.DoubleType(), {"half": T.BooleanType(), "half_dt": date, "exit_dt": date, "reason": T.StringType()}
    rest = ("price", "stop", "target", "gap", "top", "floor", "half", "half_dt", "exit_dt", "reason", "level")
    fields = [df.schema[SYMBOL], df.schema[DATE], T.StructField(CHUNK, T.LongType()), *[T.StructField(c, kinds.get(c, double)) for c in rest]]
    return T.StructType(fields)


def _entered(rule: Rule, columns: list[str]):
    """Trades entered in a chunk, as they stand at its end."""

    def run(bars: pd.DataFrame) -> pd.DataFrame:
        bars = bars.sort_values(DATE, ignore_index=True)
        rows = np.flatnonzero((bars["price"].notna() & bars["atr"].notna()).to_numpy())
        new = bars.loc[rows, [SYMBOL, DATE, CHUNK, "price"]]
        price, atr = bars["price"].to_numpy()[rows], bars["atr"].to_numpy()[rows]
        new = new.assign(stop=price - rule.loss * atr, target=price + rule.gain * atr, gap=rule.trail * atr, top=price, floor=price - rule.loss * atr, half=False).astype({"half": bool})
        empty = pd.Series([None] * len(new), index=new.index, dtype=object)
        new = new.assign(half_dt=empty, exit_dt=empty, reason=empty, level=np.nan)
        return walk(bars, new, rows + 1)[columns]

    return run


def _carried(columns: list[str]):
    """Trades from earlier chunks, as they stand at the end of this one."""

    def run(trades: pd.DataFrame, bars: pd.DataFrame) -> pd.DataFrame:
        trades = trades.astype({"half_dt": object, "exit_dt": object, "reason": object})
        return walk(bars.sort_values(DATE, ignore_index=True), trades, np.zeros(len(trades), dtype=np.int64))[columns]

    return run


def _skipped(columns: list[str]):
    """Trades put to the next chunk that may end or turn them; ``open`` where there is none."""

    def run(trades: pd.DataFrame, later: pd.DataFrame) -> pd.DataFrame:
        later = later.sort_values("to", ignore_index=True)
        trades = trades.reset_index(drop=True).astype({"reason": object})
        if not len(later):
            return trades.assign(reason="open")[columns]
        ladder = Ladder(Stretch(*[later[c].to_numpy(dtype=np.float64) for c in Stretch._fields]))
        at, top, floor = ladder.reach(trades, np.zeros(len(trades), dtype=np.int64))
        none = at == len(later)
        to = later["to"].to_numpy()[np.minimum(at, len(later) - 1)]
        trades.loc[none, "reason"] = "open"
        return trades.assign(**{CHUNK: np.where(none, trades[CHUNK], to), "top": top, "floor": floor})[columns]

    return run


def _summed(bars: pd.DataFrame) -> pd.DataFrame:
    whole = Ladder(of_bars(bars.sort_values(DATE, ignore_index=True))).whole()
    return bars[[SYMBOL, CHUNK]].head(1).assign(**{c: x for c, x in whole._asdict().items()})


def trailing_exits(df: DataFrame, signal: Column, rule: Rule | None = None, size: int | None = None) -> DataFrame:
    """symbol, dt, price, half_dt, exit_dt, reason (stop, trail or open), level, gain (of
    both halves against the price; null while open): a row per row of ``df`` where ``signal``
    is true, the trend is upward, and close and ``atr`` are there. Dates are unique within a
    symbol. Chunks have ``size`` rows or more."""
    rule = rule or Rule()
    rows = stored(df.select(SYMBOL, DATE, "high", "low", "close", F.round("atr", rule.digits).alias("atr"), signal.alias("_signal")))
    placed, most = chunks.dealt(rows, size=size, cold=rule.slow - 1)
    with within(SYMBOL, CHUNK):
        fast, slow = (F.round(mean("close", n), rule.digits) for n in (rule.fast, rule.slow))
        placed = placed.withColumns({"mean": fast, "price": F.when(F.col("_signal") & (fast > slow), F.col("close"))})
    bars = stored(placed.where(F.col(ROLE) == OWN).select(SYMBOL, DATE, CHUNK, "high", "low", "mean", "atr", "price"))
    schema = _schema(rows)
    columns = schema.fieldNames()
    now = stored(bars.groupBy(SYMBOL, CHUNK).applyInPandas(_entered(rule, columns), schema))
    ended = now.where("reason is not null")
    still = now.where("reason is null")
    if most == 1:
        ended = ended.unionByName(still.withColumn("reason", F.lit("open")))
    else:
        kept = [schema[SYMBOL], T.StructField(CHUNK, T.LongType()), *[T.StructField(c, T.DoubleType()) for c in Stretch._fields]]
        sums = stored(bars.groupBy(SYMBOL, CHUNK).applyInPandas(_summed, T.StructType(kept)))
        while not still.isEmpty():
            asked = still.select(F.col(SYMBOL).alias("_s"), F.col(CHUNK).alias("_from")).distinct()
            later = sums.join(asked, sums[SYMBOL].eqNullSafe(asked["_s"]) & (sums[CHUNK] > asked["_from"]))
            later = later.select(SYMBOL, F.col("_from").alias(CHUNK), F.col(CHUNK).alias("to"), *Stretch._fields)
            put = stored(still.groupBy(SYMBOL, CHUNK).cogroup(later.groupBy(SYMBOL, CHUNK)).applyInPandas(_skipped(columns), schema))
            ended = ended.unionByName(put.where("reason is not null"))
            put = put.where("reason is null")
            met = put.select(F.col(SYMBOL).alias("_s"), F.col(CHUNK).alias("_c")).distinct()
            needed = bars.join(met, bars[SYMBOL].eqNullSafe(met["_s"]) & (bars[CHUNK] == met["_c"]), "left_semi")
            now = stored(put.groupBy(SYMBOL, CHUNK).cogroup(needed.groupBy(SYMBOL, CHUNK)).applyInPandas(_carried(columns), schema))
            ended = ended.unionByName(now.where("reason is not null"))
            still = now.where("reason is null")
    last = ratio(F.col("level"), F.col("price")) - 1
    first = ratio(F.col("target"), F.col("price")) - 1
    gain = F.when(F.col("reason") == "stop", last).when(F.col("reason") == "trail", (first + last) / 2)
    return ended.select(SYMBOL, DATE, "price", "half_dt", "exit_dt", "reason", "level", gain.alias("gain"))


def exit_summary(exits: DataFrame) -> DataFrame:
    """symbol, reason, n, halves (trades that sold half), gain (mean)."""
    return exits.groupBy(SYMBOL, "reason").agg(F.count("*").alias("n"), F.count("half_dt").alias("halves"), F.avg("gain").alias("gain"))
