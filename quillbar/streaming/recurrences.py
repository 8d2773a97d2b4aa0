"""Exponential means and the stop over a stream of bars, equal to the batch's.

A symbol's bars may come in any order up to the watermark. They wait in keyed state
until it has passed their date; a timer then releases them in date order, and all that
are due go through the same maps as a chunk of the batch does, from the states kept
so far. A row is out once, when nothing before it can still come. State is what
waits, and a few doubles per symbol.

A bar whose date has come before replaces it while it waits. Bars later than the
watermark are left out by Spark. Null numbers are gaps, as in the batch.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.kernels import DATE, SYMBOL
from ..functions.recurrences import Back, Step, Steps, Sum

DAY_MS = 86_400_000


def advance(steps: Steps, have: dict[str, np.ndarray], state: list[float]) -> tuple[dict[str, np.ndarray], list[float]]:
    """The outs of a chunk of rows that starts from ``state``, and the state behind it."""
    outs, after, at = steps.solve(have, state), [], 0
    for r, parts in enumerate(steps.rounds):
        size = sum(len(part.none) for _, part in parts)
        after += steps.fold(state[at : at + size], steps.summary(have, state, r), r)
        at += size
    return {o: outs[o] for o in steps.outs}, after


class _Bars(StatefulProcessor):
    def __init__(self, steps: Sequence[Step]) -> None:
        self.steps = Steps(steps)

    def init(self, handle: StatefulProcessorHandle) -> None:
        numbers = ", ".join(f"c{k} double" for k in range(len(self.steps.inputs)))
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "day int", numbers)
        self.state = handle.getValueState("state", ", ".join(f"s{k} double" for k in range(len(self.steps.none))))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        for frame in rows:
            days = frame["day"].tolist()
            for day, *values in zip(days, *[frame[f"c{k}"].tolist() for k in range(len(self.steps.inputs))], strict=True):
                self.waiting.updateValue((int(day),), tuple(None if v is None or v != v else float(v) for v in values))
            if days:
                self.handle.registerTimer(int(min(days)) * DAY_MS)
        yield from ()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        due, rest = [], None
        for (day,), values in self.waiting.iterator():
            if day * DAY_MS <= passed:
                due.append((day, values))
            else:
                rest = day if rest is None else min(rest, day)
        if rest is not None:
            self.handle.registerTimer(rest * DAY_MS)
        if not due:
            return
        due.sort(key=lambda x: x[0])
        for day, _ in due:
            self.waiting.removeKey((day,))
        have = {c: np.array([v[k] for _, v in due], dtype=float) for k, c in enumerate(self.steps.inputs)}
        state = [np.nan if x is None else x for x in self.state.get()] if self.state.exists() else self.steps.none
        outs, after = advance(self.steps, have, state)
        self.state.update(tuple(float(x) for x in after))
        days = pd.to_datetime(pd.Series([d for d, _ in due]), unit="D").dt.date
        yield pd.DataFrame({SYMBOL: key[0], DATE: days, **outs})

    def close(self) -> None:
        pass


def recurrences(bars: DataFrame, steps: Sequence[Step], late: str = "7 days") -> DataFrame:
    """symbol, dt and a column per step of a stream of bars; a row comes out when the
    watermark, ``late`` behind the latest bar of all symbols, passes its date. Needs
    the RocksDB state store."""
    if any(isinstance(s, (Back, Sum)) for s in steps):
        raise ValueError("steps that look back over rows are not offered on streams")
    known = Steps(steps)
    rows = bars.select(SYMBOL, F.col(DATE).cast("timestamp").alias("at"), F.unix_date(DATE).alias("day"), *[F.col(c).cast("double").alias(f"c{k}") for k, c in enumerate(known.inputs)])
    schema = f"{SYMBOL} string, {DATE} date, " + ", ".join(f"{o} double" for o in known.outs)
    return rows.withWatermark("at", late).groupBy(SYMBOL).transformWithStateInPandas(_Bars(steps), schema, "append", "EventTime")


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
