"""Exits of trades against a walk bar by bar."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillbar.operators.exits import Rule, trailing_exits
from tests.helpers import bars

RULE = Rule(fast=3, slow=5)


def walked(rows, signal):
    """(entry, half, exit, reason, level) by row numbers, one bar after the other."""
    out = []
    mean = lambda k, n: round(sum(r[3] for r in rows[k - n + 1 : k + 1]) / n, 6) if k >= n - 1 else None
    for i, (_, _, _, close, atr) in enumerate(rows):
        if mean(i, 5) is None or not mean(i, 3) > mean(i, 5) or not signal(i) or atr is None:
            continue
        stop, target, gap = close - 2.0 * atr, close + 3.0 * atr, 2.0 * atr
        top, floor, half, found = close, stop, None, (None, "open", None)
        for k in range(i + 1, len(rows)):
            _, high, low, _, _ = rows[k]
            if half is None and low <= stop:
                found = (k, "stop", stop)
                break
            if half is not None and low <= max(top - gap, floor):
                found = (k, "trail", max(top - gap, floor))
                break
            if half is None and high >= target:
                half = k
            top = max(top, high)
            if half is not None:
                floor = max(floor, mean(k, 3))
        out.append((i, half, *found))
    return out


def series(seed, n, drift=0.0, width=1.0):
    rng = np.random.default_rng(seed)
    close = np.round(100 + np.cumsum(rng.normal(drift, 1, n)), 2)
    low, high = close - np.round(rng.uniform(0, width, n), 2), close + np.round(rng.uniform(0, width, n), 2)
    return [(c, round(float(h), 2), round(float(lo), 2), float(c), round(float(a), 2)) for c, h, lo, a in zip(close, high, low, rng.uniform(0.5, 4, n), strict=True)]


@pytest.mark.parametrize("seed, n, drift, size", [(1, 400, 0.0, 10_000), (1, 400, 0.0, 1), (2, 400, 0.3, 40), (3, 300, 1.0, 1), (4, 300, -0.2, 25)])
def test_walk(spark, seed, n, drift, size):
    rows = series(seed, n, drift)
    df = bars(spark, rows).withColumn("atr", F.col("volume"))
    found = trailing_exits(df, F.lit(True), RULE, size).collect()
    days = {r["dt"]: k for k, r in enumerate(df.orderBy("dt").collect())}
    mine = sorted((days[r["dt"]], days.get(r["half_dt"]), days.get(r["exit_dt"]), r["reason"], r["level"]) for r in found)
    assert mine == walked(rows, lambda i: True)
    assert {x[3] for x in mine} >= ({"stop", "trail"} if drift < 1 else {"trail"})
    price = {r["dt"]: (r["price"], rows[days[r["dt"]]][4]) for r in found}
    for r in found:
        p, atr = price[r["dt"]]
        last = None if r["level"] is None else r["level"] / p - 1
        want = {"stop": last, "open": None}.get(r["reason"], None if last is None else (3 * atr / p + last) / 2)
        assert r["gain"] == pytest.approx(want) if want is not None else r["gain"] is None


def test_odd_rows(spark):
    """Bars without prices touch nothing; no signal, no range, no trend: no trade."""
    rising = [(100 + k, 100 + k, 100 + k, 100.0 + k, 1.0) for k in range(12)]
    rising[8] = (108, None, None, 108.0, 1.0)
    df = bars(spark, rising).withColumn("atr", F.col("volume"))
    day = df.orderBy("dt").collect()[4]["dt"]
    one = trailing_exits(df, F.col("dt") == F.lit(day), RULE, 1).collect()
    assert [(r["half_dt"] is not None, r["exit_dt"], r["reason"], r["gain"]) for r in one] == [(True, None, "open", None)]
    assert trailing_exits(df, F.lit(None).cast("boolean"), RULE).count() == 0
    assert trailing_exits(df.withColumn("atr", F.lit(None).cast("double")), F.lit(True), RULE).count() == 0
    assert trailing_exits(df.limit(0), F.lit(True), RULE).count() == 0
    both = df.unionByName(df.withColumn("symbol", F.lit(None).cast("string")))
    assert trailing_exits(both, F.col("dt") == F.lit(day), RULE, 1).count() == 2
