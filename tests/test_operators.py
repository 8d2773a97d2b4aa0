"""Semantics on hand-made bars: warm-up, nulls, flat prices, barriers, runs."""

from __future__ import annotations

from datetime import date

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillbar.functions import kernels
from quillbar.functions import chunks
from quillbar.functions.recurrences import Back, Ewm, Minus, Over, Stop, Sum, scan, span
from quillbar.operators import evaluation
from quillbar.operators import charts, frames, indicators, labels, metrics, models, signals
from quillbar.sources import bars as B
from tests.helpers import DATA, bars, column

#: The first row (from 0) with a value, on bars without nulls.
FIRST = {
    "ema_5": 0, "ema_5_slope": 1, "gap_days": 1, "boll_mid": 19, "sar": 0, "kc_mid": 0, "kc_up": 19, "macd_hist": 0, "pdi": 13, "adx": 26, "adxr": 40, "dma": 0, "ama": 9, "adtm": 22,
    "adtmma": 44, "cci": 26, "kdj_k": 8, "rsi": 1, "ar": 25, "br": 26, "psy": 11, "vr": 25, "atr": 13, "ddi": 12, "dpo": 30, "osc": 19, "osc_signal": 19, "mi": 24, "srmi": 13, "ret": 1,
}


def walk(n, seed=0):
    rng = np.random.default_rng(seed)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
    open_ = close * np.exp(rng.normal(0, 0.004, n))
    high, low = np.maximum(open_, close) * 1.004, np.minimum(open_, close) * 0.996
    return [tuple(map(float, r)) for r in zip(open_, high, low, close, rng.integers(1, 99, n), strict=True)]


def test_first_values(spark):
    df = indicators.indicators(bars(spark, walk(70)), indicators.MODEL).toPandas().sort_values("dt").reset_index(drop=True)
    for name, at in FIRST.items():
        assert df[name].first_valid_index() == at, name
    assert indicators.features(bars(spark, walk(70))).count() == 70 - 44


def test_invariants(spark):
    df = indicators.indicators(B.walk_bars(spark, DATA)).toPandas()
    assert (df["low"] <= df[["open", "close"]].min(axis=1)).all() and (df["high"] >= df[["open", "close"]].max(axis=1)).all()
    assert (df["sar"] <= df["low"] + 1e-9).all()
    for c in ("rsi", "srmi", "psy"):
        assert df[c].dropna().between(-1e-9, 100 + 1e-9).all()
    b = df.dropna(subset=["boll_mid"])
    assert (b["boll_low"] <= b["boll_mid"]).all() and (b["boll_mid"] <= b["boll_up"]).all()


def test_flat_prices(spark):
    df = indicators.indicators(bars(spark, [(5, 5, 5, 5, 1)] * 60))
    row = df.orderBy(F.desc("dt")).first()
    for c in ("rsi", "srmi", "kdj_k", "ddi", "adtm", "pdi", "cci", "ar", "mi"):
        assert row[c] is None, c
    assert row["boll_mid"] == row["boll_up"] == 5 and row["vr"] == 100 and row["psy"] == 0


def test_rising_prices(spark):
    row = indicators.indicators(bars(spark, [float(x) for x in range(1, 61)]), ("rsi", "psy", "vr")).orderBy(F.desc("dt")).first()
    assert row["rsi"] == 100 and row["psy"] == 100 and row["vr"] is None


@pytest.mark.parametrize("values", [[None, 1, 2, None, None, 4, 5], [None] * 5, [3.0], [1, None, None], [np.nan if i % 3 == 0 else i for i in range(40)]])
def test_ewm_gaps(spark, values):
    values = [None if v is None or v != v else v for v in values]
    df = bars(spark, [(1, 1, 1, v, 1) for v in values])
    got = column(scan(df.repartition("symbol"), [Ewm("y", "close", 1 / 3)]), "y")
    want = pd.Series(values, dtype=float).ewm(alpha=1 / 3, adjust=False).mean()
    assert np.allclose(np.array(got, dtype=float), want, equal_nan=True)


def test_recurrences_across_batches_and_symbols(spark):
    """Batches of 7 rows: states must pass from batch to batch, never between symbols."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        data = {s: walk(n, seed=n) for s, n in (("A", 50), ("B", 3), ("C", 1), ("D", 90))}
        rows = {s: [(o, h, l, None if i % 5 == 0 or i < 9 else c, v) for i, (o, h, l, c, v) in enumerate(d)] for s, d in data.items()}
        df = None
        for s, r in rows.items():
            one = bars(spark, r, s)
            df = one if df is None else df.unionByName(one)
        out = scan(df.repartition(2, "symbol"), [Ewm("y", "close", span(9)), Ewm("z", "y", span(4)), Stop("sar")]).toPandas()
        for s, r in rows.items():
            mine = out[out.symbol == s].sort_values("dt")
            y = pd.Series([x[3] for x in r], dtype=float).ewm(span=9, adjust=False).mean()
            assert np.allclose(mine["y"].astype(float), y, equal_nan=True)
            assert np.allclose(mine["z"].astype(float), y.ewm(span=4, adjust=False).mean(), equal_nan=True)
            stop, top, af, prev = r[0][2], r[0][1], 0.02, r[0][2]
            for i, (_, h, l, _, _) in enumerate(r):  # noqa: E741
                if i:
                    stop = min(stop + af * (top - stop), prev, l)
                    if h > top:
                        top, af = h, min(af + 0.02, 0.2)
                prev = l
                assert abs(mine["sar"].iloc[i] - stop) < 1e-9
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_order_and_symbols_do_not_matter(spark):
    a, b = bars(spark, walk(60, 1), "A"), bars(spark, walk(60, 2), "B")
    both = indicators.indicators(a.unionByName(b).orderBy(F.rand(3))).orderBy("symbol", "dt").collect()
    apart = indicators.indicators(a).orderBy("dt").collect() + indicators.indicators(b).orderBy("dt").collect()
    assert both == apart


def test_gap_and_slices(spark):
    df = bars(spark, [1.0] * 6)
    assert column(indicators.indicators(df, ("gap",)), "gap_days") == [None, 0, 0, 0, 0, 2]
    assert B.scan(df, "X", "2020-01-07", "2020-01-08").count() == 2
    with pytest.raises(ValueError):
        B.scan(df, "Y", "2020-01-07", "2020-01-08")
    have = B.coverage(df)
    assert B.covered(have, " x ") == (date(2020, 1, 6), date(2020, 1, 13)) and B.covered(have, "q") is None
    B.check_coverage(have, "X", date(2020, 1, 6), date(2020, 1, 13))
    for start, end in ((date(2020, 1, 6), date(2021, 1, 1)), (date(2019, 1, 1), date(2020, 1, 7))):
        with pytest.raises(ValueError):
            B.check_coverage(have, "X", start, end)
    with pytest.raises(ValueError):
        B.BuildConfig(date(2020, 1, 2), date(2020, 1, 1), "/tmp")


def test_barriers(spark):
    """Range 1, so barriers at -1 and +1.5 of the entry."""
    rule = labels.Barrier(5, 1.0, 1.5)

    def label(*rows):
        df = bars(spark, [(o, h, l, c, 1) for o, h, l, c in rows]).withColumn("atr", F.lit(1.0))
        return column(labels.label_open(df, rule, "y"), "y"), column(labels.label_worst(df, rule, "w"), "w")

    calm, both, up, down = (10, 10.2, 9.8, 10), (10, 12, 8, 10), (10, 11.6, 9.9, 10), (10, 10.1, 8.9, 10)
    assert label(calm, both)[0] == [-1, None]
    assert label(calm, up, down)[0] == [1, 1, None]
    assert label(both, calm)[0] == [-1, None]  # the entry bar counts at the open
    assert label(both, calm)[1] == [0, None]  # and not at its close
    assert label(calm, calm)[0] == [0, None]
    assert label(calm, *[calm] * 5, down)[0][0] == 0  # beyond five calendar days
    df = bars(spark, [(10, 10, 10, 10, 1)] * 2).withColumn("atr", F.lit(None).cast("double"))
    assert column(labels.label_open(df, rule, "y"), "y") == [None, None] and column(labels.label_worst(df, rule, "w"), "w") == [None, None]


def test_label_classes_and_tail(spark):
    df = bars(spark, walk(40)).withColumn("long_label", F.lit(1.0)).withColumn("short_label", F.lit(0.0))
    last = df.agg(F.max("dt")).first()[0]
    assert labels.check_tail(df, last).count() == 40
    with pytest.raises(ValueError):
        labels.check_tail(df, date(2020, 1, 11))  # a Saturday
    rows = spark.createDataFrame([(-1.0,), (0.0,), (1.0,), (None,)], "label double")
    assert [r[0] for r in rows.select(labels.binary()).collect()] == [0, 0, 1, 0]
    assert [r[0] for r in rows.select(labels.multiclass()).collect()] == [0, 1, 2, None]


def test_runs_and_validity(spark):
    df = bars(spark, [1.0] * 7).withColumn("f", F.col("dt").isin(date(2020, 1, 6), date(2020, 1, 7), date(2020, 1, 14)))
    assert [(r.start_dt, r.end_dt, r.n_rows) for r in kernels.runs(df, "f").orderBy("start_dt").collect()] == [(date(2020, 1, 6), date(2020, 1, 7), 2), (date(2020, 1, 14), date(2020, 1, 14), 1)]
    assert kernels.runs(df.withColumn("f", F.lit(False)), "f").count() == 0
    assert column(signals.valid_for(df, "f"), "f_valid") == [True, True, True, True, False, False, True]


def test_signals_are_never_null(spark):
    df = signals.signals(bars(spark, walk(90)))
    row = df.agg(*[F.count_if(F.col(s).isNull()).alias(s) for s in signals.SIGNALS]).first()
    assert not any(row)
    assert df.where("signal_sar or signal_srmi").isEmpty()


def test_empty_and_single(spark):
    none = bars(spark, walk(3)).where("false")
    assert signals.signals(none).count() == 0 and indicators.features(none).count() == 0
    one = indicators.indicators(bars(spark, walk(1)))
    row = one.first()
    assert row["sar"] == row["low"] and row["boll_mid"] is None and row["ema_5"] == row["close"]


def test_extra_and_null_columns(spark):
    df = bars(spark, walk(70)).withColumns({"note": F.lit("n"), "atr_old": F.lit(1.0)})
    assert {"note", "atr_old"} <= set(indicators.indicators(df).columns)
    holes = bars(spark, [r if i % 9 else (None,) * 5 for i, r in enumerate(walk(70))])
    assert indicators.indicators(holes).count() == 70


def test_scaler_and_windows(spark):
    df = bars(spark, walk(30)).withColumns({"label": F.when(F.col("dt") != date(2020, 1, 20), 1), "split": F.lit("train"), "flat": F.lit(2.0)})
    scaler = {r.feature: r for r in frames.fit_scaler(df, ["close", "flat"]).collect()}
    x = np.array(column(df, "close"), dtype=np.float32).astype(float)
    assert abs(scaler["close"]["mean"] - x.mean()) < 1e-9 and abs(scaler["close"]["std"] - x.std()) < 1e-9 and scaler["flat"]["std"] == 1.0
    made = frames.sliding_windows(df, ["close", "flat"], 10).orderBy("end_dt").collect()
    assert len(made) == 20 and all(len(r.features) == 10 and len(r.features[0]) == 2 for r in made)
    hole = df.withColumn("close", F.when(F.col("dt") != date(2020, 1, 30), F.col("close")))
    assert frames.sliding_windows(hole, ["close"], 10).count() == 10
    picked = models.score(frames.sliding_windows(df, ["close", "flat"], 10), lambda x: np.stack([x[:, -1, 0], 100 + 0 * x[:, 0, 0]], axis=1))
    assert picked.count() == 20


def test_metrics(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 1)], "y int, pred int")
    assert metrics.accuracy(df).first()[0] == 0.5
    assert abs(metrics.macro_f1(df, 4).first()[0] - (2 / 3 + 0.5 + 0 + 0) / 4) < 1e-6
    assert {r.y: r.n for r in metrics.bincount(df, "y", 4).collect()} == {0: 2, 1: 1, 2: 1, 3: 0}
    assert abs(metrics.weighted_loss(spark.createDataFrame([(1.0, 1), (4.0, 2)], "loss double, n int")).first()[0] - 3) < 1e-12
    weights = {r.y: (r.n, r.weight) for r in frames.class_weights(spark.createDataFrame([(-1,), (0,), (1,), (None,)], "label int"), 3).collect()}
    assert weights == {0: (2, 4 / 6), 1: (1, 4 / 3), 2: (1, 4 / 3)}


def test_candles(spark):
    rows = charts.candles(bars(spark, walk(25))).orderBy("x").collect()
    assert [r.x for r in rows if r.tick] == [*range(0, 25, 2)]
    assert [r.x for r in charts.candles(bars(spark, walk(24)), last=True).orderBy("x").collect() if r.tick][-1] == 23


def test_files(spark, tmp_path):
    df = bars(spark, walk(12), "A").unionByName(bars(spark, walk(12, 3), "B"))
    B.write_bars(df, f"{tmp_path}/bars")
    assert sorted(map(tuple, B.read_bars(spark, f"{tmp_path}/bars").select(df.columns).collect())) == sorted(map(tuple, df.collect()))
    members = B.sector_members(B.coverage(df), B.sector_table(spark, {"one": ("a", "b"), "two": ("B",)}))
    B.write_sectors(members, f"{tmp_path}/sectors")
    assert B.read_instruments(spark, f"{tmp_path}/sectors/sector=one").orderBy("symbol").first()["symbol"] == "A"
    (tmp_path / "x.csv").write_text("Date,Open,High,Low,Close,Volume,Extra\n2020-01-07,1,2,0.5,nan,3,7\n2020-01-06,1,2,0.5,1.5,3,8\n")
    read = B.read_csv(spark, f"{tmp_path}/x.csv", symbol="T")
    assert column(read, "close") == [1.5, None] and "extra" in read.columns
    with pytest.raises(ValueError):
        B.read_csv(spark, f"{tmp_path}/x.csv", index="nope")
    assert sum(map(len, B.SECTORS.values())) == 40


def test_build_from_the_command_line(spark, tmp_path):
    from quillbar import build

    rows = bars(spark, walk(8), symbol="NVDA").unionByName(bars(spark, walk(5), symbol="nope"))
    rows.write.csv(f"{tmp_path}/csv", header=True)
    with pytest.raises(FileNotFoundError, match="quillbar.build"):
        B.open_store(spark, f"{tmp_path}/store")
    for extra in ([], ["--force-refresh"]):
        build.main(["--source", f"{tmp_path}/csv", "--data-root", f"{tmp_path}/store", "--start", "2020-01-07", *extra], spark)
        made, listed = B.open_store(spark, f"{tmp_path}/store")
        assert made.count() == 7 and [r["symbol"] for r in listed.collect()] == ["NVDA"]
    with pytest.raises(ValueError):
        B.BuildConfig(date(2020, 1, 2), date(2020, 1, 1), "x")


def test_scan_deals_by_itself(spark):
    df = bars(spark, walk(50)).unionByName(bars(spark, walk(50, 1), symbol="Y"))
    steps = [Ewm("y", "close", 1 / 3)]
    assert column(scan(df.repartition(5, "dt"), steps), "y") == column(scan(df.repartition("symbol"), steps), "y")


def test_batches(spark):
    made = frames.batches(bars(spark, walk(50)), 8, ("dt", "symbol"), seed=1).collect()
    sizes = pd.Series([r["batch"] for r in made]).value_counts()
    assert sorted(sizes.index) == list(range(7)) and sorted(sizes) == [2, 8, 8, 8, 8, 8, 8]
    assert [r["batch"] for r in sorted(made, key=lambda r: r["dt"])] != sorted(r["batch"] for r in made)


def test_trained_numbers(spark):
    rows = [("X", "train", None, i % 2, [[float(i % 2), 1.0], [0.0, float(i)]]) for i in range(12)] + [("X", "val", None, 1, [[1.0, 1.0], [0.0, 3.0]])]
    made = spark.createDataFrame(rows, "symbol string, split string, end_dt date, y long, features array<array<float>>")
    model, top = models.select(made, 2, rounds=5)
    assert models.parameters(model) == 2 * 4 + 2 and round(top, 6) == 0.5


def brute_stop(rows):
    stop, top, af, before, out = None, None, 0.02, None, []
    for h, l in rows:  # noqa: E741
        if h is None or l is None:
            out.append(None)
            continue
        if stop is None:
            stop, top = l, h
        else:
            stop = min(stop + af * (top - stop), before, l)
            if h > top:
                top, af = h, min(af + 0.02, 0.2)
        before = l
        out.append(stop)
    return out


@pytest.mark.parametrize("size", [1, 7, 40, 10_000])
def test_recurrences_in_chunks(spark, size):
    """Chunks of any size give what a stream of all rows gives: gaps of nulls at chunks'
    ends, a symbol that starts late, one of a single row, and nested steps."""
    data = {s: walk(n, seed=n) for s, n in (("A", 130), ("B", 1), ("C", 61))}
    rows = {s: [(o, h if i % 11 else None, l, None if i % 5 == 0 or i < 33 or 50 < i < 75 else c, v) for i, (o, h, l, c, v) in enumerate(d)] for s, d in data.items()}
    rows["D"] = [(1, 2, 1, None, 1)] * 30
    df = None
    for s, r in rows.items():
        one = bars(spark, r, s)
        df = one if df is None else df.unionByName(one)
    steps = [Ewm("y", "close", span(9)), Ewm("w", "close", span(4)), Minus("m", "y", "w"), Ewm("z", "m", span(4)), Stop("sar"), Over("r", "y", "z"), Back("b", "y", 2), Sum("t", "z", 5)]
    out = scan(df, steps, size).toPandas()
    assert len(out) == sum(map(len, rows.values()))
    for s, r in rows.items():
        mine = out[out.symbol == s].sort_values("dt")
        close = pd.Series([x[3] for x in r], dtype=float)
        y, w = close.ewm(span=9, adjust=False).mean(), close.ewm(span=4, adjust=False).mean()
        z = (y - w).ewm(span=4, adjust=False).mean()
        want = {"y": y, "m": y - w, "z": z, "r": (y / z.where(z != 0)), "b": y.shift(2), "t": z.rolling(5).sum(), "sar": pd.Series(brute_stop([(x[1], x[2]) for x in r]), dtype=float)}
        for name, x in want.items():
            assert np.allclose(mine[name].astype(float), x, equal_nan=True, rtol=1e-7, atol=1e-9), (s, name)


@pytest.mark.parametrize("size", [1, 7])
def test_indicators_in_chunks(spark, size):
    df = bars(spark, walk(150)).unionByName(bars(spark, walk(60, 1), symbol="Y"))
    small = indicators.indicators(df, size=size).orderBy("symbol", "dt").toPandas()
    whole = indicators.indicators(df, size=10_000).orderBy("symbol", "dt").toPandas()
    for c in whole.columns[2:]:
        assert np.allclose(small[c].astype(float), whole[c].astype(float), equal_nan=True), c


def test_one_symbol_runs_in_many_tasks(spark):
    """Chunks of whole months, each with its halo; a task holds no more than these."""
    df = bars(spark, walk(2_000))
    placed, most = chunks.dealt(df, size=100, cold=30, warm=20)
    per = placed.groupBy("_chunk").agg(F.count("*").alias("n"), F.sum((F.col("_role") == chunks.OWN).cast("int")).alias("own")).collect()
    assert most == len(per) >= 8 and sum(r["own"] for r in per) == 2_000
    assert max(r["n"] for r in per) <= 100 + 30 + 20 + 3 * 23
    made = scan(df, [Ewm("y", "close", 0.1), Stop("sar")], size=100)
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        tasks = scan(df, [Ewm("y", "close", 0.1)], size=100).select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert tasks >= 8 and made.count() == 2_000


def test_cuts():
    """Every bucket is one chunk's own; halos reach back far enough, also over chunks."""
    counts = [3, 1, 9, 2, 2, 2, 30, 1, 1, 1, 1]
    for size in (1, 4, 10, 100):
        found = chunks.cuts(counts, size, 5, 4)
        own = [(k, c) for k, c, role, _ in found if role == chunks.OWN]
        assert [k for k, _ in own] == list(range(len(counts))) and [c for _, c in own] == sorted(c for _, c in own)
        for chunk in {c for _, c in own}:
            first = min(k for k, c in own if c == chunk)
            warm = sum(counts[k] for k, c, role, _ in found if c == chunk and role == chunks.WARM)
            cold = sum(counts[k] for k, c, role, _ in found if c == chunk and role == chunks.COLD)
            assert warm >= min(4, sum(counts[:first])) and warm + cold >= min(9, sum(counts[:first]))
        # what later chunks do not repeat is every bucket once
        assert sorted(k for k, c, role, later in found if role != chunks.COLD and not later) == list(range(len(counts)))


@pytest.mark.parametrize("size", [1, 25])
def test_windows_in_chunks(spark, size):
    df = bars(spark, walk(90)).withColumns({"label": F.when(F.col("close") > 0, 1), "split": F.when(F.month("dt") < 3, "train").when(F.month("dt") > 3, "val")})
    df = df.withColumn("close", F.when(F.dayofmonth("dt") != 17, F.col("close")))
    key = lambda rows: sorted((r["split"], r["end_dt"], r["features"], r["y"]) for r in rows)
    assert key(frames.sliding_windows(df, ["close", "high"], 7, size=size).collect()) == key(frames.sliding_windows(df, ["close", "high"], 7).collect()) != []


def test_mean_ranks(spark):
    """Ties share their mean rank, over partitions; nulls have none."""
    rng = np.random.default_rng(2)
    rows = [(int(d), None if v == 9 else float(v)) for d, v in zip(rng.integers(0, 3, 400), rng.integers(0, 10, 400), strict=True)] + [(7, 1.0)]
    got = evaluation.mean_ranks(spark.createDataFrame(rows, "dt int, v double").repartition(7), "v", "rank").toPandas()
    want = got.groupby("dt")["v"].rank(method="average")
    assert len(got) == 401 and np.allclose(got["rank"].astype(float), want, equal_nan=True)


def test_information(spark):
    rows = [("A", 1, 1.0, 0.1), ("B", 1, 2.0, 0.2), ("C", 1, 3.0, 0.9), ("D", 1, None, 5.0), ("A", 2, 1.0, 0.3), ("A", 3, 4.0, 0.1), ("B", 3, 4.0, 0.2)]
    got = {r["dt"]: (r["n"], r["ic"], r["rank_ic"]) for r in evaluation.information(spark.createDataFrame(rows, "symbol string, dt int, f double, g double"), "f", "g").collect()}
    assert got[2] == (1, None, None) and got[3] == (2, None, None)
    assert got[1][0] == 3 and abs(got[1][2] - 1) < 1e-12 and abs(got[1][1] - np.corrcoef([1, 2, 3], [0.1, 0.2, 0.9])[0, 1]) < 1e-12


@pytest.mark.parametrize("size", [1, 30, 10_000])
def test_drawdown_in_chunks(spark, size):
    df = bars(spark, walk(120)).withColumn("position", F.when(F.dayofmonth("dt") % 5 == 0, 0.0).otherwise(1.0))
    r = evaluation.performance(evaluation.strategy_returns(df, size=size)).first()
    rows = df.orderBy("dt").toPandas()
    held = rows["position"].shift()
    gain = (held * rows["close"].pct_change()).dropna()
    e = (1 + gain).cumprod()
    assert r["n"] == 119 and abs(r["growth"] - e.iloc[-1]) < 1e-9
    assert abs(r["max_drawdown"] - (e / e.cummax().clip(lower=1) - 1).min()) < 1e-9
    assert abs(r["sharpe"] - gain.mean() / gain.std() * 252**0.5) < 1e-9 and abs(r["win_rate"] - (gain > 0).sum() / (held > 0).sum()) < 1e-12
    assert abs(r["turnover"] - (held - held.shift().fillna(0)).abs().dropna().mean()) < 1e-12


def test_fold_scalers_equal_a_fit(spark):
    df = bars(spark, walk(500)).unionByName(bars(spark, walk(400, 3), "Y")).withColumn("flat", F.lit(2.0))
    folds = [frames.Fold("a", date(2020, 2, 1), date(2020, 6, 1)), frames.Fold("b", date(2020, 5, 1), date(2021, 12, 1), out="X")]
    got = frames.fold_scalers(frames.month_moments(df, ["close", "flat"]), folds).collect()
    for f in folds:
        rows = df.where((F.trunc("dt", "month") >= F.lit(f.start)) & (F.trunc("dt", "month") <= F.lit(f.end)) & (F.lit(f.out is None) | (F.col("symbol") != (f.out or ""))))
        want = {r["feature"]: r for r in frames.fit_scaler(rows, ["close", "flat"]).collect()}
        mine = {r["feature"]: r for r in got if r["fold"] == f.name}
        assert set(mine) == set(want) and all(abs(mine[k]["mean"] - want[k]["mean"]) < 1e-9 and abs(mine[k]["std"] - want[k]["std"]) < 1e-9 and mine[k]["n"] == rows.count() for k in want)
    assert [f.name for f in frames.rolling_folds(1993, 1998)] == ["1993", "1994"]


@pytest.mark.parametrize("values", [[None, 1, 2, None, None, 4, 5], [None] * 5, [3.0], [1, None, None], [np.nan if i % 3 == 0 else i for i in range(40)], [1.0] * 25 + [np.nan] * 70 + [5.0] * 25])
def test_ewm_ignores_gaps(spark, values):
    """Also in chunks, some of them without any value."""
    values = [None if v is None or v != v else v for v in values]
    df = bars(spark, [(1, 1, 1, v, 1) for v in values])
    want = pd.Series(values, dtype=float).ewm(alpha=1 / 3, adjust=False, ignore_na=True).mean()
    for size in (None, 1):
        got = column(scan(df.repartition("symbol"), [Ewm("y", "close", 1 / 3, ignore_na=True)], size=size), "y")
        assert np.allclose(np.array(got, dtype=float), want, equal_nan=True)
