"""What charts shade and draw over the bars."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillbar.operators import charts
from tests.helpers import bars


def flagged(spark, values):
    """Flat bars with signal_dpo (None stays null)."""
    df = bars(spark, [100 + k for k in range(len(values))])
    listed = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, signal_dpo boolean")
    return df.withColumn("k", (F.col("close") - 100).cast("int")).join(listed, "k")


@pytest.mark.parametrize("size", [None, 1])
def test_signal_spans(spark, size):
    """Stretches meet over chunks; null is no signal; a row without a line has no place."""
    values = [True] * 24 + [False, None] + [True] * 20
    df = flagged(spark, values).withColumn("ema_5", F.when(F.col("k") >= 2, F.col("close")))
    rows = charts.signal_spans(df, ["ema_5"], size).orderBy("from_x").collect()
    assert [(r["signal"], r["caption"], r["from_x"], r["to_x"]) for r in rows] == [("signal_dpo", "DPO Positive", -0.5, 21.5), ("signal_dpo", "DPO Positive", 23.5, 43.5)]


@pytest.mark.parametrize("size", [None, 1])
def test_label_spans_and_lines(spark, size):
    labels = [1.0, 1.0, -1.0, None, 0.0, -1.0] + [1.0] * 30
    listed = spark.createDataFrame(list(enumerate(labels)), "k int, long_label double")
    df = bars(spark, [100 + k for k in range(len(labels))]).withColumn("k", (F.col("close") - 100).cast("int")).join(listed, "k")
    df = df.withColumns({"short_label": F.lit(None).cast("double"), "atr": F.when(F.col("k") > 0, F.lit(2.0))})
    rows = charts.label_spans(df, size).orderBy("from_x").collect()
    assert [(r["horizon"], r["label"], r["from_x"], r["to_x"]) for r in rows] == [("long", 1, -0.5, 1.5), ("long", -1, 1.5, 2.5), ("long", -1, 4.5, 5.5), ("long", 1, 5.5, 35.5)]
    lines = {(r["x"], r["horizon"]): (r["stop_loss"], r["take_profit"]) for r in charts.barrier_lines(df, size).collect()}
    assert lines[0, "long"] == (None, None) and lines[3, "long"] == (99.0, 109.0) and lines[3, "short"] == (101.0, 106.0)
    assert charts.signal_spans(df.limit(0).withColumn("signal_dpo", F.lit(True)), [], size).count() == 0
