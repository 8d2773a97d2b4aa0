from __future__ import annotations

from datetime import date

from quillbar.streaming import bars as S
from quillbar.sources import bars as B
from tests.helpers import DATA


def test_stream_equals_batch(spark):
    got = {tuple(r) for r in S.hourly_bars_once(spark, DATA).select("symbol", "dt", "open", "high", "low", "close", "volume").collect()}
    want = {tuple(r) for r in B.hourly_bars(spark, DATA).select("symbol", "dt", "open", "high", "low", "close", "volume").collect()}
    assert got == want


def test_running_mean(spark, tmp_path):
    """Two files, one batch each: the state carries over."""
    schema = "symbol string, dt date, close double"
    for k, rows in enumerate(([("A", date(2020, 1, 1), 1.0), ("A", date(2020, 1, 2), 3.0)], [("A", date(2020, 1, 3), None), ("A", date(2020, 1, 4), 5.0), ("B", date(2020, 1, 4), 7.0)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    query = S.running_mean(stream, 0.5).writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = {(r.symbol, r.dt): r["mean"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert rows == {("A", date(2020, 1, 1)): 1.0, ("A", date(2020, 1, 2)): 2.0, ("A", date(2020, 1, 3)): 2.0, ("A", date(2020, 1, 4)): 3.5, ("B", date(2020, 1, 4)): 7.0}


def test_recurrences_with_late_rows(spark, tmp_path):
    """Several batches, rows out of order within the watermark, gaps, a symbol that
    starts late: the stream's means and stops are the batch's."""
    import random

    from quillbar.functions.recurrences import Ewm, Minus, Stop, scan
    from quillbar.streaming import recurrences as R
    from tests.helpers import bars

    rng = random.Random(4)
    value = lambda i: None if i % 9 == 4 else 50 + rng.random()
    rows = [(1, 51 + rng.random(), 49 - rng.random(), value(i), 1) for i in range(60)]
    df = bars(spark, rows).unionByName(bars(spark, rows[:25], "Y", date(2020, 2, 3)))
    steps = [Ewm("a", "close", 0.3), Ewm("b", "close", 0.1), Minus("d", "a", "b"), Ewm("e", "d", 0.2), Stop("sar")]
    want = {(r.symbol, r.dt): (r.a, r.d, r.e, r.sar) for r in scan(df, steps).collect()}
    schema = df.schema
    data = sorted(df.collect(), key=lambda r: (r.dt.toordinal() + rng.randrange(6), r.symbol))
    for k in range(6):
        part = data[k * len(data) // 6 : (k + 1) * len(data) // 6]
        spark.createDataFrame(part + ([("Z", date(2030, 1, 1), 1.0, 1.0, 1.0, 1.0, 1.0)] if k == 5 else []), schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", R.ROCKSDB)
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        query = R.recurrences(stream, steps, "10 days").writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = spark.read.parquet(f"{tmp_path}/out").where("symbol <> 'Z'").collect()
    assert len(got) == len(want) == 85
    for r in got:
        for x, y in zip((r.a, r.d, r.e, r.sar), want[r.symbol, r.dt], strict=True):
            assert (x is None or x != x) == (y is None) and (y is None or abs(x - y) < 1e-9)
