"""The bar format: pruned partitions, ranges, other fetchers, offsets of a stream."""

from __future__ import annotations

from datetime import date, timedelta

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillbar.sources import bars as B
from quillbar.sources import reader
from quillbar.sources.reader import BarStream, Range, StoreFetcher, Wanted
from tests.helpers import bars


class Flaky:
    """Bars of a rule; the first request of a range fails."""

    failed: set = set()

    def __init__(self, options):
        self.base = float(options["base"])

    def instruments(self):
        return [("P", date(2020, 1, 1), date(2020, 1, 10)), ("Q", date(2020, 1, 5), date(2020, 1, 6))]

    def fetch(self, symbol, start, end):
        if (symbol, start) not in self.failed:
            self.failed.add((symbol, start))
            raise OSError("try again")
        days = [start + timedelta(days=k) for k in range((end - start).days + 1)]
        yield pa.RecordBatch.from_pydict({"dt": days, **{n: [self.base + d.day for d in days] for n in reader.NUMBERS}})


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("store"))
    rows = bars(spark, range(1, 401), "NVDA").unionByName(bars(spark, [5, None, 7], "MS")).unionByName(bars(spark, range(1, 30), "V"))
    B.build(spark, B.BuildConfig(date(2020, 1, 1), date(2022, 12, 31), root), rows)
    reader.register(spark)
    return root


def test_equals_the_store(spark, store):
    got = spark.read.format("quillbar").load(store)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, B.read_bars(spark, f"{store}/bars").select(got.columns).collect()), key=repr)
    assert got.count() == 432


def test_filters_leave_out_partitions(spark, store):
    every = lambda: reader.bars_from(spark, store, days=100)
    parts = lambda df: df.rdd.getNumPartitions()
    assert parts(every()) == 6 + 1 + 1
    one = "symbol = 'NVDA' and dt >= '2020-06-01' and dt < '2020-07-01'"
    assert parts(every().where(one)) == 1
    assert every().where(one).agg(F.count("*"), F.min("dt"), F.max("dt")).first()[:] == (22, date(2020, 6, 1), date(2020, 6, 30))
    assert parts(every().where("symbol in ('MS', 'V')")) == 2 and every().where("symbol in ('MS', 'V')").count() == 32
    assert every().where("symbol = 'none'").count() == 0
    assert every().where("dt = '2020-01-08' and close > 3").count() == 1  # the last part is not the source's to say
    assert every().where("symbol = 'MS' or dt > '2021-01-01'").count() == 3 + every().where("dt > '2021-01-01'").count() > 100


def test_a_frame_for_several_queries(spark, store):
    frame = spark.read.format("quillbar").option("days", 100).load(store)
    assert [frame.where("symbol = 'MS'").count(), frame.count(), frame.where("dt = '2020-01-08'").count(), frame.count()] == [3, 432, 3, 432]


def test_options(spark, store):
    read = spark.read.format("quillbar").option("symbols", "v, ms").option("start", "2020-01-07").option("end", "2020-01-08").load(store)
    assert sorted((r.symbol, r.dt.day, r.close) for r in read.collect()) == [("MS", 7, None), ("MS", 8, 7.0), ("V", 7, 2.0), ("V", 8, 3.0)]


def test_another_fetcher_and_retries(spark, store):
    read = spark.read.format("quillbar").options(fetcher="tests.test_reader:Flaky", base="100", days="4", delay="0").load()
    assert sorted((r.symbol, r.dt.day, r.close) for r in read.collect()) == [("P", d, 100.0 + d) for d in range(1, 11)] + [("Q", d, 100.0 + d) for d in (5, 6)]


def test_ranges_and_offsets(store):
    assert reader.ranges("X", date(2020, 1, 1), date(2020, 1, 5), 2) == [Range("X", date(2020, 1, a), date(2020, 1, b)) for a, b in ((1, 2), (3, 4), (5, 5))]
    stream = BarStream({"path": store})
    end = stream.latestOffset()
    assert end == {s: e.isoformat() for s, _, e in StoreFetcher({"path": store}).instruments()}
    behind = end | {"V": "2020-01-10"}
    (part,) = stream.partitions(behind, end)
    assert (part.symbol, part.start) == ("V", date(2020, 1, 11))
    assert stream.partitions(end, end) == [] and len(stream.partitions({}, end)) == 3
    assert Wanted.of({}).symbols is None


def test_stream(spark, store, tmp_path):
    root = str(tmp_path / "grows")
    config = B.BuildConfig(date(2020, 1, 1), date(2022, 12, 31), root)
    rows = bars(spark, range(1, 21), "NVDA").unionByName(bars(spark, range(1, 11), "V"))

    def run():
        stream = spark.readStream.format("quillbar").load(root)
        query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").start()
        query.processAllAvailable()
        query.stop()
        return sorted((r.symbol, r.dt, r.close) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    want = lambda df: sorted((r.symbol, r.dt, r.close) for r in df.collect())
    first = rows.where("dt < '2020-01-15'")
    B.build(spark, config, first)
    assert run() == want(first)
    B.build(spark, config, rows)  # one symbol goes on, the other has some days more
    assert run() == want(rows)
