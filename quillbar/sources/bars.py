"""Bars: resampling ticks, scans by symbol and range, files in and out."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field
from datetime import date
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.kernels import DATE, SYMBOL, finite

BAR = "symbol string, dt date, open double, high double, low double, close double, volume double"
INSTRUMENT = "symbol string, start date, end date"

# The default universe, by sector.
SECTORS = {
    "tech": ("NVDA", "TSM", "AAPL", "MSFT", "GOOGL", "AMZN", "META", "SAP", "ANET", "AVGO", "IBM", "TSLA", "PLTR", "ADP", "ALAB", "ADI", "TXN", "MU", "QCOM", "ARM"),
    "financial": ("JPM", "MS", "KKR", "MAIN", "V", "AXP", "PGR", "ICE", "BN", "SPGI", "BX", "NDAQ", "ARES"),
    "industrial": ("ABBV", "CAT", "RTX", "VST", "MNST", "MCD", "CVX"),
}


@dataclass(frozen=True)
class BuildConfig:
    """What a dataset build needs; the range is checked when it is made."""

    start: date
    end: date
    data_root: str
    force_refresh: bool = False
    sectors: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(SECTORS))

    def __post_init__(self) -> None:
        if self.end < self.start:
            raise ValueError(f"end {self.end} lies before start {self.start}")

    @property
    def symbols(self) -> list[str]:
        """Sorted, distinct, in upper case."""
        return sorted({s.strip().upper() for members in self.sectors.values() for s in members})

    @property
    def mode(self) -> str:
        return "overwrite" if self.force_refresh else "append"


def resample(ticks: DataFrame, at: Column, *order: str) -> DataFrame:
    """(symbol, at) bars of (symbol, price, size, *order) ticks.

    First and last are min_by and max_by of the order, which combine before the
    shuffle; no tick list is ever gathered.
    """
    place = F.struct(*order)
    return ticks.groupBy(SYMBOL, at.alias(DATE)).agg(
        F.min_by("price", place).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", place).alias("close"),
        F.sum("size").cast("double").alias("volume"),
    )


WALK_ORDER = ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def walk_ticks(lineitem: DataFrame) -> DataFrame:
    """Ticks whose price is a walk: every row's discount is a step, up or down.

    The running sum is taken in two levels, days first and rows within a day, so
    that a symbol's whole history is never in one sort.
    """
    rows = lineitem.select(
        F.col("l_returnflag").alias(SYMBOL),
        F.to_date("l_shipdate").alias(DATE),
        *WALK_ORDER,
        F.col("l_quantity").alias("size"),
        (F.round(F.col("l_discount") * 100).cast("int") - 5).alias("step"),
    ).repartition(SYMBOL, DATE)
    days = rows.groupBy(SYMBOL, DATE).agg(F.sum("step").alias("total"))
    before = Window.partitionBy(SYMBOL).orderBy(DATE).rowsBetween(Window.unboundedPreceding, -1)
    days = days.select(F.col(SYMBOL).alias("_s"), F.col(DATE).alias("_d"), F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy(SYMBOL, DATE).orderBy(*WALK_ORDER).rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.join(days, (F.col(SYMBOL) == F.col("_s")) & (F.col(DATE) == F.col("_d")))
    price = F.round(100 * F.exp(0.002 * (F.col("base") + F.sum("step").over(within))), 4)
    return placed.select(SYMBOL, DATE, *WALK_ORDER, "size", price.alias("price"))


def walk_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekday bars of the walk over ``lineitem``."""
    ticks = walk_ticks(spark.read.parquet(f"{sf_dir}/lineitem.parquet"))
    return resample(ticks, F.col(DATE), *WALK_ORDER).where(~F.dayofweek(DATE).isin(1, 7))


def hourly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of the event values, a symbol per event type."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    ticks = events.select(F.col("event_type").alias(SYMBOL), "ts", "event_id", F.col("value").alias("price"), F.lit(1).alias("size"))
    return resample(ticks.where("price is not null"), F.date_trunc("hour", "ts"), "ts", "event_id")


def scan(bars: DataFrame, symbol: str, start: str, end: str, must_exist: bool = True) -> DataFrame:
    """One symbol's bars, both ends included. The symbol and the range reach the
    files' own filters; ``must_exist`` asks for a row and raises if there is none."""
    found = bars.where((F.col(SYMBOL) == symbol) & F.col(DATE).between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    if must_exist and found.isEmpty():
        raise ValueError(f"no bars of {symbol} between {start} and {end}")
    return found


def coverage(bars: DataFrame) -> DataFrame:
    """symbol, start, end of what is there."""
    return bars.groupBy(SYMBOL).agg(F.min(DATE).alias("start"), F.max(DATE).alias("end"))


def covered(instruments: DataFrame, symbol: str) -> tuple[date, date] | None:
    """The first range listed for a symbol, whatever its case; None if unlisted."""
    row = instruments.where(F.upper(SYMBOL) == symbol.strip().upper()).select("start", "end").first()
    return None if row is None else (row["start"], row["end"])


def check_coverage(instruments: DataFrame, symbol: str, start: date, end: date) -> None:
    have = covered(instruments, symbol)
    if have is None:
        raise ValueError(f"{symbol} is not listed")
    if end > have[1]:
        raise ValueError(f"{symbol} ends on {have[1]}, before {end}")
    if start < have[0]:
        raise ValueError(f"{symbol} starts on {have[0]}, after {start}")


def sector_table(spark: SparkSession, sectors: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(sector, symbol), as many rows as the given map has members."""
    sectors = SECTORS if sectors is None else sectors
    rows = [(k, s.strip().upper()) for k, members in sectors.items() for s in members]
    return spark.createDataFrame(rows, "sector string, symbol string")


def sector_members(instruments: DataFrame, sectors: DataFrame) -> DataFrame:
    """Instruments with their sector; the map is a literal table, so broadcast."""
    return instruments.join(F.broadcast(sectors), SYMBOL).select("sector", SYMBOL, "start", "end")


def universe(sectors: DataFrame) -> DataFrame:
    """All members of all sectors, once each."""
    return sectors.select(F.upper(F.trim(SYMBOL)).alias(SYMBOL)).distinct()


def in_universe(bars: DataFrame, symbols: DataFrame) -> DataFrame:
    return bars.join(F.broadcast(symbols), SYMBOL, "left_semi")


def read_csv(spark: SparkSession, path: str, index: str | None = None, symbol: str | None = None) -> DataFrame:
    """A bar file: header names in lower case, the ``index`` column (the first if
    None) as dt, other columns passed on. NaN and infinities become null."""
    raw = spark.read.csv(path, header=True, inferSchema=True)
    raw = raw.toDF(*[c.lower() for c in raw.columns])
    index = raw.columns[0] if index is None else index.lower()
    if index not in raw.columns:
        raise ValueError(f"no column {index} in {path}")
    rest = [c for c in raw.columns if c not in (index, SYMBOL)]
    named = F.lit(symbol) if symbol is not None else F.col(SYMBOL) if SYMBOL in raw.columns else F.lit("")
    bars = raw.select(named.alias(SYMBOL), F.to_date(index).alias(DATE), *rest)
    numbers = [c for c in ("open", "high", "low", "close", "volume") if c in rest]
    return finite(bars.withColumns({c: F.col(c).cast("double") for c in numbers}), *numbers)


def read_instruments(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated symbol, start, end without a header; short lines are left out."""
    return spark.read.csv(path, sep="\t", schema=INSTRUMENT, mode="DROPMALFORMED").where("symbol is not null and start is not null and end is not null")


def read_config(path: str) -> dict:
    return json.loads(Path(path).read_text())


def write_bars(bars: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet with a folder per symbol; rows are dealt by symbol first, so each
    folder gets few files."""
    bars.repartition(SYMBOL).sortWithinPartitions(SYMBOL, DATE).write.mode(mode).partitionBy(SYMBOL).parquet(path)


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BAR).parquet(path)


def write_sectors(members: DataFrame, path: str) -> None:
    """A folder per sector, each sorted by symbol, tab-separated."""
    rows = members.repartition("sector").sortWithinPartitions("sector", SYMBOL)
    rows.write.mode("overwrite").partitionBy("sector").csv(path, sep="\t")


def build(spark: SparkSession, config: BuildConfig, bars: DataFrame) -> DataFrame:
    """A store under ``data_root`` from ``bars`` of any source: the universe's bars in
    the range (``bars``), their coverage (``instruments``) and sector lists
    (``sectors``). A refresh replaces what is there, else only days that a symbol does
    not have yet are added. Returns the instruments."""
    listed = spark.createDataFrame([(s,) for s in config.symbols], "symbol string")
    wanted = bars.withColumn(SYMBOL, F.upper(F.trim(SYMBOL))).where(F.col(DATE).between(F.lit(config.start), F.lit(config.end)))
    wanted = in_universe(wanted, listed).select(SYMBOL, DATE, "open", "high", "low", "close", "volume")
    folder = f"{config.data_root.rstrip('/')}/bars"
    if not config.force_refresh and exists(spark, folder):
        wanted = wanted.join(read_bars(spark, folder).select(SYMBOL, DATE), [SYMBOL, DATE], "left_anti")
    write_bars(wanted, folder, config.mode)
    instruments = stored(coverage(read_bars(spark, folder)))
    instruments.write.mode("overwrite").csv(f"{config.data_root.rstrip('/')}/instruments", sep="\t")
    write_sectors(sector_members(instruments, sector_table(spark, config.sectors)), f"{config.data_root.rstrip('/')}/sectors")
    return instruments


def exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.schema(BAR).parquet(path)
    except AnalysisException:
        return False
    return True


def open_store(spark: SparkSession, data_root: str) -> tuple[DataFrame, DataFrame]:
    """Bars and instruments of a built store; an error that names the builder if there
    is none."""
    root = data_root.rstrip("/")
    if not exists(spark, f"{root}/bars"):
        raise FileNotFoundError(f"no bars under {root}; build them with: python -m quillbar.build --data-root {root} --source CSV")
    return read_bars(spark, f"{root}/bars"), read_instruments(spark, f"{root}/instruments")


def work_folder(spark: SparkSession, kind: str) -> str:
    """A new folder that driver and executors share: under spark.checkpoint.dir,
    or where that is unset under the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/{kind}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, for results that several
    passes read."""
    path = work_folder(df.sparkSession, "tables")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
