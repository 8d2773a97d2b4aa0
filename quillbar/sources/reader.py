"""Bars by ``spark.read.format("quillbar")`` and ``spark.readStream``, from any fetcher.

A fetcher lists instruments (symbol, first and last day) and hands out one symbol's bars
of a range. The reader makes a partition per symbol and range of days, so requests run
on as many executors as there are; filters on symbol and date that Spark pushes down
leave out whole partitions and narrow the others before anything is asked for. A stream
keeps the last day of every symbol as its offset, so symbols may be behind each other.

Options: ``path`` or whatever the fetcher needs; ``fetcher`` ("module:Class", made from
the options); ``symbols`` (separated by commas), ``start``, ``end`` (both included);
``days`` of a partition; ``retries`` after an error, each waiting ``delay`` seconds more;
``push`` (true: filters reach the source).

Spark 4.1 keeps what it has pushed down with the frame that was loaded, and uses it again
for a later query of that frame without filters. So pushing has to be asked for, and
``bars_from`` loads a frame for every call: take one frame per filter.
"""

from __future__ import annotations

import importlib
import time
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace
from datetime import date, timedelta
from typing import Protocol
from urllib.parse import quote

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv
import pyarrow.dataset
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from .bars import BAR

NUMBERS = ("open", "high", "low", "close", "volume")
_BAR = pa.schema([("symbol", pa.string()), ("dt", pa.date32()), *[(n, pa.float64()) for n in NUMBERS]])
ONE = timedelta(days=1)


class Fetcher(Protocol):
    def instruments(self) -> Sequence[tuple[str, date, date]]: ...

    def fetch(self, symbol: str, start: date, end: date) -> Iterator[pa.RecordBatch]:
        """dt and numbers of a symbol's bars, both days included."""


class StoreFetcher:
    """A store as ``sources.bars.build`` writes it, at a local path or an address that
    pyarrow opens."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"].rstrip("/")

    def _files(self) -> tuple[pyarrow.fs.FileSystem, str]:
        local = "://" not in self.path and not self.path.startswith("file:")
        return (pyarrow.fs.LocalFileSystem(), self.path) if local else pyarrow.fs.FileSystem.from_uri(self.path)

    def instruments(self) -> list[tuple[str, date, date]]:
        fs, root = self._files()
        found = []
        for f in fs.get_file_info(pyarrow.fs.FileSelector(f"{root}/instruments")):
            if f.is_file and f.size and not f.base_name.startswith(("_", ".")):
                read = pyarrow.csv.ReadOptions(column_names=["symbol", "start", "end"])
                kinds = pyarrow.csv.ConvertOptions(column_types={"symbol": pa.string(), "start": pa.date32(), "end": pa.date32()})
                with fs.open_input_stream(f.path) as file:
                    rows = pyarrow.csv.read_csv(file, read, pyarrow.csv.ParseOptions(delimiter="\t"), kinds).to_pylist()
                found += [(r["symbol"], r["start"], r["end"]) for r in rows]
        return sorted(found)

    def fetch(self, symbol: str, start: date, end: date) -> Iterator[pa.RecordBatch]:
        fs, root = self._files()
        folder = f"{root}/bars/symbol={quote(symbol, safe=' .-_+$@!~,;()&')}"
        files = [f.path for f in fs.get_file_info(pyarrow.fs.FileSelector(folder, allow_not_found=True)) if f.is_file and f.path.endswith(".parquet")]
        if files:
            dt = pc.field("dt")
            yield from pyarrow.dataset.dataset(files, filesystem=fs, format="parquet").to_batches(columns=["dt", *NUMBERS], filter=(dt >= start) & (dt <= end))


@dataclass
class Range(InputPartition):
    symbol: str
    start: date
    end: date


def fetcher_of(options: dict[str, str]) -> Fetcher:
    name = options.get("fetcher")
    if not name:
        return StoreFetcher(options)
    module, _, kind = name.partition(":")
    return getattr(importlib.import_module(module), kind)(options)


def ranges(symbol: str, start: date, end: date, days: int) -> list[Range]:
    made = []
    while start <= end:
        stop = min(end, start + timedelta(days=days - 1))
        made.append(Range(symbol, start, stop))
        start = stop + ONE
    return made


@dataclass
class Wanted:
    """What a read asks for."""

    symbols: frozenset[str] | None
    start: date
    end: date

    @classmethod
    def of(cls, options: dict[str, str]) -> Wanted:
        named = options.get("symbols")
        symbols = None if named is None else frozenset(s.strip().upper() for s in named.split(",") if s.strip())
        return cls(symbols, date.fromisoformat(options.get("start", "0001-01-01")), date.fromisoformat(options.get("end", "9999-12-31")))

    def narrowed(self, f: Filter) -> Wanted | None:
        """With ``f``, if that is one of the filters this can say."""
        column, value = getattr(f, "attribute", None), getattr(f, "value", None)
        if column == ("symbol",) and isinstance(f, (EqualTo, In)):
            names = frozenset([value] if isinstance(f, EqualTo) else value)
            return replace(self, symbols=names if self.symbols is None else self.symbols & names)
        if column == ("dt",) and isinstance(value, date):
            if isinstance(f, EqualTo):
                return replace(self, start=max(self.start, value), end=min(self.end, value))
            if isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                return replace(self, start=max(self.start, value + ONE if isinstance(f, GreaterThan) else value))
            if isinstance(f, (LessThan, LessThanOrEqual)):
                return replace(self, end=min(self.end, value - ONE if isinstance(f, LessThan) else value))
        return None

    def of_instrument(self, symbol: str, start: date, end: date, days: int) -> list[Range]:
        if self.symbols is not None and symbol not in self.symbols:
            return []
        return ranges(symbol, max(start, self.start), min(end, self.end), days)


def fetched(options: dict[str, str], part: Range) -> Iterator[pa.RecordBatch]:
    """A partition's bars. A request that fails is made again before its first batch is
    out; later errors end the task, which Spark runs again."""
    fetcher, retries, delay = fetcher_of(options), int(options.get("retries", 2)), float(options.get("delay", 0.2))
    for attempt in range(retries + 1):
        out = 0
        try:
            for batch in fetcher.fetch(part.symbol, part.start, part.end):
                columns = [pa.array([part.symbol] * batch.num_rows, pa.string()), *[batch.column(n).cast(_BAR.field(n).type) for n in ("dt", *NUMBERS)]]
                yield pa.RecordBatch.from_arrays(columns, schema=_BAR)
                out += 1
            return
        except OSError:
            if out or attempt == retries:
                raise
            time.sleep(delay * (attempt + 1))


class BarReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options, self.wanted = options, Wanted.of(options)

    def partitions(self) -> list[Range]:
        days = int(self.options.get("days", 3660))
        return [r for i in fetcher_of(self.options).instruments() for r in self.wanted.of_instrument(*i, days)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition is not None:  # nothing is wanted
            yield from fetched(self.options, partition)


class PushedReader(BarReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            narrowed = self.wanted.narrowed(f)
            if narrowed is None:
                yield f
            else:
                self.wanted = narrowed


class BarStream(DataSourceStreamReader):
    """Bars behind the last day that was read of each symbol."""

    def __init__(self, options: dict[str, str]) -> None:
        self.options, self.wanted = options, Wanted.of(options)

    def initialOffset(self) -> dict[str, str]:
        return {}

    def latestOffset(self) -> dict[str, str]:
        return {symbol: end.isoformat() for symbol, _, end in fetcher_of(self.options).instruments()}

    def partitions(self, start: dict[str, str], end: dict[str, str]) -> list[Range]:
        made, days = [], int(self.options.get("days", 3660))
        first = {symbol: begin for symbol, begin, _ in fetcher_of(self.options).instruments()}
        for symbol, last in end.items():
            begin = date.fromisoformat(start[symbol]) + ONE if symbol in start else first.get(symbol, date.min)
            made += self.wanted.of_instrument(symbol, begin, date.fromisoformat(last), days)
        return made

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        yield from fetched(self.options, partition)


class BarSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quillbar"

    def schema(self) -> str:
        return BAR

    def reader(self, schema: object) -> BarReader:
        options = dict(self.options)
        return PushedReader(options) if options.get("push", "").lower() == "true" else BarReader(options)

    def streamReader(self, schema: object) -> BarStream:
        return BarStream(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the format known to the session, and lets Spark push filters down to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BarSource)


def bars_from(spark: SparkSession, path: str | None = None, **options: str | int) -> DataFrame:
    """A frame of the format with filters pushed down, for one query."""
    register(spark)
    return spark.read.format("quillbar").options(push="true", **options).load(path)
