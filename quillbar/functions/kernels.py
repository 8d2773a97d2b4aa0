"""Column kernels over one symbol's rows in date order.

Everything here is a plain Column: NaN never enters a plan, a zero denominator
gives null, and a rolling value is null until its window is full of non-nulls.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

SYMBOL, DATE = "symbol", "dt"


_KEYS: ContextVar[tuple[str, ...]] = ContextVar("keys", default=(SYMBOL,))


@contextmanager
def within(*keys: str) -> Iterator[None]:
    """Columns made in here take the rows of ``keys`` together, not of a symbol."""
    token = _KEYS.set(keys)
    try:
        yield
    finally:
        _KEYS.reset(token)


def by_date() -> WindowSpec:
    return Window.partitionBy(*_KEYS.get()).orderBy(DATE)


def prev(x: Column | str, n: int = 1) -> Column:
    return F.lag(x, n).over(by_date())


def following(x: Column | str, n: int = 1) -> Column:
    return F.lead(x, n).over(by_date())


def change(x: str) -> Column:
    return F.col(x) - prev(x)


def rolling(f: Callable[[Column], Column], x: Column | str, n: int) -> Column:
    """``f`` over the last ``n`` rows; null unless all ``n`` values are there."""
    column = F.col(x) if isinstance(x, str) else x
    frame = by_date().rowsBetween(-(n - 1), 0)
    return F.when(F.count(column).over(frame) == n, f(column).over(frame))


def rsum(x: Column | str, n: int) -> Column:
    return rolling(F.sum, x, n)


def mean(x: Column | str, n: int) -> Column:
    return rolling(F.avg, x, n)


def highest(x: Column | str, n: int) -> Column:
    return rolling(F.max, x, n)


def lowest(x: Column | str, n: int) -> Column:
    return rolling(F.min, x, n)


def deviation(x: Column | str, n: int) -> Column:
    """Sample standard deviation (n - 1)."""
    return rolling(F.stddev_samp, x, n)


def ratio(a: Column, b: Column) -> Column:
    """a / b; null where b is 0 or either is null."""
    return F.try_divide(a, b)


def quotient(a: Column, b: Column) -> Column:
    """a / b as IEEE 754 and DuckDB have it: infinite where only b is 0, NaN where both
    are; null where either is null. Zeros have no sign."""
    by_zero = F.when((a == 0) | F.isnan(a), float("nan")).when(a > 0, float("inf")).otherwise(float("-inf"))
    return F.when(a.isNull() | b.isNull(), None).when(b == 0, by_zero).otherwise(F.try_divide(a, b))


def where(condition: Column, value: Column, otherwise: float = 0.0) -> Column:
    """``value`` where the condition is true; false and null give ``otherwise``."""
    return F.when(condition, value).otherwise(F.lit(otherwise))


def at_least(x: Column, low: float) -> Column:
    """x clipped from below; null stays null (greatest would skip it)."""
    return F.when(x < low, F.lit(low)).otherwise(x)


def yes(condition: Column) -> Column:
    """A boolean that is never null."""
    return F.coalesce(condition, F.lit(False))


def crossed_up(a: str, b: str) -> Column:
    """a is above b and was not a row ago."""
    return yes((F.col(a) > F.col(b)) & (prev(a) <= prev(b)))


def turns_positive(x: str) -> Column:
    """Below zero a row ago and above zero a row ahead (looks ahead)."""
    return yes((prev(x) < 0) & (following(x) > 0))


def gap_days() -> Column:
    """Calendar days without a row since the row before."""
    return F.datediff(DATE, prev(DATE)) - 1


def finite(df: DataFrame, *columns: str) -> DataFrame:
    """NaN and infinities become null, so that they never reach a comparison."""
    bad = lambda c: F.isnan(c) | (F.abs(c) == float("inf"))
    return df.withColumns({c: F.when(~bad(F.col(c)), F.col(c)) for c in columns})


def runs(df: DataFrame, flag: str) -> DataFrame:
    """Maximal stretches of rows where ``flag`` is true: symbol, start_dt, end_dt,
    n_rows. A stretch is known by its distance between two running numbers."""
    numbered = df.select(SYMBOL, DATE, flag, F.row_number().over(by_date()).alias("at"))
    inside = numbered.where(flag).withColumn("island", F.col("at") - F.row_number().over(by_date()))
    return inside.groupBy(SYMBOL, "island").agg(F.min(DATE).alias("start_dt"), F.max(DATE).alias("end_dt"), F.count("*").alias("n_rows")).drop("island")
