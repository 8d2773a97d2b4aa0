"""How good a factor and a position are: IC and rank-IC per date, returns and drawdown.

Everything is a summary that merges. Ranks come from counts of equal values, added up
over range partitions; correlations from moments. A drawdown is merged from chunks of a
history: of each its growth, its highest and lowest value against its start, and the
deepest fall inside it, so that no series is gathered.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import chunks
from ..functions.chunks import CHUNK, OWN, ROLE
from ..functions.kernels import DATE, SYMBOL, prev, ratio, within
from ..sources.bars import stored

#: Trading days of a year.
YEAR = 252


def mean_ranks(df: DataFrame, value: str, out: str, by: tuple[str, ...] = (DATE,)) -> DataFrame:
    """``df`` with ``out``, the rank of ``value`` (from 1, equal values share their mean
    rank) within ``by``; null values have none. Values are counted before the shuffle,
    and a group, however large, is ranked in many partitions."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    dealt = stored(counts.repartitionByRange(*by, value).withColumn("_part", F.spark_partition_id()))
    held = dealt.groupBy(*by, "_part").agg(F.sum("_n").alias("_held"))
    before = (Window.unboundedPreceding, -1)
    first = F.sum("_held").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(*before))
    upto = F.sum("_n").over(Window.partitionBy(*by, "_part").orderBy(value).rowsBetween(*before))
    held = held.select(*by, "_part", F.coalesce(first, F.lit(0)).alias("_first"))
    placed = dealt.withColumn("_upto", F.coalesce(upto, F.lit(0)))
    same = [placed[c].eqNullSafe(held[c]) for c in (*by, "_part")]
    ranks = placed.join(held, same).select(*[placed[c].alias(f"_key_{c}") for c in (*by, value)], (F.col("_first") + F.col("_upto") + (F.col("_n") + 1) / 2).alias(out))
    on = [df[c].eqNullSafe(ranks[f"_key_{c}"]) for c in (*by, value)]
    return df.join(ranks, on, "left").select(*[df[c] for c in df.columns], out)


def correlation(x: str, y: str) -> Column:
    """Of the rows that have both; null where either does not vary, as one row does not."""
    return F.when(F.count(F.when(F.col(y).isNotNull(), F.col(x))) > 1, ratio(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def information(df: DataFrame, factor: str, gain: str) -> DataFrame:
    """dt, n, ic, rank_ic of a factor and what was gained after it, over the symbols of a
    date; rows that lack either are left out."""
    rows = df.where(F.col(factor).isNotNull() & F.col(gain).isNotNull()).select(DATE, F.col(factor).alias("x"), F.col(gain).alias("y"))
    ranked = mean_ranks(mean_ranks(stored(rows), "x", "rx"), "y", "ry")
    return ranked.groupBy(DATE).agg(F.count("*").alias("n"), correlation("x", "y").alias("ic"), correlation("rx", "ry").alias("rank_ic"))


def information_summary(per_date: DataFrame) -> DataFrame:
    """kind (ic, rank_ic), dates, mean, std, ratio (mean / std), positive (share)."""
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("v")) for k in ("ic", "rank_ic")])).alias("k")
    rows = per_date.select(kinds).select("k.kind", "k.v").where("v is not null")
    found = rows.groupBy("kind").agg(F.count("*").alias("dates"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.avg((F.col("v") > 0).cast("double")).alias("positive"))
    return found.withColumn("ratio", ratio(F.col("mean"), F.col("std")))


def strategy_returns(df: DataFrame, position: str = "position", size: int | None = None, divide: Callable[[Column, Column], Column] = ratio) -> DataFrame:
    """symbol, dt, _chunk, held, traded, r of rows with close and a position: what the
    position of the day before gains today, and by how much that was changed. Days after a
    close of 0 are left out; with ``divide`` = quotient they stay, as NaN or infinite."""
    placed, _ = chunks.dealt(stored(df.select(SYMBOL, DATE, "close", F.col(position).alias("p"))), size=size, cold=2)
    with within(SYMBOL, CHUNK):
        held, gain = prev("p"), divide(F.col("close"), prev("close")) - 1
        made = placed.withColumns({"held": held, "traded": F.abs(held - F.coalesce(prev("p", 2), F.lit(0.0))), "r": held * gain})
    return made.where((F.col(ROLE) == OWN) & F.col("r").isNotNull()).select(SYMBOL, DATE, CHUNK, "held", "traded", "r")


def drawdowns(returns: DataFrame) -> DataFrame:
    """symbol, growth, max_drawdown (0 or less) of strategy returns, by their chunks. A loss of
    all is a growth of 0; behind a return that is NaN, falls are not known and count for
    nothing, and the growth is NaN."""
    log = F.when(F.col("r") == -1, float("-inf")).otherwise(F.log(1 + F.col("r")))
    upto = Window.partitionBy(SYMBOL, CHUNK).orderBy(DATE).rowsBetween(Window.unboundedPreceding, 0)
    rows = returns.select(SYMBOL, DATE, CHUNK, F.sum(log).over(upto).alias("at"), log.alias("step"))
    rows = rows.withColumn("fall", F.col("at") - F.max("at").over(upto))
    parts = rows.groupBy(SYMBOL, CHUNK).agg(F.sum("step").alias("all"), F.max("at").alias("top"), F.min("at").alias("low"), F.min("fall").alias("fall"))
    before = Window.partitionBy(SYMBOL).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)  # a row per chunk
    parts = parts.withColumn("start", F.coalesce(F.sum("all").over(before), F.lit(0.0)))
    peak = F.greatest(F.lit(0.0), F.max(F.col("start") + F.col("top")).over(before))
    parts = parts.withColumn("fall", F.when(F.isnan("start"), float("nan")).otherwise(F.least("fall", F.col("start") + F.col("low") - peak)))
    return parts.groupBy(SYMBOL).agg(F.exp(F.sum("all")).alias("growth"), (F.exp(F.least(F.lit(0.0), F.min("fall"))) - 1).alias("max_drawdown"))


def performance(returns: DataFrame) -> DataFrame:
    """symbol, n, growth, annual_return, sharpe, max_drawdown, win_rate, turnover."""
    returns = stored(returns)
    won, held = F.sum((F.col("r") > 0).cast("double")), F.sum((F.col("held") != 0).cast("double"))
    plain = returns.groupBy(SYMBOL).agg(F.count("*").alias("n"), (ratio(F.avg("r"), F.stddev_samp("r")) * YEAR**0.5).alias("sharpe"), ratio(won, held).alias("win_rate"), F.avg("traded").alias("turnover"))
    both = plain.join(drawdowns(returns), SYMBOL)
    return both.select(SYMBOL, "n", "growth", (F.pow("growth", YEAR / F.col("n")) - 1).alias("annual_return"), "sharpe", "max_drawdown", "win_rate", "turnover")
