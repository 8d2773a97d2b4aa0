"""From features to samples: label, split, scale, slide.

The order matters: rows are cleaned before they are labelled, and labelled before
they are split, so a label near a split's end may look into the next split.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import chunks
from ..functions.chunks import CHUNK, OWN, ROLE
from ..functions.kernels import DATE, SYMBOL
from ..sources.bars import stored
from .indicators import Params, feature_columns, features
from .labels import binary, label_worst, multiclass

# Split ranges of the default experiment, both ends included.
SPLITS = {"train": ("2014-01-01", "2022-12-31"), "val": ("2023-01-01", "2023-12-31"), "test": ("2024-01-01", "2024-12-31")}


@dataclass(frozen=True)
class Samples:
    window: int = 120
    label_mode: str = "binary"
    params: Params | None = None


def split_of(splits: dict[str, tuple[str, str]]) -> Column:
    """The name of the range a date lies in, else null."""
    found = F.lit(None).cast("string")
    for name, (start, end) in reversed(splits.items()):
        found = F.when(F.col(DATE).between(F.lit(start).cast("date"), F.lit(end).cast("date")), name).otherwise(found)
    return found


def model_frame(bars: DataFrame, splits: dict[str, tuple[str, str]] = SPLITS, label_mode: str = "binary", params: Params | None = None) -> DataFrame:
    """Features, label and split of every clean row."""
    if label_mode not in ("binary", "multiclass"):
        raise ValueError(f"no label mode {label_mode}")
    labelled = label_worst(features(bars, params))
    label = binary() if label_mode == "binary" else multiclass()
    return labelled.withColumn("label", label.cast("int")).withColumn("split", split_of(splits))


def fit_scaler(train: DataFrame, columns: list[str]) -> DataFrame:
    """feature, mean, std (population; 1 where it is below 1e-8): a row per
    feature, from one pass over the training rows as single-precision floats."""
    x = {c: F.col(c).cast("float").cast("double") for c in columns}
    one = train.agg(*[F.struct(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std")).alias(c) for c, v in x.items()])
    long = one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c)["mean"].alias("mean"), F.col(c)["std"].alias("std")) for c in columns])).alias("f"))
    return long.select("f.feature", "f.mean", F.when(F.col("f.std") < 1e-8, 1.0).otherwise(F.col("f.std")).alias("std"))


@dataclass(frozen=True)
class Fold:
    """Months that a fold trains on, both included; ``out``: the group it leaves out."""

    name: str
    start: date
    end: date
    out: str | None = None


def rolling_folds(first: int, last: int, years: int = 3, behind: int = 2) -> list[Fold]:
    """Folds of ``years`` whole years each, a year apart, that leave ``behind`` years for
    validation and test."""
    return [Fold(str(y), date(y, 1, 1), date(y + years - 1, 12, 1)) for y in range(first, last - years - behind + 2)]


def grouped_folds(folds: list[Fold], groups: list[str]) -> list[Fold]:
    """Each fold once without each group."""
    return [replace(f, name=f"{f.name}-{g}", out=g) for f in folds for g in groups]


def month_moments(frame: DataFrame, columns: list[str], group: str = SYMBOL) -> DataFrame:
    """month, grp, feature, n, mean, m2 (sum of squared distances from the mean): what is
    kept of the rows, from one pass over them."""
    x = {c: F.col(c).cast("float").cast("double") for c in columns}
    of = lambda c, v: F.struct(F.lit(c).alias("feature"), F.count(v).alias("n"), F.avg(v).alias("mean"), (F.var_pop(v) * F.count(v)).alias("m2"))
    wide = frame.groupBy(F.trunc(DATE, "month").alias("month"), F.col(group).alias("grp")).agg(*[of(c, v).alias(c) for c, v in x.items()])
    return wide.select("month", "grp", F.inline(F.array(*columns)))


def fold_scalers(moments: DataFrame, folds: list[Fold]) -> DataFrame:
    """fold, feature, n, mean, std of every fold, merged from months: rows are not read
    again, nor multiplied by folds."""
    schema = "fold string, first date, last date, out string"
    listed = F.broadcast(moments.sparkSession.createDataFrame([(f.name, f.start, f.end, f.out) for f in folds], schema))  # a literal table
    of_fold = F.col("month").between(F.col("first"), F.col("last")) & (F.col("out").isNull() | (F.col("grp") != F.col("out")))
    parts = moments.where("n > 0").join(listed, of_fold)
    whole = parts.groupBy("fold", "feature").agg(F.sum("n").alias("_n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("_mean"))
    around = F.col("m2") + F.col("n") * F.pow(F.col("mean") - F.col("_mean"), F.lit(2.0))
    merged = parts.join(whole, ["fold", "feature"]).groupBy("fold", "feature").agg(F.first("_n").alias("n"), F.first("_mean").alias("mean"), F.sqrt(F.sum(around) / F.first("_n")).alias("std"))
    return merged.withColumn("std", F.when(F.col("std") < 1e-8, 1.0).otherwise(F.col("std")))


def apply_scaler(df: DataFrame, scaler: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` as (x - mean) / std in single precision. The scaler has a row per
    feature; it is broadcast as one row with two columns a feature."""
    of = lambda c, what: F.max(F.when(F.col("feature") == c, F.col(what))).alias(f"_{what}_{c}")
    stats = scaler.agg(*[of(c, what) for c in columns for what in ("mean", "std")])
    joined = df.join(F.broadcast(stats), how="cross")
    scaled = {c: ((F.col(c).cast("float") - F.col(f"_mean_{c}")) / F.col(f"_std_{c}")).cast("float").alias(c) for c in columns}
    return joined.select(*[scaled.get(c, F.col(c)) for c in df.columns])


def sliding_windows(df: DataFrame, columns: list[str], window: int = 120, by: tuple[str, ...] = (SYMBOL, "split"), size: int | None = None) -> DataFrame:
    """(symbol, split, end_dt, features, y): the last ``window`` rows of a split,
    a sample per row with a label; samples with a null cell and rows outside all
    splits are left out. A task holds chunks of ``size`` rows with ``window`` - 1 from
    before. Reads df twice: the second time for its rows, the first for their number."""
    rows = df.where(F.col("split").isNotNull())
    placed, _ = chunks.dealt(rows.select(*by, DATE, "label", *columns), by, size, cold=window - 1)
    cells = [F.col(c).cast("float") for c in columns]
    whole = reduce(lambda a, b: a & b, [x.isNotNull() & ~F.isnan(x) for x in cells]).cast("int")
    placed = placed.select(*by, CHUNK, ROLE, DATE, "label", F.array(*cells).alias("_row"), whole.alias("_whole"))
    frame = Window.partitionBy(*by, CHUNK).orderBy(DATE).rowsBetween(-(window - 1), 0)
    made = placed.withColumns({"features": F.collect_list("_row").over(frame), "_full": F.sum("_whole").over(frame)})
    made = made.where((F.col(ROLE) == OWN) & (F.col("_full") == window) & F.col("label").isNotNull())
    return made.select(*by, F.col(DATE).alias("end_dt"), "features", F.col("label").cast("long").alias("y"))


def samples(bars: DataFrame, splits: dict[str, tuple[str, str]] = SPLITS, config: Samples | None = None) -> DataFrame:
    """Bars to samples: cleaned, labelled, split, scaled by the training rows. The
    frame is written once, for the scaler's fit and its application."""
    config = config or Samples()
    columns = feature_columns()
    frame = stored(model_frame(bars, splits, config.label_mode, config.params))
    scaler = fit_scaler(frame.where("split = 'train'"), columns)
    return sliding_windows(apply_scaler(frame, scaler, columns), columns, config.window)


def class_weights(df: DataFrame, classes: int, label: str = "label") -> DataFrame:
    """y, n, weight: total / (classes * n), with n at least 1 and negative labels
    counted as class 0."""
    y = F.greatest(F.col(label).cast("int"), F.lit(0))
    seen = df.where(F.col(label).isNotNull()).groupBy(y.alias("y")).agg(F.count("*").alias("n"))
    spark = df.sparkSession
    every = spark.range(classes).select(F.col("id").cast("int").alias("y"))
    counted = every.join(seen, "y", "left").select("y", F.greatest(F.coalesce("n", F.lit(0)), F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))  # a row per class
    return counted.select("y", "n", (total / (classes * F.col("n"))).alias("weight"))


def batches(samples: DataFrame, size: int, keys: tuple[str, ...] = ("end_dt", SYMBOL), seed: int | None = None) -> DataFrame:
    """``samples`` with ``batch``: numbers of batches of ``size`` rows in the order of
    ``keys`` (unique together), or shuffled by ``seed``; the last batch may be smaller.

    Rows are numbered within range partitions, whose sizes (a row per partition) give
    the offsets; no task sees more than its partition.
    """
    order = [F.xxhash64(F.lit(seed), *keys), *keys] if seed is not None else list(keys)
    placed = samples.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stored(placed.select("*", F.monotonically_increasing_id().alias("_at")))
    part, at = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_part", before.alias("_before"))
    numbered = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")  # a row per partition
    return numbered.select(*samples.columns, F.floor((at + F.col("_before")) / size).cast("long").alias("batch"))
