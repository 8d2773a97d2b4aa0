"""Classification metrics over (y, pred)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EPS = 1e-9


def confusion(predictions: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, y, pred, n): all other metrics need no more than these few rows."""
    return predictions.groupBy(*by, F.col("y").cast("long").alias("y"), F.col("pred").cast("long").alias("pred")).agg(F.count("*").alias("n"))


def accuracy(predictions: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Share of hits; null over no rows."""
    counts = confusion(predictions, by)
    hits = F.sum(F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(0))
    return counts.groupBy(*by).agg(F.try_divide(hits.cast("double"), F.sum("n").cast("double")).alias("accuracy"))


def per_class(predictions: DataFrame, classes: int, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, class, tp, fp, fn, f1) for all ``classes``; one that never occurs has 0."""
    counts = confusion(predictions, by)
    every = F.explode(F.sequence(F.lit(0), F.lit(classes - 1)).cast("array<bigint>")).alias("class")
    y, pred = F.col("y") == F.col("class"), F.col("pred") == F.col("class")
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    found = counts.select("*", every).groupBy(*by, "class").agg(count(y & pred).alias("tp"), count(~y & pred).alias("fp"), count(y & ~pred).alias("fn"))
    p, r = F.col("tp") / (F.col("tp") + F.col("fp") + EPS), F.col("tp") / (F.col("tp") + F.col("fn") + EPS)
    return found.withColumn("f1", 2 * p * r / (p + r + EPS))


def macro_f1(predictions: DataFrame, classes: int, by: tuple[str, ...] = ()) -> DataFrame:
    """The plain mean over all ``classes``."""
    return per_class(predictions, classes, by).groupBy(*by).agg(F.avg("f1").alias("macro_f1"))


def scores(predictions: DataFrame, classes: int, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, accuracy, macro_f1) from one pass over the predictions."""
    y, pred, n = F.col("y").cast("long"), F.col("pred").cast("long"), F.lit(1).cast("long")
    count = lambda c: F.coalesce(F.sum(F.when(c, n)), F.lit(0))
    kinds = {"tp": lambda k: (y == k) & (pred == k), "fp": lambda k: (y != k) & (pred == k), "fn": lambda k: (y == k) & (pred != k)}
    found = predictions.groupBy(*by).agg(count(y == pred).alias("hits"), F.count("*").alias("all"), *[count(f(k)).alias(f"{name}{k}") for name, f in kinds.items() for k in range(classes)])
    total = F.lit(0.0)
    for k in range(classes):
        p, r = F.col(f"tp{k}") / (F.col(f"tp{k}") + F.col(f"fp{k}") + EPS), F.col(f"tp{k}") / (F.col(f"tp{k}") + F.col(f"fn{k}") + EPS)
        total = total + 2 * p * r / (p + r + EPS)
    return found.select(*by, F.try_divide(F.col("hits").cast("double"), F.col("all").cast("double")).alias("accuracy"), (total / classes).alias("macro_f1"))


def bincount(df: DataFrame, column: str, classes: int) -> DataFrame:
    every = df.sparkSession.range(classes).select(F.col("id").cast("int").alias("y"))
    seen = df.groupBy(F.col(column).cast("int").alias("y")).agg(F.count("*").alias("n"))
    return every.join(seen, "y", "left").na.fill(0, ["n"])


def weighted_loss(batches: DataFrame) -> DataFrame:
    """Mean of per-batch losses (loss, n) weighed by their sample counts."""
    return batches.agg(F.try_divide(F.sum(F.col("loss") * F.col("n")), F.sum("n").cast("double")).alias("loss"))
