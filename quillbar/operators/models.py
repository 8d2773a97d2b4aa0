"""A baseline classifier on samples, its scoring and evaluation.

Deep nets are scored through score(): any function from an array of samples to
class scores, run over Arrow batches. Training here is Spark's own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import SPLITS, Samples, apply_scaler, class_weights, feature_columns, model_frame, sliding_windows
from .indicators import Params
from .metrics import scores


def flat(samples: DataFrame) -> DataFrame:
    """Samples with ``x``, the window's cells as one vector."""
    return samples.withColumn("x", array_to_vector(F.transform(F.flatten("features"), lambda v: v.cast("double"))))


def train(samples: DataFrame, classes: int, rounds: int = 20, penalty: float = 0.1) -> LogisticRegressionModel:
    """A multinomial regression, its loss weighed by class."""
    weights = class_weights(samples, classes, "y").select("y", "weight")
    rows = flat(samples).join(F.broadcast(weights), "y").select(F.col("y").cast("double").alias("label"), "x", "weight")
    return LogisticRegression(featuresCol="x", labelCol="label", weightCol="weight", maxIter=rounds, regParam=penalty, family="multinomial").fit(rows)


def predict(model: LogisticRegressionModel, samples: DataFrame) -> DataFrame:
    """symbol, split, end_dt, y, pred."""
    return model.transform(flat(samples)).select("symbol", "split", "end_dt", "y", F.col("prediction").cast("long").alias("pred"))


def score(samples: DataFrame, classify: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Like predict(), by any function from [n, window, features] to [n, classes]."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            if len(p):
                x = np.stack([np.stack([np.asarray(r, dtype=np.float32) for r in s]) for s in p["features"]])
                yield p[["symbol", "split", "end_dt", "y"]].assign(pred=classify(x).argmax(axis=1).astype(np.int64))

    return samples.mapInPandas(run, "symbol string, split string, end_dt date, y long, pred long")


def evaluate(model: LogisticRegressionModel, samples: DataFrame, classes: int) -> DataFrame:
    """split, accuracy, macro_f1 from one pass over the samples."""
    return scores(predict(model, samples), classes, ("split",))


def select(samples: DataFrame, classes: int, penalties: tuple[float, ...] = (0.1, 1.0), rounds: int = 20) -> tuple[LogisticRegressionModel, float]:
    """The model whose macro-F1 on the split ``val`` is best (of equal ones the first),
    and that figure. Models are trained on the split ``train``."""
    best, top = None, -1.0
    held = samples.where("split = 'val'")
    for penalty in penalties:
        model = train(samples.where("split = 'train'"), classes, rounds, penalty)
        found = evaluate(model, held, classes).first()
        value = 0.0 if found is None else found["macro_f1"]
        if value > top:
            best, top = model, value
    return best, top


def parameters(model: LogisticRegressionModel) -> int:
    """How many numbers were trained."""
    rows, columns = model.coefficientMatrix.numRows, model.coefficientMatrix.numCols
    return rows * columns + len(model.interceptVector)


def save(model: LogisticRegressionModel, scaler: DataFrame, folder: str, config: Samples | None = None) -> None:
    """A checkpoint: the model, the scaler it was trained with and the samples' shape."""
    config = config or Samples()
    model.write().overwrite().save(f"{folder}/model")
    scaler.write.mode("overwrite").parquet(f"{folder}/scaler")
    shape = scaler.sparkSession.range(1).select(F.lit(config.window).alias("window"), F.lit(config.label_mode).alias("label_mode"))
    shape.write.mode("overwrite").parquet(f"{folder}/config")


def load(spark: SparkSession, folder: str) -> tuple[LogisticRegressionModel, DataFrame, Samples]:
    shape = spark.read.parquet(f"{folder}/config").first()
    scaler = spark.read.parquet(f"{folder}/scaler")
    return LogisticRegressionModel.load(f"{folder}/model"), scaler, Samples(shape["window"], shape["label_mode"])


def evaluate_saved(bars: DataFrame, folder: str, splits: dict[str, tuple[str, str]] = SPLITS, params: Params | None = None) -> DataFrame:
    """Bars scored by a checkpoint: its scaler is applied, none is fitted."""
    model, scaler, config = load(bars.sparkSession, folder)
    columns = feature_columns()
    frame = apply_scaler(model_frame(bars, splits, config.label_mode, params), scaler, columns)
    return evaluate(model, sliding_windows(frame, columns, config.window), 2 if config.label_mode == "binary" else 3)
