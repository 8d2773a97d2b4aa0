"""Which groups of features help: a linear classifier for every subset, from one matrix.

Rows are summed up once into a Gram matrix of all features (and a constant) and their sums
by class. Both merge: tasks make one each, and 16 tasks add these up. Every subset's
least-squares classifier with a penalty is then solved from its part of the matrix, and
all subsets are scored together in one more pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .metrics import scores

_SUMS = "part int, sums array<double>"


def _matrix(batch: pa.RecordBatch, columns: list[str]) -> np.ndarray:
    """Features as numbers, and a constant behind them."""
    held = [batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.float64) for c in columns]
    return np.stack([*held, np.ones(batch.num_rows)], axis=1)


def gram(rows: DataFrame, columns: list[str], classes: int, label: str = "label") -> tuple[np.ndarray, np.ndarray]:
    """The matrix x'x and the class sums x'y of rows without nulls."""
    width = len(columns) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width + classes))
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch, columns)
                y = np.eye(classes)[batch.column(batch.schema.get_field_index("_y")).to_numpy(zero_copy_only=False)]
                total += np.concatenate((x.T @ x, x.T @ y), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], names=["part", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width * (width + classes))
        for batch in batches:
            for sums in batch.column("sums"):
                total += sums.values.to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([total.tolist()], pa.list_(pa.float64()))], names=["part", "sums"])

    whole = rows.na.drop(subset=[*columns, label]).select(*[F.col(c).cast("double").alias(c) for c in columns], F.col(label).cast("int").alias("_y"))
    sums = whole.mapInArrow(run, _SUMS).withColumn("part", F.spark_partition_id())
    sums = sums.repartition(16, F.pmod("part", F.lit(16))).sortWithinPartitions("part").mapInArrow(add, _SUMS)
    total = np.sum([r["sums"] for r in sums.collect()], axis=0).reshape(width, width + classes)  # 16 rows
    return total[:, :width], total[:, width:]


def solved(matrix: np.ndarray, sums: np.ndarray, subset: list[int], penalty: float = 1.0) -> np.ndarray:
    """Weights [features and constant, classes] of a subset; zero for all other features.
    The constant is not penalised."""
    held = [*subset, len(matrix) - 1]
    part = matrix[np.ix_(held, held)] + penalty * np.diag([1.0] * len(subset) + [0.0])
    weights = np.zeros((len(matrix), sums.shape[1]))
    weights[held] = np.linalg.lstsq(part, sums[held], rcond=None)[0]
    return weights


def compared(rows: DataFrame, columns: list[str], subsets: dict[str, list[str]], classes: int, label: str = "label", penalty: float = 1.0) -> DataFrame:
    """subset, split, accuracy, macro_f1 of classifiers that were fitted on the split
    ``train``, a row per subset and split."""
    matrix, sums = gram(rows.where("split = 'train'"), columns, classes, label)
    weights = {name: solved(matrix, sums, [columns.index(c) for c in held], penalty) for name, held in subsets.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch, columns)
            for name, w in weights.items():
                pred = (x @ w).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array([name] * batch.num_rows, pa.string()), batch.column(batch.schema.get_field_index("split")), batch.column(batch.schema.get_field_index("_y")), pa.array(pred, pa.int64())], names=["subset", "split", "y", "pred"])

    whole = rows.where("split is not null").na.drop(subset=[*columns, label])
    whole = whole.select("split", F.col(label).cast("long").alias("_y"), *[F.col(c).cast("double").alias(c) for c in columns])
    return scores(whole.mapInArrow(run, "subset string, split string, y long, pred long"), classes, ("subset", "split"))
