"""Training against a plain loop, and a resumed run against an unbroken one."""

from __future__ import annotations

from datetime import date, timedelta

import numpy as np
import pytest

from quillbar.operators import groups
from quillbar.operators import training as T


@pytest.fixture(scope="module")
def samples(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(90):
        x = rng.normal(size=(3, 2)).astype(np.float32)
        y = int(x.sum() + rng.normal() > 0.5) + int(x[0, 0] > 1.2)
        rows.append(("XY"[k % 2], "train" if k < 70 else "val", date(2020, 1, 1) + timedelta(days=k), x.tolist(), y))
    return spark.createDataFrame(rows, "symbol string, split string, end_dt date, features array<array<float>>, y long").cache()


def plain(spark, folder, width, config):
    """The loop over whole batches in one process."""
    data = spark.read.parquet(f"{folder}/batches").toPandas()
    x = np.array([np.ravel([list(r) for r in f]) for f in data["features"]], dtype=float)
    y, batch = data["y"].to_numpy(), data["batch"].to_numpy()
    counts = np.maximum(np.bincount(y, minlength=config.classes), 1)
    weights = len(y) / (config.classes * counts)
    p = T.start(width, config).params
    m, v, step, losses = np.zeros_like(p), np.zeros_like(p), 0, []
    for epoch in range(1, config.epochs + 1):
        total = 0.0
        for k in np.random.default_rng([config.seed, epoch]).permutation(batch.max() + 1):
            xs, ys = x[batch == k], y[batch == k]
            w, b = p[: width * config.classes].reshape(width, -1), p[width * config.classes :]
            e = np.exp(xs @ w + b)
            prob = e / e.sum(axis=1, keepdims=True)
            of = weights[ys]
            total += len(ys) * (of * -np.log(prob[range(len(ys)), ys])).sum() / of.sum()
            d = of[:, None] * (prob - np.eye(config.classes)[ys]) / of.sum()
            g = np.concatenate([(xs.T @ d).ravel(), d.sum(axis=0)])
            g *= min(1, config.clip / (np.linalg.norm(g) + 1e-6))
            step += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            p = p - config.rate * config.decay * p
            p = p - config.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        losses.append(total / len(y))
    return p, losses


@pytest.mark.parametrize("spread", [1, 20])
def test_equals_a_plain_loop(spark, samples, tmp_path, spread):
    config = T.Training(classes=3, epochs=3, batch=24, rate=0.05, decay=0.1, clip=0.3, seed=5, spread=spread)
    state = T.fit(samples, str(tmp_path), config)
    params, losses = plain(spark, str(tmp_path), 6, config)
    assert np.allclose(state.params, params, atol=1e-9) and state.step == 9
    assert np.allclose([h[1] for h in state.history], losses)
    assert T.load(spark, f"{tmp_path}/best").best == max(h[3] for h in state.history)
    assert losses[-1] < losses[0]


def test_resumed_equals_unbroken(spark, samples, tmp_path):
    config = lambda epochs: T.Training(classes=3, hidden=4, epochs=epochs, batch=40, rate=0.02, every=2)
    T.fit(samples, f"{tmp_path}/a", config(2))
    broken = T.fit(samples, f"{tmp_path}/a", config(5))
    whole = T.fit(samples, f"{tmp_path}/b", config(5))
    assert np.array_equal(broken.params, whole.params) and broken.history == whole.history and broken.step == whole.step
    assert T.load(spark, f"{tmp_path}/b/checkpoints").epoch == 5
    again = T.fit(samples, f"{tmp_path}/b", config(5))  # nothing left to do
    assert np.array_equal(again.params, whole.params)


@pytest.mark.parametrize("hidden", [0, 5])
def test_gradient_by_differences(hidden):
    rng = np.random.default_rng(1)
    config = T.Training(classes=3, hidden=hidden)
    x, y, weights = rng.normal(size=(8, 4)), rng.integers(0, 3, 8), np.array([1.0, 2.0, 0.5])
    params = T.start(4, config).params
    _, total, grad = T.gradient(params, x, y, weights, config)
    assert total == weights[y].sum()
    for k in range(len(params)):
        d = np.zeros_like(params)
        d[k] = 1e-6
        rise = (T.gradient(params + d, x, y, weights, config)[0] - T.gradient(params - d, x, y, weights, config)[0]) / 2e-6
        assert abs(rise - grad[k]) < 1e-5


def test_nothing_to_train_on(spark, samples, tmp_path):
    with pytest.raises(ValueError):
        T.fit(samples.where("split = 'val'"), str(tmp_path), T.Training(classes=3, epochs=1))


def test_subsets_equal_their_own_fit(spark):
    """Every subset's weights and scores, against a fit of its columns alone."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(120, 4))
    y = (x[:, 0] + 0.5 * x[:, 2] + rng.normal(size=120) > 0).astype(int)
    rows = [("train" if k < 90 else "val", int(y[k]), *map(float, x[k])) for k in range(120)] + [("train", 1, None, 0.0, 0.0, 0.0), (None, 0, 1.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "split string, label int, a double, b double, c double, d double").repartition(7)
    columns, subsets = ["a", "b", "c", "d"], {"one": ["c"], "two": ["a", "d"], "all": ["d", "c", "b", "a"]}
    matrix, sums = groups.gram(df.where("split = 'train'"), columns, 2)
    got = {(r["subset"], r["split"]): r["accuracy"] for r in groups.compared(df, columns, subsets, 2).collect()}
    for name, held in subsets.items():
        at = [columns.index(c) for c in held]
        part = np.concatenate((x[:90][:, at], np.ones((90, 1))), axis=1)
        penalty = np.diag([1.0] * len(at) + [0.0])
        want = np.linalg.solve(part.T @ part + penalty, part.T @ np.eye(2)[y[:90]])
        assert np.allclose(groups.solved(matrix, sums, at)[[*at, 4]], want)
        for split, rows_ in (("train", slice(0, 90)), ("val", slice(90, 120))):
            scored = np.concatenate((x[rows_][:, at], np.ones((len(x[rows_]), 1))), axis=1) @ want
            assert abs(got[name, split] - (scored.argmax(axis=1) == y[rows_]).mean()) < 1e-12
