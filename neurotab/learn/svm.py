"""Kernel support vector machines by Newton steps on random Fourier features.

The RBF kernel is replaced by random Fourier features (Rahimi and Recht), so a
classifier is a weight vector w over D projected features.  Its squared-hinge
objective  |w|^2 / 2 + C sum max(0, 1 - y f)^2  is quadratic on the rows inside
the margin, so one Newton step solves (I + 2C Z'Z) w = 2C Z'y over those rows,
and a handful of steps settle which rows they are.

One step is one aggregation for all classes and all folds together: a task adds
up Z'Z and Z'y of its rows for every problem, Spark brings the parts of a
problem together, and D numbers a problem come back.  The rows stay where they
are, and their number of passes does not grow with folds or classes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from neurotab import config
from neurotab.learn.boosting import features_of

STEPS = 25
HALVINGS = 6


def projection(d: int, gamma: float, components: int, seed: int = config.SEED) -> tuple[np.ndarray, np.ndarray]:
    """W (components x d) and b of z(x) = sqrt(2 / D) cos(W x + b)."""
    rng = np.random.default_rng(seed)
    return rng.normal(0.0, math.sqrt(2 * gamma), size=(components, d)), rng.uniform(0, 2 * math.pi, size=components)


def projected(x: np.ndarray, scaler: tuple, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Projected features and a constant one."""
    mean, scale = (np.asarray(v) for v in scaler)
    z = math.sqrt(2.0 / len(b)) * np.cos(((x - mean) / scale) @ w.T + b)
    return np.concatenate([z, np.ones((len(z), 1))], axis=1)


def total_variance(data: DataFrame, scaler: tuple) -> float:
    """Population variance of all scaled feature values together: the kernel
    width is 1 / (d var).  Scaled features have mean 0 and variance 1, constant
    ones variance 0."""
    spread = data.select(F.posexplode("features").alias("j", "x")).groupBy("j").agg(F.stddev_pop("x").alias("s")).select("s").collect()
    live = sum(1 for r in spread if r["s"])
    return live / len(spread) if live else 1.0


def newton(data: DataFrame, scaler: tuple, w: np.ndarray, b: np.ndarray, c: float, classes: int, leave_out: list[int | None],
           fold_col: str | None = None) -> np.ndarray:
    """Weights (fold problem, class, D + 1) of one-against-rest classifiers, one
    set for each entry of ``leave_out`` (a fold that is not learned from)."""
    d, size, problems = w.shape[1], len(b) + 1, len(leave_out) * classes
    fold = F.col(fold_col).cast("int") if fold_col else F.lit(None).cast("int")
    rows = data.select("features", F.col("label").cast("int").alias("label"), fold.alias("fold")).persist()
    weights = np.zeros((problems, size))
    before, base, halved, live = np.full(problems, np.inf), weights.copy(), np.zeros(problems, int), np.ones(problems, bool)

    def sums(at: np.ndarray, live: np.ndarray) -> DataFrame:
        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = {p: np.zeros(size * size + size + 2) for p in np.nonzero(live)[0]}
            for batch in batches:
                z = projected(features_of(batch.column("features"), d), scaler, w, b)
                label = np.array(batch.column("label").to_pylist())
                own = np.array([-1 if v is None else v for v in batch.column("fold").to_pylist()])
                for p in total:
                    use = own != leave_out[p // classes] if leave_out[p // classes] is not None else np.ones(len(z), bool)
                    y = np.where(label == p % classes, 1.0, -1.0)
                    slack = 1 - y * (z @ at[p])
                    inside = use & (slack > 0)
                    za = z[inside]
                    total[p] += np.r_[(za.T @ za).ravel(), za.T @ y[inside], (slack[inside] ** 2).sum(), inside.sum()]
            for p, t in total.items():
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([t.tobytes()], pa.binary())], ["problem", "part"])

        def solve(key: tuple[pa.Scalar, ...], parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            p = key[0].as_py()
            t = sum(np.frombuffer(v, np.float64) for part in parts for v in part.column("part").to_pylist())
            penalty = np.eye(size)
            penalty[-1, -1] = 1e-9  # the constant is not penalised
            h = penalty + 2 * c * t[:size * size].reshape(size, size)
            best = np.linalg.solve(h, 2 * c * t[size * size:-2])
            value = 0.5 * float(at[p, :-1] @ at[p, :-1]) + c * t[-2]
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([value]), pa.array([best], pa.list_(pa.float64()))], ["problem", "value", "best"])

        return rows.mapInArrow(partial, "problem int, part binary").groupBy("problem").applyInArrow(solve, "problem int, value double, best array<double>")

    try:
        target = weights.copy()
        for _ in range(STEPS * HALVINGS):
            for r in sums(target, live).collect():  # D numbers a problem
                p, best = r["problem"], np.array(r["best"])
                if r["value"] > before[p] * (1 + 1e-12) and halved[p] < HALVINGS:
                    target[p] = (base[p] + target[p]) / 2  # a step too far: half of it
                    halved[p] += 1
                    continue
                moved = np.abs(best - target[p]).max()
                base[p], before[p], halved[p] = target[p], r["value"], 0
                live[p] = moved > 1e-8 * (1 + np.abs(best).max())
                target[p] = best
            if not live.any():
                break
    finally:
        rows.unpersist()
    return target.reshape(len(leave_out), classes, size)


def margins(data: DataFrame, scaler: tuple, w: np.ndarray, b: np.ndarray, weights: np.ndarray, fold_col: str | None = None,
            folds: list[int] | None = None) -> DataFrame:
    """(id, margins) of every row; with ``folds``, by the weights that left the row's fold out."""
    kind, d = data.schema["id"].dataType.simpleString(), w.shape[1]
    fold = F.col(fold_col).cast("int") if fold_col else F.lit(0)
    place = {f: k for k, f in enumerate(folds)} if folds else {0: 0}
    sent = data.sparkSession.sparkContext.broadcast((w, b, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w, b, weights = sent.value
            z = projected(features_of(batch.column("features"), d), scaler, w, b)
            own = np.array([place[f] for f in batch.column("fold").to_pylist()], np.int64)
            out = np.zeros((len(z), weights.shape[1]))
            for k in np.unique(own):
                out[own == k] = z[own == k] @ weights[k].T
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(list(out), pa.list_(pa.float64()))], ["id", "margins"])

    return data.select("id", "features", fold.alias("fold")).mapInArrow(run, f"id {kind}, margins array<double>")
