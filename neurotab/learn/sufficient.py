"""Linear discriminants of every left-out subject from one set of statistics.

Counts, sums and cross products of the features are added up once for each
subject.  What a fit without a subject needs is the total less that subject's
own part, so no fold reads the rows again: two aggregations over the data (the
mean, then the statistics about it) serve any number of subjects.  The solves,
one d x d system a subject, run side by side on the executors, and a row is
scored by the weights of its own subject's fit through one join.

Defined results: a class that the remaining subjects lack has probability 0; a
subject whose removal leaves no rows gets null probabilities and prediction;
null features count as the mean; a null subject is a subject of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from neurotab.learn.boosting import features_of
from neurotab.session import cut_lineage


def feature_means(data: DataFrame) -> np.ndarray:
    rows = data.select(F.posexplode("features").alias("j", "x")).groupBy("j").agg(F.avg("x").alias("m")).orderBy("j").collect()
    return np.array([0.0 if r["m"] is None else r["m"] for r in rows])


def statistics(data: DataFrame, subject: str, mean: np.ndarray, classes: int) -> DataFrame:
    """(subject, part array<double>): counts and sums of each class and the upper
    half of the cross products, about ``mean``."""
    d, kind = len(mean), data.schema[subject].dataType.simpleString()
    upper = np.triu_indices(d)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        for batch in batches:
            x = features_of(batch.column("features"), d) - mean
            label, names = np.array(batch.column("label").to_pylist()), batch.column("subject").to_pylist()
            number = {s: k for k, s in enumerate(dict.fromkeys(names))}
            own = np.array([number[s] for s in names], np.int64)
            for s, k in number.items():
                xs, ls = x[own == k], label[own == k]
                by_class = np.stack([ls == c for c in range(classes)]).astype(np.float64)
                part = np.r_[by_class.sum(1), (by_class @ xs).ravel(), (xs.T @ xs)[upper]]
                total[s] = total[s] + part if s in total else part
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), batch.column("subject").type), pa.array(list(total.values()), pa.list_(pa.float64()))], ["subject", "part"])

    parts = data.select(F.col(subject).alias("subject"), F.col("label").cast("int").alias("label"), "features").mapInArrow(
        partial, f"subject {kind}, part array<double>")
    summed = parts.select("subject", F.posexplode("part").alias("j", "v")).groupBy("subject", "j").agg(F.sum("v").alias("v"))
    return summed.groupBy("subject").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "v"))), lambda p: p["v"]).alias("part"))


def discriminant(part: np.ndarray, mean: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Weights (class, d) and constants of the discriminant with pooled
    covariance (divisor n - classes seen); None without rows."""
    d = len(mean)
    counts, sums = np.rint(part[:classes]), part[classes:classes * (d + 1)].reshape(classes, d)
    seen = counts > 0
    if not seen.any():
        return None
    cross = np.zeros((d, d))
    cross[np.triu_indices(d)] = part[classes * (d + 1):]
    cross += np.triu(cross, 1).T
    mu = sums[seen] / counts[seen, None]
    within = (cross - (mu * counts[seen, None]).T @ mu) / max(counts.sum() - seen.sum(), 1)
    weights = np.zeros((classes, d))
    weights[seen] = (mu) @ np.linalg.pinv(within)
    constants = np.full(classes, -np.inf)
    constants[seen] = -0.5 * (weights[seen] * mu).sum(1) + np.log(counts[seen] / counts.sum())
    return weights, constants - weights @ mean  # for features as they are


def filled(data: DataFrame, mean: np.ndarray) -> DataFrame:
    m = F.array(*[F.lit(float(v)) for v in mean])
    return data.withColumn("features", F.zip_with("features", m, lambda x, y: F.coalesce(x, y)))


def left_out_fits(data: DataFrame, mean: np.ndarray, subject: str = "subject_id", classes: int = 3) -> DataFrame:
    """(subject, weights array<array<double>>, constants array<double>): the fit
    without each subject."""
    stats = cut_lineage(statistics(data, subject, mean, classes))
    total = np.array([r["v"] for r in stats.select(F.posexplode("part").alias("j", "v")).groupBy("j").agg(F.sum("v").alias("v")).orderBy("j").collect()])
    kind = data.schema[subject].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fits = [discriminant(total - np.array(p), mean, classes) for p in batch.column("part").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("subject"), pa.array([None if f is None else f[0].tolist() for f in fits], pa.list_(pa.list_(pa.float64()))),
                 pa.array([None if f is None else f[1].tolist() for f in fits], pa.list_(pa.float64()))], ["subject", "weights", "constants"])

    return stats.repartition("subject").mapInArrow(run, f"subject {kind}, weights array<array<double>>, constants array<double>")


def left_out_predictions(data: DataFrame, subject: str = "subject_id", classes: int = 3, name: str = "lda") -> DataFrame:
    """(id, subject, label, model, prediction, p0...): every row scored by the
    discriminant that has not seen its subject."""
    mean = feature_means(data)
    data = filled(data, mean)
    fits = cut_lineage(left_out_fits(data, mean, subject, classes)).withColumnRenamed("subject", "_s")
    rows = data.select("id", subject, F.col("label").cast("int").alias("label"), "features")
    joined = rows.join(fits, rows[subject].eqNullSafe(fits["_s"]), "left")
    dot = lambda w, c: F.aggregate(F.zip_with("features", w, lambda a, b: a * b), c, lambda s, v: s + v)
    scores = joined.withColumn("_v", F.zip_with("weights", "constants", dot))
    top = F.array_max("_v")
    shares = scores.withColumn("_e", F.transform("_v", lambda v: F.exp(v - top)))
    total = F.aggregate("_e", F.lit(0.0), lambda s, v: s + v)
    out = shares.withColumn("_p", F.transform("_e", lambda v: v / total))
    return out.select("id", subject, "label", F.lit(name).alias("model"), (F.array_position("_p", F.array_max("_p")) - 1).cast("int").alias("prediction"),
                      *[F.get("_p", F.lit(c)).alias(f"p{c}") for c in range(classes)])
