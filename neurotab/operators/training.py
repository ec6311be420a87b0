"""Analysis of training runs: losses, early stopping, schedules, job status."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from neurotab import config


# smallest probability that enters a logarithm (trees and neighbours give zeros)
PROBABILITY_FLOOR = 1e-12


def log_probs(prob_cols: Sequence[str]) -> F.Column:
    return F.array(*[F.log(F.greatest(F.col(c), F.lit(PROBABILITY_FLOOR))) for c in prob_cols])


def loss_accuracy(scored: DataFrame, group: Sequence[str], prob_cols: Sequence[str], y_true: str = "y_true",
                  y_pred: str = "y_pred") -> DataFrame:
    """Mean cross-entropy of the true class and accuracy (correct / total)."""
    lp = F.element_at(log_probs(prob_cols), F.col(y_true) + 1)
    return scored.groupBy(*group).agg(
        F.avg(-lp).alias("loss"),
        F.avg(F.when(F.col(y_true) == F.col(y_pred), 1.0).otherwise(0.0)).alias("accuracy"),
        F.count(F.lit(1)).alias("n"))


def smoothed_log_loss(scored: DataFrame, group: Sequence[str], prob_cols: Sequence[str], y_true: str = "y_true",
                      smoothing: float = config.LABEL_SMOOTHING) -> DataFrame:
    """Label-smoothed cross entropy: target 1-s on the true class, s/(k-1) on the others."""
    k = len(prob_cols)
    lp = log_probs(prob_cols)
    idx = F.sequence(F.lit(0), F.lit(k - 1))
    target = F.transform(idx, lambda i: F.when(i == F.col(y_true), F.lit(1.0 - smoothing))
                         .otherwise(F.lit(smoothing / (k - 1))))
    row_loss = -F.aggregate(F.zip_with(target, lp, lambda t, l: t * l), F.lit(0.0), lambda a, b: a + b)
    return scored.groupBy(*group).agg(F.avg(row_loss).alias("smoothed_loss"))


def early_stop_epoch(history: DataFrame, run: str = "run_id", epoch: str = "epoch", loss: str = "val_loss",
                     patience: int = config.EARLY_STOP_PATIENCE,
                     min_delta: float = config.EARLY_STOP_MIN_DELTA) -> DataFrame:
    """Sequential early-stopping rule folded over each run's epochs in order:
    the first epoch sets the best loss; an epoch improves only when its loss
    <= best - min_delta, otherwise the counter grows; stop at counter >=
    patience.  A run's epochs are bounded by the epoch budget, so the fold is
    over one small array per run.  Output: run, stop_epoch, stopped."""
    arr = F.array_sort(F.collect_list(F.struct(F.col(epoch).alias("e"), F.col(loss).alias("l"))))
    init = F.struct(F.lit(None).cast("double").alias("best"), F.lit(0).alias("cnt"),
                    F.lit(None).cast(history.schema[epoch].dataType).alias("stop"))

    def step(acc, x):
        worse = x["l"] > acc["best"] - F.lit(min_delta)
        return (F.when(acc["stop"].isNotNull(), acc)
                .when(acc["best"].isNull(), F.struct(x["l"].alias("best"), F.lit(0).alias("cnt"),
                                                     acc["stop"].alias("stop")))
                .when(worse, F.struct(acc["best"].alias("best"), (acc["cnt"] + 1).alias("cnt"),
                                      F.when(acc["cnt"] + 1 >= patience, x["e"]).alias("stop")))
                .otherwise(F.struct(x["l"].alias("best"), F.lit(0).alias("cnt"), acc["stop"].alias("stop"))))

    res = history.groupBy(run).agg(F.aggregate(arr, init, step).alias("_s"), F.max(epoch).alias("_last"))
    return res.select(run, F.coalesce("_s.stop", "_last").alias("stop_epoch"),
                      F.col("_s.stop").isNotNull().alias("stopped"))


def best_epoch(history: DataFrame, run: str = "run_id", epoch: str = "epoch", loss: str = "val_loss") -> DataFrame:
    """First epoch with the strictly smallest loss."""
    return history.groupBy(run).agg(
        F.min_by(epoch, F.struct(loss, epoch)).alias("best_epoch"), F.min(loss).alias("best_val_loss"))


def cosine_lr(history: DataFrame, run: str = "run_id", epoch: str = "epoch", base_lr: float = config.LEARNING_RATE,
              t_max: int = config.MAX_EPOCHS) -> DataFrame:
    """lr at the e-th epoch of a run (0-based) = base/2 * (1 + cos(pi * e / T))."""
    e = F.row_number().over(Window.partitionBy(run).orderBy(epoch)) - 1
    return history.select(run, epoch, (F.lit(base_lr / 2) * (1 + F.cos(F.lit(math.pi) * e / t_max))).alias("lr"))


def job_status(events: DataFrame, job: str = "job_id", epoch: str = "epoch", total: str = "total_epochs",
               loss: str = "loss") -> DataFrame:
    """Latest event per job: progress = epoch/total*100 (1 decimal), running/completed."""
    last = events.groupBy(job).agg(F.max_by(F.struct(epoch, total, loss), epoch).alias("_l"))
    e, t = F.col(f"_l.{epoch}"), F.col(f"_l.{total}")
    return last.select(job, e.alias("current_epoch"), t.alias("total_epochs"),
                       F.round(e / t * 100.0, 1).alias("progress"),
                       F.when(e >= t, "completed").otherwise("running").alias("status"),
                       F.col(f"_l.{loss}").alias("loss"))


def with_job_id(df: DataFrame, col: str = "job_id") -> DataFrame:
    """Attach a random job identifier (uuid) to new training requests."""
    return df.withColumn(col, F.expr("uuid()"))
