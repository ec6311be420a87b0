"""Cross-validation, out-of-fold stacking, tuning and attribution by permutation.

Folds come from ``stratified_folds`` (a column of the data), so a fold split
is a filter, not a copy.  The fold loop is a driver loop over k fits (k is
small); every fit and score is a distributed Spark job.  Scalers are fitted
inside each fold (the analysed code fitted them on all rows first).
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from neurotab import config
from neurotab.learn import models as md
from neurotab.operators.evaluation import overall_metrics
from neurotab.session import cut_lineage

FitFn = Callable[[DataFrame], md.Scorer]
Progress = Callable[[int, dict], None] | None


def _report(progress: Progress, step: int, info: dict) -> None:
    """Driver-side progress hook called between folds / trials."""
    if progress is not None:
        progress(step, info)


def folds_of(data: DataFrame, fold_col: str = "fold") -> list:
    """The folds that occur, whatever they are numbered from (one value each)."""
    return sorted(r[0] for r in data.select(fold_col).distinct().collect())


def fit_all(data: DataFrame, fits: dict[str, FitFn]) -> dict[str, md.Scorer]:
    """Every model fitted on ``data``; the fits are independent Spark jobs,
    submitted from a driver thread each."""
    with ThreadPoolExecutor(max_workers=max(1, len(fits))) as pool:
        return dict(zip(fits, pool.map(lambda n: fits[n](data), fits), strict=True))


def fit_and_score(train: DataFrame, valid: DataFrame, fits: dict[str, FitFn]) -> DataFrame:
    """Scores of ``valid`` by every model fitted on ``train``.  All fits run from
    driver threads; a model is scored, and its scores written, while others are
    still fitted, so that a fit of few tasks does not hold the cluster up."""
    out = None
    with ThreadPoolExecutor(max_workers=max(1, len(fits))) as pool:
        fitted = {name: pool.submit(fit, train) for name, fit in fits.items()}
        for name, scorer in fitted.items():
            s = cut_lineage(scorer.result().score(valid).withColumn("model", F.lit(name)))
            out = s if out is None else out.unionByName(s)
    return out


def oof_predictions(data: DataFrame, fits: dict[str, FitFn], fold_col: str = "fold",
                    k: int | None = None, progress: Progress = None, parallelism: int = 4) -> DataFrame:
    """Out-of-fold probabilities of every base model: for each fold, fit on the
    other folds and score this one.  Models that fit all folds in the same passes
    do so; these and the fits of the others are independent Spark jobs, submitted
    from ``parallelism`` driver threads.  Output (id, model, prediction, p0..p2, fold)."""
    folds = folds_of(data, fold_col)[:k]

    def together(name: str) -> DataFrame | None:
        whole = md.out_of_fold_scores(fits[name], data, fold_col, folds, name)
        if whole is None:
            return None
        _report(progress, len(folds), {"stage": "oof", "model": name})
        return whole if fold_col in whole.columns else whole.join(data.select("id", fold_col), "id")

    def one(job: tuple) -> DataFrame:
        f, name = job
        train, valid = data.where(F.col(fold_col) != f), data.where(F.col(fold_col) == f)
        out = fits[name](train).score(valid).withColumn("model", F.lit(name)).withColumn(fold_col, F.lit(f))
        _report(progress, f, {"stage": "oof", "model": name})
        return out

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        wholes = dict(zip(fits, pool.map(together, fits), strict=True))
        parts = [w for w in wholes.values() if w is not None]
        parts += pool.map(one, [(f, name) for f in folds for name, w in wholes.items() if w is None])
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return cut_lineage(out)


def fit_stacking(data: DataFrame, fits: dict[str, FitFn], fold_col: str = "fold",
                 k: int | None = None) -> md.Scorer:
    """Stacking: OOF probabilities of the base models, side by side in named
    columns (one fixed model order), feed a multinomial logistic meta model;
    base models are refitted on all rows for scoring."""
    names = sorted(fits)
    oof = oof_predictions(data, fits, fold_col, k)
    meta_x = md.meta_features(oof, names).join(data.select("id", "label"), "id")
    meta = md.fit_logreg(meta_x, name="stacking")
    full = fit_all(data, {n: fits[n] for n in names})
    return md.scorer_of("stacking", "stacking", {"names": names}, members=[*[full[n] for n in names], meta])


def loso_validate(data: DataFrame, fit: FitFn, subject: str = "subject_id", progress: Progress = None) -> DataFrame:
    """Leave-one-subject-out: metrics per subject left out (fold = its rank)."""
    from neurotab.operators.folds import loso_folds

    return cross_validate(cut_lineage(loso_folds(data, subject, "fold")), fit, "fold", None, progress)


def cross_validate(data: DataFrame, fit: FitFn, fold_col: str = "fold", k: int | None = None,
                   progress: Progress = None) -> DataFrame:
    """Per-fold overall metrics of one model: (fold, accuracy, macro_f1, ...), for
    every fold that occurs (stratified or leave-one-subject-out)."""
    rows = []
    for f in folds_of(data, fold_col)[:k]:
        train, valid = data.where(F.col(fold_col) != f), data.where(F.col(fold_col) == f)
        s = fit(train).score(valid).join(valid.select("id", F.col("label").alias("y_true")), "id")
        rows.append(overall_metrics(s.withColumnRenamed("prediction", "y_pred"), ["model"])
                    .withColumn(fold_col, F.lit(f)))
        _report(progress, f, {"stage": "cv", "fold": f})
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def trial_table(spark, n_trials: int = 15, seed: int = config.SEED) -> DataFrame:
    """Hyper-parameter trials drawn from the search space: a depth of 3-9 for
    each of the three boosted models, learning rate 0.01-0.2 (log-uniform),
    trees 100-500 step 100."""
    rng = np.random.default_rng(seed)
    rows = [(t, *(int(rng.integers(3, 10)) for _ in range(3)), float(np.exp(rng.uniform(np.log(0.01), np.log(0.2)))),
             int(rng.integers(1, 6) * 100)) for t in range(n_trials)]
    return spark.createDataFrame(rows, "trial int, depth_a int, depth_b int, depth_c int, learning_rate double, n_trees int")


def best_trial(results: DataFrame, score: str = "mean_accuracy") -> DataFrame:
    """The trial with the highest mean score (the first trial on ties)."""
    return results.agg(F.max_by(F.struct(*results.columns), F.struct(F.col(score), -F.col("trial"))).alias("_b")) \
        .select("_b.*")


def tune(data: DataFrame, fit_for: Callable[[dict], FitFn], trials: DataFrame, fold_col: str = "fold",
         k: int = 3, progress: Progress = None, parallelism: int = 4) -> DataFrame:
    """k-fold accuracy of each trial's parameters; returns trials + mean_accuracy.
    Trials are independent Spark jobs, submitted from ``parallelism`` driver
    threads (as ``CrossValidator``'s parallelism does)."""
    params_list = [t.asDict() for t in trials.collect()]       # n_trials rows of parameters

    def run(params: dict) -> tuple:
        acc = cross_validate(data, fit_for(params), fold_col, k).agg(F.avg("accuracy")).first()[0]
        _report(progress, params["trial"], {"stage": "trial", "mean_accuracy": float(acc)})
        return (*params.values(), float(acc))

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        out = list(pool.map(run, params_list))
    return data.sparkSession.createDataFrame(out, trials.schema.simpleString()[7:-1] + ", mean_accuracy double")


def tune_boosting(data: DataFrame, trials: DataFrame, fold_col: str = "fold", classes: int = md.K) -> DataFrame:
    """``trials`` with the mean accuracy over the folds of the soft-voted boosting
    ensemble with each trial's depths, learning rate and tree count.  All trials,
    folds and members are grown together, and each fold's left-out rows come back
    with their margins, so the search is one fit and one aggregation."""
    from neurotab.learn.boosting import Plan, boost, probabilities

    folds, members = folds_of(data, fold_col), list(md.BOOSTING_CONFIGS.values())
    plans, names = [], []
    for t in trials.collect():  # rows of parameters
        for f in folds:
            for m, depth in zip(members, (t["depth_a"], t["depth_b"], t["depth_c"]), strict=True):
                plans.append(Plan(t["n_trees"], depth, t["learning_rate"], leave_out=int(f), **m))
                names.append((len(names), t["trial"], f))
    _, _, held = boost(data, plans, fold_col, classes, keep_trees=False)
    of = data.sparkSession.createDataFrame(names, "plan int, trial int, fold int")
    p = probabilities(F.col("margins"))
    voted = held.join(F.broadcast(of), "plan").select("trial", "fold", "id", *[F.get(p, F.lit(c)).alias(f"p{c}") for c in range(classes)]) \
        .groupBy("trial", "fold", "id").agg(F.array(*[F.avg(f"p{c}") for c in range(classes)]).alias("p"))
    right = voted.join(data.select("id", "label"), "id").select(
        "trial", "fold", (F.array_position("p", F.array_max("p")) - 1 == F.col("label")).cast("double").alias("hit"))
    score = right.groupBy("trial", "fold").agg(F.avg("hit").alias("accuracy")).groupBy("trial").agg(F.avg("accuracy").alias("mean_accuracy"))
    return trials.join(score, "trial")


def loso_predictions(data: DataFrame, subject: str = "subject_id") -> DataFrame:
    """Predictions of every row by the discriminant that has not seen its subject
    (``learn.sufficient``: no refit reads the rows again)."""
    from neurotab.learn.sufficient import left_out_predictions

    return left_out_predictions(data, subject)
