"""Classifiers for the 3-level label, as Spark ML fits over feature arrays.

Data convention: (id, label, features array<double>).  Each ``fit_*``
returns a ``Scorer`` whose ``score(df)`` gives (id, model, prediction, p0..p{k-1}).
Fitted state that reaches the driver is O(features x classes) (scaler
moments, discriminant weights, Fourier projection); the training rows
never do.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.classification import (GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, OneVsRest,
                                       RandomForestClassifier)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from neurotab import config
from neurotab.learn.boosting import Plan, boost, forest_margins
from neurotab.learn.forest import Bagging, fits_in_task, forest_shares, grow_forests

K = 3


@dataclass
class Scorer:
    """A fitted model.  ``kind`` names how it scores, ``params`` holds plain
    numbers, ``stage`` a Spark ML model or the table of a neighbour model,
    ``members`` the models it combines; ``save_scorer`` stores all of them."""

    name: str
    score: Callable[[DataFrame], DataFrame]
    kind: str = ""
    params: dict = field(default_factory=dict)
    stage: object = None
    members: list["Scorer"] = field(default_factory=list)


# how each kind scores: (name, params, stage, members) -> score function
KINDS: dict[str, Callable[..., Callable[[DataFrame], DataFrame]]] = {}


def kind(name: str):
    def deco(fn):
        KINDS[name] = fn
        return fn
    return deco


def scorer_of(kind_name: str, name: str, params: dict | None = None, stage=None, members: Sequence["Scorer"] = ()) -> Scorer:
    params, members = params or {}, list(members)
    return Scorer(name, KINDS[kind_name](name, params, stage, members), kind_name, params, stage, members)


def save_scorer(scorer: Scorer, spark, path: str) -> None:
    """Write a fitted scorer (scaler, numbers, Spark ML model, members) under ``path``."""
    from pyspark.ml import PipelineModel

    if scorer.kind not in KINDS:
        raise ValueError(f"{scorer.name} cannot be stored")
    table = isinstance(scorer.stage, DataFrame)
    facts = {"name": scorer.name, "kind": scorer.kind, "params": scorer.params, "members": len(scorer.members),
             "stage": "table" if table else "model" if scorer.stage is not None else ""}
    spark.createDataFrame([(json.dumps(facts),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/facts")
    if table:
        scorer.stage.write.mode("overwrite").parquet(f"{path}/stage")
    elif scorer.stage is not None:
        PipelineModel([scorer.stage]).write().overwrite().save(f"{path}/stage")
    for i, m in enumerate(scorer.members):
        save_scorer(m, spark, f"{path}/member-{i}")


def load_scorer(spark, path: str) -> Scorer:
    from pyspark.ml import PipelineModel

    facts = json.loads(spark.read.text(f"{path}/facts").first()["value"])
    stage = None
    if facts["stage"] == "table":
        stage = spark.read.parquet(f"{path}/stage")
    elif facts["stage"]:
        stage = PipelineModel.load(f"{path}/stage").stages[0]
    members = [load_scorer(spark, f"{path}/member-{i}") for i in range(facts["members"])]
    return scorer_of(facts["kind"], facts["name"], facts["params"], stage, members)


def _out(df: DataFrame, name: str, prob: F.Column, id_col: str = "id", k: int = K, keep: Sequence[str] = ()) -> DataFrame:
    p = df.select(id_col, prob.alias("_p"), *keep)
    return p.select(id_col, F.lit(name).alias("model"),
                    (F.array_position("_p", F.array_max("_p")) - 1).cast("int").alias("prediction"),
                    *[F.coalesce(F.get("_p", F.lit(i)), F.lit(0.0)).alias(f"p{i}") for i in range(k)], *keep)


# ---------------------------------------------------------------- scaling (population std)

def fit_scaler(df: DataFrame, col: str = "features") -> tuple[list[float], list[float]]:
    """Per-position mean and population std (constant column -> 1)."""
    st = df.select(F.posexplode(col).alias("_j", "_x")).groupBy("_j") \
        .agg(F.avg("_x").alias("m"), F.stddev_pop("_x").alias("s")).orderBy("_j").collect()
    return [r["m"] for r in st], [r["s"] if r["s"] and r["s"] > 0 else 1.0 for r in st]


def apply_scaler(df: DataFrame, params, col: str = "features") -> DataFrame:
    mean, scale = params
    m = F.array(*[F.lit(float(v)) for v in mean])
    s = F.array(*[F.lit(float(v)) for v in scale])
    return df.withColumn(col, F.zip_with(F.zip_with(F.col(col), m, lambda x, a: x - a), s, lambda x, b: x / b))


def _vec(df: DataFrame, col: str = "features") -> DataFrame:
    return df.withColumn("fv", array_to_vector(col))


def _fit_cached(estimator, data: DataFrame):
    """Iterative learners pass over the training set many times: keep it
    persisted (memory, spilling to disk) for the duration of the fit.  The
    REBALANCE hint lets AQE size its partitions by bytes, so a per-iteration
    job over a few rows does not pay for hundreds of near-empty tasks and the
    stage that makes the data keeps its own parallelism."""
    data = data.hint("rebalance").persist()
    try:
        return estimator.fit(data)
    finally:
        data.unpersist()


# ---------------------------------------------------------------- models

def fit_logreg(train: DataFrame, c: float = 1.0, max_iter: int = 1000, name: str = "logreg") -> Scorer:
    """Multinomial logistic regression, L2 penalty C (regParam = 1/(C n))."""
    sc = fit_scaler(train)
    n = train.count()
    lr = LogisticRegression(featuresCol="fv", labelCol="label", family="multinomial", regParam=1.0 / (c * n),
                            elasticNetParam=0.0, standardization=False, maxIter=max_iter)
    return scorer_of("probability", name, {"scaler": sc}, _fit_cached(lr, _vec(apply_scaler(train, sc))))


@kind("probability")
def _score_probability(name: str, params: dict, model, members):
    """Models with a probability column, on features scaled or as they are."""
    scaled = (lambda df: apply_scaler(df, params["scaler"])) if params.get("scaler") else (lambda df: df)
    return lambda df: _out(model.transform(_vec(scaled(df))), name, vector_to_array("probability"))


def fit_random_forest(train: DataFrame, trees: int = 300, depth: int = 10, seed: int = config.SEED,
                      name: str = "random_forest") -> Scorer:
    """Random forest, a square root of the features drawn at each node.  The trees
    are those of Spark's ``RandomForestClassifier``, grown whole in tasks
    (``learn.forest``); a table too large to broadcast is left to Spark's."""
    if fits_in_task(train):
        cuts, classes, grown, _ = grow_forests(train, [Bagging(trees, depth, seed)])
        return scorer_of("bagged", name, {"cuts": cuts, "classes": classes}, grown.drop("plan"))
    rf = RandomForestClassifier(featuresCol="fv", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed)
    return scorer_of("probability", name, {}, _fit_cached(rf, _vec(train)))


@kind("bagged")
def _score_bagged(name: str, params: dict, trees, members):
    return lambda df: _out(forest_shares(df, params["cuts"], params["classes"], trees), name, F.col("shares"))


def forest_out_of_fold(data: DataFrame, fold_col: str, folds: list, trees: int = 300, depth: int = 10, seed: int = config.SEED) -> DataFrame | None:
    """(id, shares, fold) of every row by the forest that left its fold out; the
    trees of all folds grow side by side.  None for a table that is left to Spark."""
    if not fits_in_task(data):
        return None
    _, _, _, held = grow_forests(data, [Bagging(trees, depth, seed, int(f)) for f in folds], fold_col, keep_trees=False)
    number = F.get(F.array(*[F.lit(f) for f in folds]), F.col("plan"))
    return held.select("id", "shares", number.alias(fold_col))


def fit_gbt_ovr(train: DataFrame, iters: int = 200, depth: int = 6, step: float = 0.05, subsample: float = 1.0,
                feature_subset: str = "all", seed: int = config.SEED, name: str = "gbt", k: int = K) -> Scorer:
    """One binary boosted-tree model per class (Spark's GBT is binary); per-class
    positive probabilities sigmoid(2 * margin) are normalised to sum to one.  The
    trees are those of Spark's ``GBTClassifier`` (its losses, weights, variance
    splits and 32 quantile bins) on the histograms of ``learn.boosting``, all
    classes together: Spark starts a job a level, round and class.  Features
    drawn anew at each node are left to Spark, in ``OneVsRest``."""
    if feature_subset == "all":
        plans = [Plan(iters, depth, step, rows=subsample, seed=seed, against=c) for c in range(k)]
        cuts, trees, _ = boost(train, plans, classes=1)
        one_forest = trees.drop("cls").withColumnRenamed("plan", "cls")
        return scorer_of("boosted_bins", name, {"cuts": cuts, "k": k}, one_forest)
    g = GBTClassifier(maxIter=iters, maxDepth=depth, stepSize=step, subsamplingRate=subsample,
                      featureSubsetStrategy=feature_subset, seed=seed)
    ovr = OneVsRest(classifier=g, featuresCol="fv", labelCol="label", parallelism=k)
    return scorer_of("boosted", name, {}, _fit_cached(ovr, _vec(train)))


def _one_against_rest(margins: str) -> F.Column:
    q = F.transform(margins, lambda m: 1.0 / (1.0 + F.exp(-2.0 * m)))
    tot = F.aggregate(q, F.lit(0.0), lambda a, b: a + b)
    return F.transform(q, lambda v: v / tot)


@kind("boosted")
def _score_boosted(name: str, params: dict, model, members):
    def score(df: DataFrame) -> DataFrame:
        raw = model.transform(_vec(df)).select("id", vector_to_array("rawPrediction").alias("_r"))
        return _out(raw, name, _one_against_rest("_r"))
    return score


@kind("boosted_bins")
def _score_boosted_bins(name: str, params: dict, trees, members):
    return lambda df: _out(forest_margins(df, params["cuts"], trees, params["k"]), name, _one_against_rest("margins"))


def _softmax(arr: F.Column) -> F.Column:
    mx = F.array_max(arr)
    e = F.transform(arr, lambda v: F.exp(v - mx))
    tot = F.aggregate(e, F.lit(0.0), lambda a, b: a + b)
    return F.transform(e, lambda v: v / tot)


def _svm_problem(train: DataFrame, n_components: int, seed: int) -> dict:
    from neurotab.learn.svm import projection, total_variance

    sc = fit_scaler(train)
    d = len(sc[0])
    w, b = projection(d, 1.0 / (d * total_variance(train, sc)), n_components, seed)
    return {"scaler": sc, "w": w.tolist(), "b": b.tolist()}


def fit_svm_rff(train: DataFrame, c: float = 10.0, n_components: int = 256, seed: int = config.SEED,
                name: str = "svm", k: int = K) -> Scorer:
    """RBF-kernel SVM on random Fourier features, gamma = 1/(d var(X)); one
    against the rest, all classes in the same Newton steps (``learn.svm``);
    margins -> softmax probabilities."""
    from neurotab.learn.svm import newton

    params = _svm_problem(train, n_components, seed)
    w = newton(train, params["scaler"], np.array(params["w"]), np.array(params["b"]), c, k, [None])
    return scorer_of("fourier_svm", name, params | {"weights": w.tolist()})


def svm_out_of_fold(data: DataFrame, fold_col: str, folds: list, c: float = 10.0, n_components: int = 256,
                    seed: int = config.SEED, k: int = K) -> DataFrame:
    """(id, margins) of every row by the machine that left its fold out; all
    folds share the scaling and the steps."""
    from neurotab.learn.svm import margins, newton

    p = _svm_problem(data, n_components, seed)
    w, b = np.array(p["w"]), np.array(p["b"])
    weights = newton(data, p["scaler"], w, b, c, k, folds, fold_col)
    return margins(data.where(F.col(fold_col).isin(folds)), p["scaler"], w, b, weights, fold_col, folds)


@kind("fourier_svm")
def _score_fourier_svm(name: str, params: dict, model, members):
    from neurotab.learn.svm import margins

    w, b, weights = (np.array(params[v]) for v in ("w", "b", "weights"))
    return lambda df: _out(margins(df, params["scaler"], w, b, weights), name, _softmax(F.col("margins")))


def fit_discriminant(train: DataFrame, name: str = "lda", k: int = K) -> Scorer:
    """Linear discriminant analysis with a pooled within-class covariance
    (divisor n - k).  Class means and the covariance come from distributed
    aggregates (the covariance through Spark's correlation of class-centred
    vectors); the d x d solve runs on the driver; scoring is a projection."""
    means = train.select("label", F.posexplode("features").alias("_j", "_x")).groupBy("label", "_j") \
        .agg(F.avg("_x").alias("m"), F.count(F.lit(1)).alias("n")).collect()
    classes = sorted({r["label"] for r in means})
    d = 1 + max(r["_j"] for r in means)
    mu = np.zeros((len(classes), d))
    cnt = np.zeros(len(classes))
    for r in means:
        ci = classes.index(r["label"])
        mu[ci, r["_j"]] = r["m"]
        cnt[ci] = r["n"]
    n = cnt.sum()
    mu_df = train.sparkSession.createDataFrame([(int(c), [float(v) for v in mu[i]]) for i, c in enumerate(classes)],
                                               "label int, _mu array<double>")
    centred = train.join(F.broadcast(mu_df), "label").select(
        F.zip_with("features", "_mu", lambda a, b: a - b).alias("_xc"))
    ss = centred.select(F.posexplode("_xc").alias("_j", "_x")).groupBy("_j") \
        .agg(F.sum(F.col("_x") * F.col("_x")).alias("s")).orderBy("_j").collect()
    sd = np.sqrt(np.array([r["s"] for r in ss]) / (n - len(classes)))
    corr = Correlation.corr(centred.select(array_to_vector("_xc").alias("v")), "v").first()[0].toArray()
    corr = np.nan_to_num(corr)
    np.fill_diagonal(corr, 1.0)
    cov = corr * np.outer(sd, sd)
    inv = np.linalg.pinv(cov)
    coef = mu @ inv                                    # k x d
    icpt = -0.5 * np.sum(coef * mu, axis=1) + np.log(cnt / n)
    return scorer_of("discriminant", name, {"classes": [int(c) for c in classes], "k": k, "coef": coef.tolist(), "icpt": icpt.tolist()})


@kind("discriminant")
def _score_discriminant(name: str, params: dict, model, members):
    classes, icpt = params["classes"], params["icpt"]

    def score(df: DataFrame) -> DataFrame:
        cw = [F.array(*[F.lit(float(v)) for v in c]) for c in params["coef"]]
        s = F.array(*[F.aggregate(F.zip_with(F.col("features"), cw[i], lambda a, b: a * b),
                                  F.lit(float(icpt[i])), lambda acc, v: acc + v) for i in range(len(classes))])
        x = df.select("id", s.alias("_s"))
        mx = F.array_max("_s")
        e = F.transform("_s", lambda v: F.exp(v - mx))
        tot = F.aggregate(e, F.lit(0.0), lambda a, b: a + b)
        # probabilities stand at their label; a class that training never saw has 0
        at = [F.get("_e", F.lit(classes.index(c))) if c in classes else F.lit(0.0) for c in range(max(params["k"], max(classes) + 1))]
        placed = x.select("id", F.transform(e, lambda v: v / tot).alias("_e")).select("id", F.array(*at).alias("_p"))
        return _out(placed, name, F.col("_p"))
    return score


def fit_knn(train: DataFrame, k: int = config.KNN_K, name: str = "knn") -> Scorer:
    sc = fit_scaler(train)
    return scorer_of("neighbours", name, {"scaler": sc, "k": k}, apply_scaler(train, sc).select("id", "label", "features"))


@kind("neighbours")
def _score_neighbours(name: str, params: dict, table, members):
    from neurotab.operators.knn import knn_classify

    def score(df: DataFrame) -> DataFrame:
        out = knn_classify(table, apply_scaler(df, params["scaler"]), params["k"])
        return out.select("id", F.lit(name).alias("model"), "prediction", "p0", "p1", "p2")
    return score


def fit_mlp(train: DataFrame, hidden: Sequence[int] = (32, 16), max_iter: int = 200, seed: int = config.SEED,
            name: str = "mlp", k: int = K) -> Scorer:
    """Feed-forward network on the selected feature vector (stand-in for the
    single-machine deep models)."""
    sc = fit_scaler(train)
    d = len(sc[0])
    mlp = MultilayerPerceptronClassifier(featuresCol="fv", labelCol="label", layers=[d, *hidden, k],
                                         maxIter=max_iter, seed=seed)
    return scorer_of("probability", name, {"scaler": sc}, _fit_cached(mlp, _vec(apply_scaler(train, sc))))


# row and feature sampling of the three boosted models
BOOSTING_CONFIGS = {"gbt_a": {}, "gbt_b": {"rows": 0.8}, "gbt_c": {"features": "sqrt"}}


def fit_forests(train: DataFrame, plans: dict[str, Plan], k: int = K) -> list[Scorer]:
    """One boosted scorer a plan, all grown together (``learn.boosting``)."""
    cuts, trees, _ = boost(train, list(plans.values()), classes=k)
    return [scorer_of("forest", name, {"cuts": cuts, "k": k}, trees.where(F.col("plan") == i).drop("plan")) for i, name in enumerate(plans)]


def fit_boosted(train: DataFrame, iters: int = 200, depth: int = 6, step: float = 0.05, name: str = "gbt", k: int = K) -> Scorer:
    """Histogram-boosted trees, 200 rounds x depth 6 x 0.05, softmax over the classes."""
    return fit_forests(train, {name: Plan(iters, depth, step)}, k)[0]


def boosted_out_of_fold(data: DataFrame, fold_col: str, folds: list, iters: int = 200, depth: int = 6, step: float = 0.05, k: int = K) -> DataFrame:
    """(id, margins) of every row by the trees that left its fold out; all folds
    are grown together."""
    plans = [Plan(iters, depth, step, leave_out=int(f)) for f in folds]
    return boost(data, plans, fold_col, k, keep_trees=False)[2].select("id", "margins")


@kind("forest")
def _score_forest(name: str, params: dict, trees, members):
    return lambda df: _out(forest_margins(df, params["cuts"], trees, params["k"]), name, _softmax(F.col("margins")))


def fit_boosting_ensemble(train: DataFrame, iters: int = 300, depth: int | Sequence[int] = 6, step: float = 0.05,
                          name: str = "boosting") -> Scorer:
    """Three boosted configurations (row / feature sampling differ), 300 x 6 x
    0.05, grown together and combined by soft voting (mean probability, argmax).
    ``depth`` is one for all or one for each."""
    depths = [depth] * len(BOOSTING_CONFIGS) if isinstance(depth, int) else depth
    plans = {n: Plan(iters, d, step, **c) for (n, c), d in zip(BOOSTING_CONFIGS.items(), depths, strict=True)}
    return scorer_of("soft_vote", name, members=fit_forests(train, plans))


@kind("soft_vote")
def _score_soft_vote(name: str, params: dict, model, members):
    from neurotab.operators.ensemble import soft_vote

    def score(df: DataFrame) -> DataFrame:
        allp = None
        for m in members:
            s = m.score(df)
            allp = s if allp is None else allp.unionByName(s)
        v = soft_vote(allp, "id", [f"p{c}" for c in range(K)])
        return v.select("id", F.lit(name).alias("model"), "prediction", *[f"p{c}" for c in range(K)])
    return score


BASE_MODELS: dict[str, Callable[[DataFrame], Scorer]] = {
    "svm": fit_svm_rff,
    "random_forest": fit_random_forest,
    "knn": fit_knn,
    "lda": fit_discriminant,
    "gbt": fit_boosted,
}

# (data, fold column, folds) -> (id, margins) or (id, shares, fold): all folds in the same passes
OUT_OF_FOLD: dict[Callable, Callable[[DataFrame, str, list], DataFrame | None]] = {
    fit_svm_rff: svm_out_of_fold, fit_boosted: boosted_out_of_fold, fit_random_forest: forest_out_of_fold}


def out_of_fold_scores(fit: Callable, data: DataFrame, fold_col: str, folds: list, name: str) -> DataFrame | None:
    """(id, model, prediction, p0..[, fold]) of the folds' left-out rows, for models
    that fit all folds together; None for the others."""
    held = OUT_OF_FOLD[fit](data, fold_col, folds) if fit in OUT_OF_FOLD else None
    if held is None:
        return None
    if "shares" in held.columns:
        return _out(held, name, F.col("shares"), keep=[fold_col])
    return _out(held, name, _softmax(F.col("margins")))


@kind("stacking")
def _score_stacking(name: str, params: dict, model, members):
    names, meta = params["names"], members[-1]

    def score(df: DataFrame) -> DataFrame:
        base = None
        for n, member in zip(names, members):
            s = member.score(df).withColumn("model", F.lit(n))
            base = s if base is None else base.unionByName(s)
        return meta.score(meta_features(base, names))
    return score


def meta_features(scored: DataFrame, names: Sequence[str]) -> DataFrame:
    """Probabilities of the base models side by side, in the order of the names."""
    from neurotab.operators.ensemble import stack_probabilities

    wide = stack_probabilities(scored, "id", ["p0", "p1", "p2"], list(names))
    cols = [f"m{n}_p{c}" for n in names for c in range(3)]
    return wide.select("id", F.array(*[F.coalesce(F.col(f"`{c}`"), F.lit(0.0)) for c in cols]).alias("features"))


def get_model(name: str) -> Callable[[DataFrame], Scorer]:
    """Model factory by name; unknown names raise ValueError."""
    table = {**BASE_MODELS, "logreg": fit_logreg, "mlp": fit_mlp, "boosting": fit_boosting_ensemble}
    try:
        return table[name]
    except KeyError:
        raise ValueError(f"unknown model {name!r}; known: {sorted(table)}") from None


def score_long(scored: DataFrame) -> DataFrame:
    """(id, model, prediction, p0..) -> (id, model, class, prob)."""
    arr = F.array(*[F.struct(F.lit(c).alias("class"), F.col(f"p{c}").alias("prob")) for c in range(K)])
    return scored.select("id", "model", F.explode(arr).alias("_e")).select("id", "model", "_e.class", "_e.prob")
