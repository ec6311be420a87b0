"""Nearest-neighbour, balancing and model queries on the ``feat`` fixture."""

from __future__ import annotations

from pyspark.sql import functions as F

from neurotab import fixtures as fx
from neurotab.operators import balance as ba
from neurotab.operators.folds import stratified_folds
from neurotab.operators.knn import knn_classify, knn_join
from neurotab.plans.common import rounded
from neurotab.plans.oracle_views import sql
from neurotab.plans.registry import register
from neurotab.session import cut_lineage


def _feat_folds(spark, sf_dir):
    folds = stratified_folds(fx.labelled_ids(spark, sf_dir)).select("id", "fold")
    return fx.feat_wide(spark, sf_dir).join(folds, "id")


KNN_CTES = [
    ("lab", "SELECT DISTINCT id, label FROM feat"),
    ("tr", "SELECT f.* FROM feat f JOIN folds o ON o.id = f.id WHERE o.fold <> 0"),
    ("te", "SELECT f.* FROM feat f JOIN folds o ON o.id = f.id WHERE o.fold = 0"),
    ("d", """SELECT q.id AS q_id, p.id AS p_id, sqrt(sum((q.value - p.value) * (q.value - p.value))) AS distance
FROM te q JOIN tr p ON q.feature = p.feature GROUP BY 1, 2"""),
    ("nn", """SELECT d.q_id, d.p_id, l.label, row_number() OVER (PARTITION BY d.q_id ORDER BY round(d.distance, 9), d.p_id) AS rk
FROM d JOIN lab l ON l.id = d.p_id"""),
    ("votes", """SELECT q_id, count_if(label = 0) AS v0, count_if(label = 1) AS v1, count_if(label = 2) AS v2, count(*) AS n
FROM nn WHERE rk <= 7 GROUP BY 1"""),
]


@register("knn_classify", sql(["feat", "folds"], """SELECT q_id AS id,
       CASE WHEN v0 >= v1 AND v0 >= v2 THEN 0 WHEN v1 >= v2 THEN 1 ELSE 2 END AS prediction,
       round(v0 / n, 6) AS p0, round(v1 / n, 6) AS p1, round(v2 / n, 6) AS p2 FROM votes""", KNN_CTES))
def q_knn_classify(spark, sf_dir):
    """k = 7 Euclidean vote; train = folds 1-4, test = fold 0."""
    data = _feat_folds(spark, sf_dir)
    train, test = data.where("fold != 0"), data.where("fold = 0")
    return rounded(knn_classify(train, test, 7))


SMOTE_NN_CTES = [
    ("lab", "SELECT DISTINCT id, label FROM feat"),
    ("kk", "SELECT CASE WHEN min(n) <= 1 THEN 1 ELSE least(5, min(n) - 1) END AS k FROM (SELECT label, count(*) AS n FROM lab GROUP BY 1)"),
    ("d", """SELECT q.id AS q_id, p.id AS p_id, sqrt(sum((q.value - p.value) * (q.value - p.value))) AS distance
FROM feat q JOIN feat p ON q.feature = p.feature AND q.label = p.label AND q.id <> p.id GROUP BY 1, 2"""),
    ("nn", """SELECT d.q_id, l.label, d.p_id, CAST(row_number() OVER (PARTITION BY d.q_id ORDER BY round(d.distance, 9), d.p_id) AS INT) AS rank
FROM d JOIN lab l ON l.id = d.q_id"""),
]


@register("smote_neighbors", sql(["feat"], "SELECT q_id, label, p_id, rank FROM nn WHERE rank <= (SELECT k FROM kk)",
                                 SMOTE_NN_CTES))
def q_smote_neighbors(spark, sf_dir):
    data = fx.feat_wide(spark, sf_dir)
    counts = [r[1] for r in data.groupBy("label").count().collect()]
    k = ba.smote_neighbour_k(counts)
    nn = knn_join(data, data, k, partition=["label"], exclude_self=True)
    return nn.select("q_id", "label", "p_id", F.col("rank").cast("int").alias("rank"))


SMOTE_CTES = SMOTE_NN_CTES + [
    ("cnt", "SELECT label, count(*) AS nc, max(count(*)) OVER () - count(*) AS nnew FROM lab GROUP BY 1"),
    ("num", "SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY id) - 1 AS pos FROM lab"),
    ("syn", """SELECT c.label, j.range AS syn_idx, n.id AS src_id,
       1 + ('0x' || substr(md5(concat_ws('-', '42', CAST(c.label AS VARCHAR), CAST(j.range AS VARCHAR))), 1, 8))::BIGINT % (SELECT k FROM kk) AS nnr,
       ('0x' || substr(md5(concat_ws('-', '42', CAST(c.label AS VARCHAR), CAST(j.range AS VARCHAR))), 9, 8))::BIGINT / 4294967296.0 AS u
FROM cnt c JOIN (SELECT unnest(range(0, (SELECT max(nnew) FROM cnt))) AS range) j ON j.range < c.nnew
JOIN num n ON n.label = c.label AND n.pos = j.range % c.nc"""),
    ("synv", """SELECT s.label, true AS is_synthetic, s.src_id, s.syn_idx, x.feature AS position,
       x.value + s.u * (y.value - x.value) AS value
FROM syn s JOIN nn ON nn.q_id = s.src_id AND nn.rank = s.nnr
JOIN feat x ON x.id = s.src_id JOIN feat y ON y.id = nn.p_id AND y.feature = x.feature"""),
]


@register("smote_balance", sql(["feat"], """SELECT label, is_synthetic, src_id, CAST(syn_idx AS BIGINT) AS syn_idx,
       CAST(position AS INT) AS position, round(value, 6) AS value FROM synv
UNION ALL SELECT label, false, id, NULL, feature, round(value, 6) FROM feat""", SMOTE_CTES))
def q_smote_balance(spark, sf_dir):
    out = ba.smote(fx.feat_wide(spark, sf_dir).select("id", "label", "features"))
    return rounded(out.select("label", "is_synthetic", "src_id", "syn_idx",
                              F.posexplode("features").alias("position", "value")))


# ---------------------------------------------------------------- Spark ML models ([R]: rows-only)

from neurotab.learn import models as md  # noqa: E402
from neurotab.learn import validation as va  # noqa: E402


def _split(spark, sf_dir):
    """Training folds, fold 0 and all rows, written once: a fit reads them many times."""
    data = cut_lineage(_feat_folds(spark, sf_dir).select("id", "label", "features", "fold"))
    return data.where("fold != 0"), data.where("fold = 0"), data


def _scored(scorer, valid):
    return rounded(scorer.score(valid))


@register("ml_logreg")
def q_ml_logreg(spark, sf_dir):
    train, valid, _ = _split(spark, sf_dir)
    return _scored(md.fit_logreg(train), valid)


@register("ml_random_forest")
def q_ml_random_forest(spark, sf_dir):
    train, valid, _ = _split(spark, sf_dir)
    return _scored(md.fit_random_forest(train), valid)


@register("ml_gbt_ovr")
def q_ml_gbt_ovr(spark, sf_dir):
    """One-vs-rest boosted trees, 200 rounds x depth 6 x 0.05."""
    train, valid, _ = _split(spark, sf_dir)
    return _scored(md.fit_gbt_ovr(train, iters=200, depth=6, step=0.05), valid)


@register("ml_boosting")
def q_ml_boosting(spark, sf_dir):
    """Soft vote of the three boosted configurations, 300 rounds x depth 6 x 0.05 each."""
    train, valid, _ = _split(spark, sf_dir)
    return _scored(md.fit_boosting_ensemble(train), valid)


@register("ml_svm_rff")
def q_ml_svm_rff(spark, sf_dir):
    train, valid, _ = _split(spark, sf_dir)
    return _scored(md.fit_svm_rff(train), valid)


@register("ml_discriminant")
def q_ml_discriminant(spark, sf_dir):
    train, valid, _ = _split(spark, sf_dir)
    return _scored(md.fit_discriminant(train), valid)


@register("ml_mlp")
def q_ml_mlp(spark, sf_dir):
    train, valid, _ = _split(spark, sf_dir)
    return _scored(md.fit_mlp(train), valid)


@register("base_model_scores")
def q_base_model_scores(spark, sf_dir):
    """All base models fitted on the training folds, scored on fold 0, long form."""
    train, valid, _ = _split(spark, sf_dir)
    return rounded(md.score_long(va.fit_and_score(train, valid, md.BASE_MODELS)))


@register("oof_predictions")
def q_oof_predictions(spark, sf_dir):
    _, _, data = _split(spark, sf_dir)
    return rounded(va.oof_predictions(data, md.BASE_MODELS))


@register("ml_stacking")
def q_ml_stacking(spark, sf_dir):
    train, valid, _ = _split(spark, sf_dir)
    folds = stratified_folds(train.select("id", "label"), out="inner_fold").select("id", "inner_fold")
    inner = cut_lineage(train.join(folds, "id"))
    return _scored(va.fit_stacking(inner, md.BASE_MODELS, fold_col="inner_fold"), valid)


@register("cv_evaluate")
def q_cv_evaluate(spark, sf_dir):
    _, _, data = _split(spark, sf_dir)
    return va.cross_validate(data, md.fit_logreg)


TRIALS_CTES = [("trials", """SELECT x.model AS trial, 3 + x.model AS max_depth, 0.01 * (x.model + 1) AS learning_rate,
       100 * (x.model + 1) AS n_trees, round(avg(CASE WHEN x.y_true = x.y_pred THEN 1.0 ELSE 0.0 END), 6) AS mean_accuracy
FROM pred x JOIN folds f ON f.id = x.id GROUP BY 1, 2, 3, 4""")]


@register("tuning_best", sql(["pred", "folds"], """SELECT trial, max_depth, learning_rate, n_trees, mean_accuracy FROM trials
ORDER BY mean_accuracy DESC, trial LIMIT 1""", TRIALS_CTES))
def q_tuning_best(spark, sf_dir):
    """Best trial of a trial table (each scored model of ``pred`` is one trial
    with parameters derived from its number)."""
    p = fx.pred(spark, sf_dir)
    res = p.groupBy(F.col("model").alias("trial")).agg(
        F.round(F.avg(F.when(F.col("y_true") == F.col("y_pred"), 1.0).otherwise(0.0)), 6).alias("mean_accuracy"))
    res = res.select("trial", (F.col("trial") + 3).alias("max_depth"), (F.col("trial") + 1) * 0.01,
                     ((F.col("trial") + 1) * 100).alias("n_trees"), "mean_accuracy") \
        .withColumnRenamed("((trial + 1) * 0.01)", "learning_rate")
    return va.best_trial(res)


@register("tuning_search")
def q_tuning_search(spark, sf_dir):
    """15 sampled trials, 3-fold accuracy each of the soft-voted boosting ensemble
    with the trial's depths, learning rate and tree count; ``is_best`` marks the
    best trial."""
    data = fx.feat_wide(spark, sf_dir).select("id", "label", "features")
    data = stratified_folds(data, k=3)
    trials = va.trial_table(spark)
    res = cut_lineage(va.tune_boosting(data, trials))
    best = va.best_trial(res).first()["trial"]
    return res.withColumn("is_best", F.col("trial") == F.lit(best))


@register("permutation_importance")
def q_permutation_importance(spark, sf_dir):
    from neurotab.operators.explain import permutation_importance
    train, valid, _ = _split(spark, sf_dir)
    return rounded(permutation_importance(md.fit_logreg(train), valid, [f"f{i}" for i in range(64)]))


LDA2_CTES = [
    ("x", """SELECT vec_id AS id, label % 3 AS label, CAST(embedding[1] AS DOUBLE) AS x1, CAST(embedding[2] AS DOUBLE) AS x2
FROM embeddings"""),
    ("m", "SELECT label, avg(x1) AS m1, avg(x2) AS m2, CAST(count(*) AS DOUBLE) AS nc FROM x GROUP BY 1"),
    ("s", """SELECT sum((x.x1 - m.m1) * (x.x1 - m.m1)) / (count(*) - 3) AS c11,
       sum((x.x1 - m.m1) * (x.x2 - m.m2)) / (count(*) - 3) AS c12,
       sum((x.x2 - m.m2) * (x.x2 - m.m2)) / (count(*) - 3) AS c22, CAST(count(*) AS DOUBLE) AS n
FROM x JOIN m ON m.label = x.label"""),
    ("w", """SELECT m.label, (s.c22 * m.m1 - s.c12 * m.m2) / (s.c11 * s.c22 - s.c12 * s.c12) AS w1,
       (s.c11 * m.m2 - s.c12 * m.m1) / (s.c11 * s.c22 - s.c12 * s.c12) AS w2, m.m1, m.m2, m.nc, s.n
FROM m CROSS JOIN s"""),
    ("sc", """SELECT x.id, w.label, w.w1 * x.x1 + w.w2 * x.x2 - 0.5 * (w.w1 * w.m1 + w.w2 * w.m2) + ln(w.nc / w.n) AS d
FROM x CROSS JOIN w"""),
    ("e", "SELECT id, label, exp(d - max(d) OVER (PARTITION BY id)) AS e FROM sc"),
    ("p", "SELECT id, label, e / sum(e) OVER (PARTITION BY id) AS p FROM e"),
]


@register("ml_discriminant_2d", sql([], """SELECT id, 'lda' AS model,
       CAST(CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS INT) AS prediction,
       round(p0, 6) AS p0, round(p1, 6) AS p1, round(p2, 6) AS p2
FROM (SELECT id, max(CASE WHEN label = 0 THEN p END) AS p0, max(CASE WHEN label = 1 THEN p END) AS p1,
             max(CASE WHEN label = 2 THEN p END) AS p2 FROM p GROUP BY 1)""", LDA2_CTES))
def q_ml_discriminant_2d(spark, sf_dir):
    """Linear discriminant on two features (fitted and scored on all rows): the
    distributed fit (class means, pooled covariance through Spark's correlation)
    against the closed-form 2 x 2 inverse in SQL."""
    data = fx.feat_wide(spark, sf_dir).select("id", "label", F.slice("features", 1, 2).alias("features"))
    return rounded(md.fit_discriminant(data).score(data))


LOSO2_CTES = [
    ("x", """SELECT vec_id AS id, vec_id % 23 AS subject_id, label % 3 AS label, CAST(embedding[1] AS DOUBLE) AS x1, CAST(embedding[2] AS DOUBLE) AS x2
FROM embeddings"""),
    ("subj", "SELECT DISTINCT subject_id AS s FROM x"),
    ("m", "SELECT s, label, avg(x1) AS m1, avg(x2) AS m2, CAST(count(*) AS DOUBLE) AS nc FROM x JOIN subj ON subject_id <> s GROUP BY 1, 2"),
    ("v", """SELECT m.s, sum((x.x1 - m.m1) * (x.x1 - m.m1)) / (count(*) - 3) AS c11, sum((x.x1 - m.m1) * (x.x2 - m.m2)) / (count(*) - 3) AS c12,
       sum((x.x2 - m.m2) * (x.x2 - m.m2)) / (count(*) - 3) AS c22, CAST(count(*) AS DOUBLE) AS n
FROM x JOIN m ON m.label = x.label AND x.subject_id <> m.s GROUP BY 1"""),
    ("w", """SELECT m.s, m.label, (v.c22 * m.m1 - v.c12 * m.m2) / (v.c11 * v.c22 - v.c12 * v.c12) AS w1,
       (v.c11 * m.m2 - v.c12 * m.m1) / (v.c11 * v.c22 - v.c12 * v.c12) AS w2, m.m1, m.m2, m.nc, v.n
FROM m JOIN v ON v.s = m.s"""),
    ("sc", """SELECT x.id, x.subject_id, x.label AS y, w.label, w.w1 * x.x1 + w.w2 * x.x2 - 0.5 * (w.w1 * w.m1 + w.w2 * w.m2) + ln(w.nc / w.n) AS d
FROM x JOIN w ON w.s = x.subject_id"""),
    ("e", "SELECT *, exp(d - max(d) OVER (PARTITION BY id)) AS e FROM sc"),
    ("q", "SELECT *, e / sum(e) OVER (PARTITION BY id) AS p FROM e"),
    ("pr", """SELECT id, subject_id, y AS label, max(CASE WHEN label = 0 THEN p END) AS p0, max(CASE WHEN label = 1 THEN p END) AS p1,
       max(CASE WHEN label = 2 THEN p END) AS p2 FROM q GROUP BY 1, 2, 3"""),
    ("pred", "SELECT *, CAST(CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS INT) AS prediction FROM pr"),
]


def _two_features(spark, sf_dir):
    return fx.feat_wide(spark, sf_dir).select("id", "subject_id", "label", F.slice("features", 1, 2).alias("features"))


@register("loso_predictions", sql([], """SELECT id, subject_id, CAST(label AS INT) AS label, 'lda' AS model, prediction,
       round(p0, 6) AS p0, round(p1, 6) AS p1, round(p2, 6) AS p2 FROM pred""", LOSO2_CTES))
def q_loso_predictions(spark, sf_dir):
    """Leave-one-subject-out predictions of the discriminant on two features,
    every subject from the same statistics."""
    return rounded(va.loso_predictions(_two_features(spark, sf_dir)))


@register("loso_evaluate", sql([], """SELECT subject_id, count(*) AS n, round(avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END), 6) AS accuracy
FROM pred GROUP BY 1""", LOSO2_CTES))
def q_loso_evaluate(spark, sf_dir):
    """Accuracy per left-out subject, two features."""
    out = va.loso_predictions(_two_features(spark, sf_dir))
    return rounded(out.groupBy("subject_id").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("accuracy")))


@register("loso_evaluate_64")
def q_loso_evaluate_64(spark, sf_dir):
    """Predictions of the same on all 64 features."""
    return rounded(va.loso_predictions(fx.feat_wide(spark, sf_dir).select("id", "subject_id", "label", "features")))


PERMUTED_CTES = [c for c in LDA2_CTES if c[0] in ("x", "m", "s", "w")] + [
    ("rk", "SELECT *, row_number() OVER (ORDER BY md5(concat_ws('-', '42', CAST(id AS VARCHAR))), id) - 1 AS r, count(*) OVER () AS nn FROM x"),
    ("vr", """SELECT a.id, a.label AS y, j.j, CASE WHEN j.j = 0 THEN b.x1 ELSE a.x1 END AS x1, CASE WHEN j.j = 1 THEN b.x2 ELSE a.x2 END AS x2
FROM rk a JOIN rk b ON a.r = (b.r + 1) % b.nn CROSS JOIN (VALUES (-1), (0), (1)) AS j(j)"""),
    ("vs", "SELECT v.id, v.y, v.j, w.label, w.w1 * v.x1 + w.w2 * v.x2 - 0.5 * (w.w1 * w.m1 + w.w2 * w.m2) + ln(w.nc / w.n) AS d FROM vr v CROSS JOIN w"),
    ("vp", "SELECT id, y, j, arg_max(label, (d, -label)) AS p FROM vs GROUP BY 1, 2, 3"),
    ("va", "SELECT j, avg(CASE WHEN p = y THEN 1.0 ELSE 0.0 END) AS a FROM vp GROUP BY 1"),
]


@register("permutation_importance_2d", sql([], """SELECT 'f' || j AS feature, round((SELECT a FROM va WHERE j = -1) - a, 6) + 0.0 AS importance
FROM va WHERE j >= 0""", PERMUTED_CTES))
def q_permutation_importance_2d(spark, sf_dir):
    """Permutation importance of the two-feature discriminant on all rows."""
    from neurotab.operators.explain import permutation_importance

    data = fx.feat_wide(spark, sf_dir).select("id", "label", F.slice("features", 1, 2).alias("features"))
    return rounded(permutation_importance(md.fit_discriminant(data), data, ["f0", "f1"]))
