"""Evaluation queries on ``pred`` (five models x scored rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from neurotab import fixtures as fx
from neurotab.operators import evaluation as ev
from neurotab.operators.folds import stratified_folds
from neurotab.plans.common import rounded
from neurotab.plans.oracle_views import sql
from neurotab.plans.registry import register

G = ["model"]
PROBS = ["p0", "p1", "p2"]

CELLS = ("cells", """SELECT m.model, CAST(t.range AS INT) AS y_true, CAST(p.range AS INT) AS y_pred, count(x.id) AS n
FROM (SELECT DISTINCT model FROM pred) m CROSS JOIN range(0, 3) t CROSS JOIN range(0, 3) p
LEFT JOIN pred x ON x.model = m.model AND x.y_true = t.range AND x.y_pred = p.range
GROUP BY 1, 2, 3""")


@register("confusion_matrix", sql(["pred"], """SELECT model, y_true, y_pred, n,
       round(n / CASE WHEN sum(n) OVER (PARTITION BY model, y_true) = 0 THEN 1 ELSE sum(n) OVER (PARTITION BY model, y_true) END, 4) AS ratio
FROM cells""", [CELLS]))
def q_confusion_matrix(spark, sf_dir):
    return ev.confusion_matrix(fx.pred(spark, sf_dir), G)


PC_CTES = [CELLS, ("pc", """SELECT model, CAST(c.range AS INT) AS class,
       sum(CASE WHEN y_true = c.range AND y_pred = c.range THEN n ELSE 0 END) AS tp,
       sum(CASE WHEN y_true <> c.range AND y_pred = c.range THEN n ELSE 0 END) AS fp,
       sum(CASE WHEN y_true = c.range AND y_pred <> c.range THEN n ELSE 0 END) AS fn,
       sum(CASE WHEN y_true <> c.range AND y_pred <> c.range THEN n ELSE 0 END) AS tn
FROM cells CROSS JOIN range(0, 3) c GROUP BY 1, 2"""),
           ("pc2", """SELECT model, class, tp, fp, fn, tn,
       CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS precision,
       CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS recall FROM pc"""),
           ("pc3", """SELECT model, class, precision, recall,
       CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END AS f1,
       tp + fn AS support, tn / greatest(tn + fp, 1) AS specificity FROM pc2""")]


@register("per_class_metrics", sql(["pred"], """SELECT model, class, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(f1, 6) AS f1, CAST(support AS BIGINT) AS support, round(specificity, 6) AS specificity FROM pc3""", PC_CTES))
def q_per_class_metrics(spark, sf_dir):
    return rounded(ev.per_class_metrics(fx.pred(spark, sf_dir), G))


OVERALL_BODY = """SELECT a.model, round(a.c / a.s, 4) AS accuracy, round(f.macro_f1, 4) AS macro_f1,
       round(f.weighted_f1, 4) AS weighted_f1,
       round(CASE WHEN 1 - a.tp / (a.s * a.s) = 0 THEN 0.0 ELSE (a.c / a.s - a.tp / (a.s * a.s)) / (1 - a.tp / (a.s * a.s)) END, 4) AS cohens_kappa,
       round(CASE WHEN (a.s * a.s - a.pp) * (a.s * a.s - a.tt) = 0 THEN 0.0
                  ELSE (a.c * a.s - a.tp) / sqrt((a.s * a.s - a.pp) * (a.s * a.s - a.tt)) END, 4) AS mcc,
       round(f.balanced_accuracy, 4) AS balanced_accuracy
FROM (SELECT m.model, CAST(m.s AS DOUBLE) AS s, CAST(m.c AS DOUBLE) AS c, CAST(sum(r.t * q.p) AS DOUBLE) AS tp,
             CAST(sum(r.t * r.t) AS DOUBLE) AS tt, CAST(sum(q.p * q.p) AS DOUBLE) AS pp
      FROM (SELECT model, sum(n) AS s, sum(CASE WHEN y_true = y_pred THEN n ELSE 0 END) AS c FROM cells GROUP BY 1) m
      JOIN (SELECT model, y_true AS k, sum(n) AS t FROM cells GROUP BY 1, 2) r ON r.model = m.model
      JOIN (SELECT model, y_pred AS k, sum(n) AS p FROM cells GROUP BY 1, 2) q ON q.model = m.model AND q.k = r.k
      GROUP BY 1, 2, 3) a
JOIN (SELECT model, avg(f1) AS macro_f1, CASE WHEN sum(support) = 0 THEN 0.0 ELSE sum(f1 * support) / sum(support) END AS weighted_f1,
             avg(CASE WHEN support > 0 THEN recall END) AS balanced_accuracy FROM pc3 GROUP BY 1) f ON f.model = a.model"""


@register("overall_metrics", sql(["pred"], OVERALL_BODY, PC_CTES))
def q_overall_metrics(spark, sf_dir):
    return ev.overall_metrics(fx.pred(spark, sf_dir), G)


@register("kappa_mcc", sql(["pred"], "SELECT model, cohens_kappa, mcc FROM (" + OVERALL_BODY + ")", PC_CTES))
def q_kappa_mcc(spark, sf_dir):
    return ev.overall_metrics(fx.pred(spark, sf_dir), G).select("model", "cohens_kappa", "mcc")


OVR = ("ovr", """SELECT model, CAST(c.range AS INT) AS class, id,
       CASE c.range WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END AS score,
       CASE WHEN y_true = c.range THEN 1 ELSE 0 END AS positive
FROM pred CROSS JOIN range(0, 3) c""")

AUC_BODY = """SELECT model, class, round(auc, 4) AS roc_auc FROM auc
UNION ALL SELECT model, -1 AS class, round(avg(auc), 4) AS roc_auc FROM auc GROUP BY 1"""
AUC_CTE = ("auc", """SELECT model, class,
       (sum(CASE WHEN positive = 1 THEN rk END) - sum(positive) * (sum(positive) + 1) / 2.0)
       / (sum(positive) * (count(*) - sum(positive))) AS auc
FROM (SELECT *, rank() OVER (PARTITION BY model, class ORDER BY score)
                + (count(*) OVER (PARTITION BY model, class, score) - 1) / 2.0 AS rk FROM ovr)
GROUP BY 1, 2 HAVING sum(positive) > 0""")


def _ovr(spark, sf_dir):
    return ev.one_vs_rest(fx.pred(spark, sf_dir), G, PROBS)


@register("roc_auc_ovr", sql(["pred"], AUC_BODY, [OVR, AUC_CTE]))
def q_roc_auc(spark, sf_dir):
    return ev.roc_auc(_ovr(spark, sf_dir), G)


THR = ("thr", """SELECT model, class, score, pos, neg,
       sum(pos) OVER (PARTITION BY model, class ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tps,
       sum(neg) OVER (PARTITION BY model, class ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fps,
       sum(pos) OVER (PARTITION BY model, class) AS n_pos, sum(neg) OVER (PARTITION BY model, class) AS n_neg
FROM (SELECT model, class, score, sum(positive) AS pos, sum(1 - positive) AS neg FROM ovr GROUP BY 1, 2, 3)""")


@register("average_precision", sql(["pred"], """SELECT model, class, round(sum((r - coalesce(r_prev, 0)) * p), 4) AS average_precision
FROM (SELECT model, class, tps / n_pos AS r, tps / (tps + fps) AS p,
             lag(tps / n_pos) OVER (PARTITION BY model, class ORDER BY score DESC) AS r_prev FROM thr WHERE n_pos > 0)
GROUP BY 1, 2""", [OVR, THR]))
def q_average_precision(spark, sf_dir):
    return ev.average_precision(_ovr(spark, sf_dir), G)


PTS = ("pts", """SELECT model, class, CAST(row_number() OVER (PARTITION BY model, class ORDER BY r) - 1 AS INT) AS point,
       fps / n_neg AS fpr, tps / n_pos AS tpr
FROM (SELECT model, class, r, fps, tps, n_pos, n_neg FROM
        (SELECT *, row_number() OVER w AS r, count(*) OVER (PARTITION BY model, class) AS m,
                lead(fps) OVER w - 2 * fps + lag(fps) OVER w AS d2f, lead(tps) OVER w - 2 * tps + lag(tps) OVER w AS d2t
         FROM thr WHERE n_pos > 0 WINDOW w AS (PARTITION BY model, class ORDER BY score DESC))
      WHERE m <= 2 OR r = 1 OR r = m OR d2f <> 0 OR d2t <> 0
      UNION ALL
      SELECT DISTINCT model, class, 0 AS r, 0 AS fps, 0 AS tps, n_pos, n_neg FROM thr WHERE n_pos > 0)""")


@register("roc_points", sql(["pred"], "SELECT model, class, point, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr FROM pts",
                            [OVR, THR, PTS]))
def q_roc_points(spark, sf_dir):
    out = ev.roc_points(_ovr(spark, sf_dir), G).withColumn("point", F.col("point").cast("int"))
    return rounded(out)


SUB = ("sub", """SELECT p.model, p.class, CAST(g.i AS INT) AS i, round(p.fpr, 4) AS fpr, round(p.tpr, 4) AS tpr
FROM (SELECT model, class, count(*) AS l, least(50, count(*)) AS m FROM pts GROUP BY 1, 2) h
CROSS JOIN range(0, 50) gi(i)
JOIN pts p ON p.model = h.model AND p.class = h.class
          AND p.point = CASE WHEN h.m > 1 THEN (gi.i * (h.l - 1)) // (h.m - 1) ELSE 0 END
CROSS JOIN (SELECT 1) g0
JOIN (SELECT range AS i FROM range(0, 50)) g ON g.i = gi.i
WHERE gi.i < h.m""")


@register("roc_subsample", sql(["pred"], "SELECT model, class, i, fpr, tpr FROM sub", [OVR, THR, PTS, SUB]))
def q_roc_subsample(spark, sf_dir):
    return ev.roc_subsample(ev.roc_points(_ovr(spark, sf_dir), G), G)


@register("roc_nearest_merge", sql(["pred"], """SELECT g.fpr, c.model, c.class, arg_min(c.tpr, (abs(c.fpr - g.fpr), c.i)) AS tpr
FROM (SELECT DISTINCT fpr FROM sub) g CROSS JOIN sub c GROUP BY 1, 2, 3""", [OVR, THR, PTS, SUB]))
def q_roc_nearest_merge(spark, sf_dir):
    curves = ev.roc_subsample(ev.roc_points(_ovr(spark, sf_dir), G), G)
    return ev.nearest_merge(curves, ["model", "class"])


@register("mcnemar", sql(["pred"], """SELECT a.model AS model_a, b.model AS model_b,
       CAST(count_if(a.y_true = a.y_pred AND b.y_true <> b.y_pred) AS BIGINT) AS b,
       CAST(count_if(a.y_true <> a.y_pred AND b.y_true = b.y_pred) AS BIGINT) AS c,
       round(CASE WHEN count_if(a.y_true = a.y_pred AND b.y_true <> b.y_pred) + count_if(a.y_true <> a.y_pred AND b.y_true = b.y_pred) > 0
             THEN power(abs(count_if(a.y_true = a.y_pred AND b.y_true <> b.y_pred) - count_if(a.y_true <> a.y_pred AND b.y_true = b.y_pred)) - 1, 2)
                  / (count_if(a.y_true = a.y_pred AND b.y_true <> b.y_pred) + count_if(a.y_true <> a.y_pred AND b.y_true = b.y_pred))
             ELSE 0.0 END, 4) AS statistic
FROM pred a JOIN pred b ON a.id = b.id AND a.model < b.model GROUP BY 1, 2"""))
def q_mcnemar(spark, sf_dir):
    return ev.mcnemar(fx.pred(spark, sf_dir), [0, 1, 2, 3, 4])


# upper tail of chi-square with one degree of freedom = 1 - erf(z), z = sqrt(x / 2), by the series with positive terms
# erf(z) = exp(-z^2) * sum of z^(2n+1) / gamma(n + 3/2)
MCNEMAR_TEST_BODY = """SELECT model_a, model_b, b, c, round(stat, 4) AS statistic,
       round(CASE WHEN b + c = 0 THEN 1.0 WHEN stat = 0 THEN 1.0 ELSE 1 - (
         SELECT sum(exp((2 * n + 1) * 0.5 * ln(stat / 2) - stat / 2 - lgamma(n + 1.5))) FROM generate_series(0, 400) AS t(n)) END, 6) AS p_value
FROM (SELECT model_a, model_b, b, c, CASE WHEN b + c > 0 THEN power(abs(b - c) - 1, 2) / (b + c) ELSE 0.0 END AS stat FROM mc)"""


@register("mcnemar_test", sql(["pred"], MCNEMAR_TEST_BODY, [("mc", """SELECT a.model AS model_a, b.model AS model_b,
       CAST(count_if(a.y_true = a.y_pred AND b.y_true <> b.y_pred) AS BIGINT) AS b,
       CAST(count_if(a.y_true <> a.y_pred AND b.y_true = b.y_pred) AS BIGINT) AS c
FROM pred a JOIN pred b ON a.id = b.id AND a.model < b.model GROUP BY 1, 2""")]))
def q_mcnemar_test(spark, sf_dir):
    m = ev.mcnemar(fx.pred(spark, sf_dir), [0, 1, 2, 3, 4], digits=None)
    p = ev.chi2_sf_udf()(F.col("statistic"), F.lit(1))
    p = F.when(F.col("b") + F.col("c") > 0, F.round(p, 6)).otherwise(F.lit(1.0))
    return m.withColumn("p_value", p).withColumn("statistic", F.round("statistic", 4))


FOLD_ACC = ("facc", """SELECT x.model, f.fold, avg(CASE WHEN x.y_true = x.y_pred THEN 1.0 ELSE 0.0 END) AS accuracy
FROM pred x JOIN folds f ON f.id = x.id GROUP BY 1, 2""")


def _fold_acc(spark, sf_dir):
    folds = stratified_folds(fx.labelled_ids(spark, sf_dir)).select("id", "fold")
    scored = fx.pred(spark, sf_dir).join(folds, "id")
    return scored.groupBy("model", "fold").agg(
        F.avg(F.when(F.col("y_true") == F.col("y_pred"), 1.0).otherwise(0.0)).alias("accuracy"))


# five models: four degrees of freedom, whose upper tail is exp(-x/2) * (1 + x/2)
FRIEDMAN_BODY = """SELECT n_treatments, n_blocks, round(x, 4) AS statistic, round(exp(-x / 2) * (1 + x / 2), 6) AS p_value
FROM (SELECT CAST(k AS INT) AS n_treatments, CAST(n AS INT) AS n_blocks,
       CASE WHEN k >= 3 THEN (12.0 / (n * k * (k + 1)) * ss - 3 * n * (k + 1)) / (1 - ties / (n * (k * k * k - k))) ELSE 0.0 END AS x
FROM (SELECT (SELECT count(DISTINCT model) FROM facc) AS k, (SELECT count(DISTINCT fold) FROM facc) AS n,
             (SELECT sum(r * r) FROM (SELECT model, sum(rk) AS r FROM rk GROUP BY 1)) AS ss,
             (SELECT sum(t * t * t - t) FROM (SELECT fold, accuracy, count(*) AS t FROM facc GROUP BY 1, 2)) AS ties))"""
RK = ("rk", """SELECT model, fold, rank() OVER (PARTITION BY fold ORDER BY accuracy)
       + (count(*) OVER (PARTITION BY fold, accuracy) - 1) / 2.0 AS rk FROM facc""")


@register("friedman", sql(["pred", "folds"], FRIEDMAN_BODY, [FOLD_ACC, RK]))
def q_friedman(spark, sf_dir):
    return ev.friedman(_fold_acc(spark, sf_dir), "fold", "model", "accuracy")


@register("cv_summary", sql(["pred", "folds"], """SELECT model, round(avg(accuracy), 4) AS mean, round(stddev_pop(accuracy), 4) AS std,
       round(min(accuracy), 4) AS min, round(max(accuracy), 4) AS max, count(*) AS n_folds,
       string_agg(printf('%.4f', round(accuracy, 4)), ' ' ORDER BY fold) AS fold_values FROM facc GROUP BY 1""", [FOLD_ACC]))
def q_cv_summary(spark, sf_dir):
    out = ev.cv_summary(_fold_acc(spark, sf_dir), ["model"], "accuracy")
    text = F.array_join(F.transform("values", lambda v: F.format_string("%.4f", v)), " ")
    return out.withColumn("fold_values", text).drop("values")


REPORT_BODY = """SELECT model, 'per_class' AS section, class, metric, round(value, 6) AS value FROM (
  SELECT model, class, 'precision' AS metric, precision AS value FROM pc3 UNION ALL
  SELECT model, class, 'recall', recall FROM pc3 UNION ALL SELECT model, class, 'f1', f1 FROM pc3 UNION ALL
  SELECT model, class, 'support', CAST(support AS DOUBLE) FROM pc3 UNION ALL SELECT model, class, 'specificity', specificity FROM pc3)
UNION ALL
SELECT model, 'overall', -1, metric, value FROM (
  SELECT model, 'accuracy' AS metric, accuracy AS value FROM ov UNION ALL SELECT model, 'macro_f1', macro_f1 FROM ov UNION ALL
  SELECT model, 'weighted_f1', weighted_f1 FROM ov UNION ALL SELECT model, 'cohens_kappa', cohens_kappa FROM ov UNION ALL
  SELECT model, 'mcc', mcc FROM ov UNION ALL SELECT model, 'balanced_accuracy', balanced_accuracy FROM ov)
UNION ALL
SELECT model, 'confusion', y_true, 'cm_' || CAST(y_true AS VARCHAR) || '_' || CAST(y_pred AS VARCHAR), CAST(n AS DOUBLE) FROM cells
UNION ALL
SELECT model, 'confusion', y_true, 'cmn_' || CAST(y_true AS VARCHAR) || '_' || CAST(y_pred AS VARCHAR),
       round(n / CASE WHEN sum(n) OVER (PARTITION BY model, y_true) = 0 THEN 1 ELSE sum(n) OVER (PARTITION BY model, y_true) END, 4) FROM cells
UNION ALL
SELECT model, 'roc_auc', class, 'roc_auc', roc_auc FROM (""" + AUC_BODY + """)
UNION ALL
SELECT model, 'average_precision', class, 'average_precision', round(sum((r - coalesce(r_prev, 0)) * p), 4) FROM
  (SELECT model, class, tps / n_pos AS r, tps / (tps + fps) AS p,
          lag(tps / n_pos) OVER (PARTITION BY model, class ORDER BY score DESC) AS r_prev FROM thr WHERE n_pos > 0)
GROUP BY 1, 2, 3, 4"""


@register("evaluation_report", sql(["pred"], REPORT_BODY, PC_CTES + [("ov", OVERALL_BODY), OVR, AUC_CTE, THR]))
def q_evaluation_report(spark, sf_dir):
    """Full report of every model in one long table (A21-A26 from one scored table)."""
    out = ev.evaluation_report(fx.pred(spark, sf_dir), G, PROBS)
    return out.withColumn("value", F.round("value", 6))
