"""Fold assignment and training-run analysis queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from neurotab import fixtures as fx
from neurotab.operators import folds as fo
from neurotab.operators import training as tr
from neurotab.plans.common import rounded
from neurotab.plans.oracle_views import VIEWS, sql
from neurotab.plans.registry import register


@register("stratified_folds", sql(["folds"], "SELECT id, label, fold FROM folds"))
def q_stratified_folds(spark, sf_dir):
    return fo.stratified_folds(fx.labelled_ids(spark, sf_dir)).select("id", "label", "fold")


@register("kfold_split", sql(["folds"], """SELECT f.fold, 'validation' AS role, f.label, f.n FROM per f
UNION ALL SELECT f.fold, 'train' AS role, f.label, CAST(t.tot - f.n AS BIGINT) AS n FROM per f JOIN (SELECT label, sum(n) AS tot FROM per GROUP BY 1) t
  ON t.label = f.label""", [("per", "SELECT fold, label, count(*) AS n FROM folds GROUP BY 1, 2")]))
def q_kfold_split(spark, sf_dir):
    return fo.split_counts(fo.stratified_folds(fx.labelled_ids(spark, sf_dir)), "fold")


@register("loso_split", sql(["feat"], """SELECT DISTINCT id, subject_id, CAST(dense_rank() OVER (ORDER BY subject_id) AS INT) AS fold FROM feat"""))
def q_loso_split(spark, sf_dir):
    ids = fx.feat(spark, sf_dir).select("id", "subject_id").distinct()
    return fo.loso_folds(ids).select("id", "subject_id", "fold")


@register("loss_accuracy", sql(["pred"], """SELECT model, round(avg(-ln(CASE y_true WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END)), 6) AS loss,
       round(avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS n FROM pred GROUP BY 1"""))
def q_loss_accuracy(spark, sf_dir):
    return rounded(tr.loss_accuracy(fx.pred(spark, sf_dir), ["model"], ["p0", "p1", "p2"]))


@register("smoothed_log_loss", sql(["pred"], """SELECT model, round(avg(-(
       CASE WHEN y_true = 0 THEN 0.9 ELSE 0.05 END * ln(p0) + CASE WHEN y_true = 1 THEN 0.9 ELSE 0.05 END * ln(p1)
       + CASE WHEN y_true = 2 THEN 0.9 ELSE 0.05 END * ln(p2))), 6) AS smoothed_loss FROM pred GROUP BY 1"""))
def q_smoothed_log_loss(spark, sf_dir):
    return rounded(tr.smoothed_log_loss(fx.pred(spark, sf_dir), ["model"], ["p0", "p1", "p2"]))


EARLY_STOP_SQL = f"""WITH RECURSIVE history AS ({VIEWS['history']}),
h AS (SELECT run_id, epoch, val_loss, row_number() OVER (PARTITION BY run_id ORDER BY epoch) AS r FROM history),
st(run_id, r, epoch, best, cnt, stopped) AS (
  SELECT run_id, r, epoch, val_loss, 0, false FROM h WHERE r = 1
  UNION ALL
  SELECT h.run_id, h.r, h.epoch,
         CASE WHEN h.val_loss > st.best - 1e-4 THEN st.best ELSE h.val_loss END,
         CASE WHEN h.val_loss > st.best - 1e-4 THEN st.cnt + 1 ELSE 0 END,
         (CASE WHEN h.val_loss > st.best - 1e-4 THEN st.cnt + 1 ELSE 0 END) >= 15
  FROM st JOIN h ON h.run_id = st.run_id AND h.r = st.r + 1 WHERE NOT st.stopped)
SELECT run_id, coalesce(min(CASE WHEN stopped THEN epoch END), max(epoch)) AS stop_epoch, bool_or(stopped) AS stopped
FROM st GROUP BY 1"""


@register("early_stop_epoch", EARLY_STOP_SQL)
def q_early_stop_epoch(spark, sf_dir):
    return tr.early_stop_epoch(fx.history(spark, sf_dir))


@register("best_epoch", sql(["history"], """SELECT run_id, arg_min(epoch, (val_loss, epoch)) AS best_epoch, min(val_loss) AS best_val_loss
FROM history GROUP BY 1"""))
def q_best_epoch(spark, sf_dir):
    return tr.best_epoch(fx.history(spark, sf_dir))


@register("lr_schedule", sql(["history"], """SELECT run_id, epoch,
       round(0.00005 * (1 + cos(pi() * (row_number() OVER (PARTITION BY run_id ORDER BY epoch) - 1) / 100)), 12) AS lr FROM history"""))
def q_lr_schedule(spark, sf_dir):
    return rounded(tr.cosine_lr(fx.history(spark, sf_dir)), 12)


@register("job_status", sql(["job_events"], """SELECT job_id, epoch AS current_epoch, total_epochs,
       round(epoch / total_epochs * 100.0, 1) AS progress,
       CASE WHEN epoch >= total_epochs THEN 'completed' ELSE 'running' END AS status, loss
FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY epoch DESC) AS rn FROM job_events) WHERE rn = 1"""))
def q_job_status(spark, sf_dir):
    return tr.job_status(fx.job_events(spark, sf_dir))
