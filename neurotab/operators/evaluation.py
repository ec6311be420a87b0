"""Classification metrics as aggregations over a scored table.

Input: one row per (group..., sample) with the true class, the predicted
class and per-class probabilities.  Everything is grouped by ``group`` (e.g.
model, fold) so one job scores many models.  Curves need running counts over
scores; they use the balanced ``running_sum`` so one model or class holding
most rows is still spread over many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from neurotab.operators.ordering import running_sum

CLASSES = [0, 1, 2]


def _safe_div(a: F.Column, b: F.Column) -> F.Column:
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def confusion_cells(scored: DataFrame, group: Sequence[str], y_true: str = "y_true", y_pred: str = "y_pred",
                    classes: Sequence[int] = CLASSES) -> DataFrame:
    """Every (true, pred) cell of the k x k grid, with zero counts included;
    the grid is generated per group from the class list (no join with data)."""
    counts = scored.groupBy(*group, y_true, y_pred).agg(F.count(F.lit(1)).alias("n"))
    groups = scored.select(*group).distinct()
    cls = F.array(*[F.lit(c) for c in classes])
    grid = groups.select(*group, F.explode(cls).alias(y_true)).select(*group, y_true, F.explode(cls).alias(y_pred))
    return grid.join(counts, [*group, y_true, y_pred], "left").fillna(0, subset=["n"])


def confusion_matrix(scored: DataFrame, group: Sequence[str], y_true: str = "y_true", y_pred: str = "y_pred",
                     classes: Sequence[int] = CLASSES) -> DataFrame:
    """Raw counts and row-normalised ratios (empty row divides by 1), 4 decimals."""
    cells = confusion_cells(scored, group, y_true, y_pred, classes)
    row = F.sum("n").over(Window.partitionBy(*group, y_true))
    return cells.withColumn("ratio", F.round(F.col("n") / F.when(row == 0, 1).otherwise(row), 4))


def per_class_metrics(scored: DataFrame, group: Sequence[str], y_true: str = "y_true", y_pred: str = "y_pred",
                      classes: Sequence[int] = CLASSES) -> DataFrame:
    """Precision, recall, F1 (0 when undefined), support and specificity per class."""
    cells = confusion_cells(scored, group, y_true, y_pred, classes)
    cls = cells.select(*group, F.explode(F.array(*[F.lit(c) for c in classes])).alias("class"), y_true, y_pred, "n")
    t, p, c = F.col(y_true), F.col(y_pred), F.col("class")
    agg = cls.groupBy(*group, "class").agg(
        F.sum(F.when((t == c) & (p == c), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when((t != c) & (p == c), F.col("n")).otherwise(0)).alias("fp"),
        F.sum(F.when((t == c) & (p != c), F.col("n")).otherwise(0)).alias("fn"),
        F.sum(F.when((t != c) & (p != c), F.col("n")).otherwise(0)).alias("tn"))
    prec = _safe_div(F.col("tp"), F.col("tp") + F.col("fp"))
    rec = _safe_div(F.col("tp"), F.col("tp") + F.col("fn"))
    out = agg.select(*group, "class", "tp", "fp", "fn", "tn", prec.alias("precision"), rec.alias("recall"))
    return out.select(*group, "class", "precision", "recall",
                      _safe_div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")).alias("f1"),
                      (F.col("tp") + F.col("fn")).alias("support"),
                      (F.col("tn") / F.greatest(F.col("tn") + F.col("fp"), F.lit(1))).alias("specificity"))


def overall_metrics(scored: DataFrame, group: Sequence[str], y_true: str = "y_true", y_pred: str = "y_pred",
                    classes: Sequence[int] = CLASSES) -> DataFrame:
    """Accuracy, macro F1, weighted F1, balanced accuracy (classes present in y_true),
    Cohen's kappa and multiclass MCC, rounded to 4 decimals."""
    pc = per_class_metrics(scored, group, y_true, y_pred, classes)
    f1s = pc.groupBy(*group).agg(
        F.avg("f1").alias("macro_f1"),
        _safe_div(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"),
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"))
    cells = confusion_cells(scored, group, y_true, y_pred, classes)
    marg = cells.groupBy(*group).agg(
        F.sum("n").alias("_s"), F.sum(F.when(F.col(y_true) == F.col(y_pred), F.col("n")).otherwise(0)).alias("_c"))
    rows = cells.groupBy(*group, F.col(y_true).alias("_k")).agg(F.sum("n").alias("_t"))
    cols = cells.groupBy(*group, F.col(y_pred).alias("_k")).agg(F.sum("n").alias("_p"))
    tp = rows.join(cols, [*group, "_k"]).groupBy(*group).agg(
        F.sum(F.col("_t") * F.col("_p")).alias("_tp"), F.sum(F.col("_t") * F.col("_t")).alias("_tt"),
        F.sum(F.col("_p") * F.col("_p")).alias("_pp"))
    m = marg.join(tp, list(group)).select(
        *group, F.col("_s").cast("double").alias("s"), F.col("_c").cast("double").alias("c"),
        F.col("_tp").cast("double").alias("tp"), F.col("_tt").cast("double").alias("tt"),
        F.col("_pp").cast("double").alias("pp"))
    po = F.col("c") / F.col("s")
    pe = F.col("tp") / (F.col("s") * F.col("s"))
    kappa = _safe_div(po - pe, 1 - pe)
    mcc_den = F.sqrt((F.col("s") * F.col("s") - F.col("pp")) * (F.col("s") * F.col("s") - F.col("tt")))
    mcc = _safe_div(F.col("c") * F.col("s") - F.col("tp"), mcc_den)
    out = m.select(*group, po.alias("accuracy"), kappa.alias("cohens_kappa"), mcc.alias("mcc")).join(f1s, list(group))
    return out.select(*group, *[F.round(c, 4).alias(c) for c in
                                ["accuracy", "macro_f1", "weighted_f1", "cohens_kappa", "mcc", "balanced_accuracy"]])


def one_vs_rest(scored: DataFrame, group: Sequence[str], prob_cols: Sequence[str], y_true: str = "y_true",
                id_col: str = "id") -> DataFrame:
    """Long OvR table: (group..., class, id, score, positive)."""
    arr = F.array(*[F.struct(F.lit(i).alias("class"), F.col(c).alias("score")) for i, c in enumerate(prob_cols)])
    x = scored.select(*group, id_col, y_true, F.explode(arr).alias("_e"))
    return x.select(*group, F.col("_e.class").alias("class"), id_col, F.col("_e.score").alias("score"),
                    (F.col(y_true) == F.col("_e.class")).cast("int").alias("positive"))


def _threshold_counts(ovr: DataFrame, group: Sequence[str]) -> DataFrame:
    """One row per distinct score per (group, class): positives/negatives at that
    score and cumulative counts at score >= this one."""
    g = [*group, "class"]
    per = ovr.groupBy(*g, "score").agg(F.sum("positive").alias("pos"),
                                       F.sum(1 - F.col("positive")).alias("neg")).withColumn("one", F.lit(1))
    cum = running_sum(per, g, [F.col("score").desc()], ["pos", "neg", "one"])
    tot = per.groupBy(*g).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.sum("one").alias("n_thresholds"))
    return cum.withColumnRenamed("one_cum", "place").drop("one").join(tot, g)


def roc_auc(ovr: DataFrame, group: Sequence[str]) -> DataFrame:
    """Per-class one-vs-rest AUC (classes with positives) as the trapezoid area
    of the ROC through every distinct threshold; rows with class = -1 hold the
    macro mean.  A class without negatives has no AUC (null).  Rounded to 4 decimals."""
    g = [*group, "class"]
    tc = _threshold_counts(ovr, group)
    # trapezoid between consecutive thresholds: (fp - fp_prev) * (tp + tp_prev) / 2; the counts
    # before a threshold are its cumulative counts less its own, so no neighbour row is needed
    seg = tc.select(*g, "n_pos", "n_neg", (F.col("neg") * (2 * F.col("pos_cum") - F.col("pos")) / 2.0).alias("_area"))
    auc = seg.where(F.col("n_pos") > 0).groupBy(*g).agg(
        F.try_divide(F.sum("_area"), F.first("n_pos") * F.first("n_neg")).alias("roc_auc"))
    macro = auc.groupBy(*group).agg(F.lit(-1).alias("class"), F.avg("roc_auc").alias("roc_auc"))
    return auc.unionByName(macro).withColumn("roc_auc", F.round("roc_auc", 4))


def average_precision(ovr: DataFrame, group: Sequence[str]) -> DataFrame:
    """Sum over distinct thresholds (descending) of (R_t - R_prev) * P_t; 4 decimals."""
    g = [*group, "class"]
    tc = _threshold_counts(ovr, group).where(F.col("n_pos") > 0)
    prec = F.col("pos_cum") / (F.col("pos_cum") + F.col("neg_cum"))
    ap = tc.select(*g, (F.col("pos") / F.col("n_pos") * prec).alias("_t"))
    return ap.groupBy(*g).agg(F.round(F.sum("_t"), 4).alias("average_precision"))


def roc_points(ovr: DataFrame, group: Sequence[str], drop_intermediate: bool = True) -> DataFrame:
    """ROC curve per (group, class): (0,0) then one point per distinct threshold
    (descending); collinear interior points dropped.  Output columns:
    group..., class, point (0-based), fpr, tpr (unrounded)."""
    g = [*group, "class"]
    tc = _threshold_counts(ovr, group).where(F.col("n_pos") > 0)
    if drop_intermediate:
        # a point lies on the line through its neighbours when the next threshold adds the same counts
        following = tc.select(*g, (F.col("place") - 1).alias("place"), F.col("pos").alias("_pos"), F.col("neg").alias("_neg"))
        bend = (F.col("_pos") != F.col("pos")) | (F.col("_neg") != F.col("neg"))
        ends = (F.col("place") == 1) | F.col("_pos").isNull() | (F.col("n_thresholds") <= 2)
        tc = tc.join(following, [*g, "place"], "left").where(ends | bend)
    pts = tc.select(*g, "n_pos", "n_neg", F.col("neg_cum").alias("fps"), F.col("pos_cum").alias("tps"), "place", F.lit(1).alias("one"))
    numbered = running_sum(pts, g, ["place"], ["one"]).select(*g, "n_pos", "n_neg", "fps", "tps", F.col("one_cum").alias("point"))
    origin = numbered.where(F.col("point") == 1).select(*g, "n_pos", "n_neg", F.lit(0).alias("fps"), F.lit(0).alias("tps"), F.lit(0).alias("point"))
    return numbered.unionByName(origin).select(
        *g, F.col("point").cast("int").alias("point"), F.try_divide(F.col("fps"), F.col("n_neg")).alias("fpr"),
        (F.col("tps") / F.col("n_pos")).alias("tpr"))


def roc_subsample(points: DataFrame, group: Sequence[str], max_points: int = 50) -> DataFrame:
    """Keep at most ``max_points`` points: indices floor(i*(L-1)/(m-1)), m = min(max, L),
    fpr/tpr rounded to 4 decimals.  Output: group..., class, i, fpr, tpr."""
    g = [*group, "class"]
    # the index grid, generated per curve from its length (bounded by max_points)
    heads = points.groupBy(*g).agg(F.count(F.lit(1)).alias("_L")).withColumn("_m", F.least(F.lit(max_points), F.col("_L")))
    grid = heads.select(*g, "_L", "_m", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_m") - 1)).alias("i"))
    grid = grid.withColumn("point", F.when(F.col("_m") > 1,
                                           F.floor(F.col("i") * (F.col("_L") - 1) / (F.col("_m") - 1)))
                           .otherwise(F.lit(0)).cast("long"))
    pts = points.withColumn("point", F.col("point").cast("long"))
    return grid.join(pts, [*g, "point"]).select(*g, F.col("i").cast("int").alias("i"),
                                                 F.round("fpr", 4).alias("fpr"), F.round("tpr", 4).alias("tpr"))


def nearest_merge(curves: DataFrame, curve_keys: Sequence[str], x: str = "fpr", y: str = "tpr",
                  order: str = "i") -> DataFrame:
    """For every distinct x over all curves, each curve's y at its nearest x
    (lowest index on ties; the lower x on equal distance).  The result has a row
    for each curve and grid value; those rows are made from the list of curves
    (one entry a curve) and sorted in among the curve's own points, so the points
    before and after each are found in one window of a curve (curves are
    subsampled to a bounded number of points)."""
    keys = list(curve_keys)
    first = curves.groupBy(*keys, x).agg(F.min_by(y, order).alias("_y"))
    names = curves.agg(F.sort_array(F.collect_set(F.struct(*keys)))).scalar()
    grid = curves.select(F.col(x).alias("_g")).distinct().select("_g", F.explode(names).alias("_k")).select(*[f"_k.{c}" for c in keys], "_g")
    point = F.struct(F.col(x).alias("x"), F.col("_y").alias("y"))
    rows = first.select(*keys, F.col(x).alias("_g"), point.alias("_p")).unionByName(grid.withColumn("_p", F.lit(None).cast("struct<x:double,y:double>")))
    w = Window.partitionBy(*keys).orderBy("_g", F.col("_p").isNull())
    near = rows.select(*keys, "_g", "_p", F.last("_p", True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_lo"),
                       F.first("_p", True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("_hi")).where(F.col("_p").isNull())
    lower = F.col("_hi").isNull() | ((F.col("_g") - F.col("_lo.x")) <= (F.col("_hi.x") - F.col("_g")))
    pick = F.when(F.col("_lo").isNull(), F.col("_hi.y")).when(lower, F.col("_lo.y")).otherwise(F.col("_hi.y"))
    return near.select(F.col("_g").alias(x), *keys, pick.alias(y))


def mcnemar(scored: DataFrame, models: Sequence, model: str = "model", id_col: str = "id",
            y_true: str = "y_true", y_pred: str = "y_pred", digits: int | None = 4) -> DataFrame:
    """For every pair of listed models: b = first right & second wrong,
    c = the reverse, statistic = (|b-c|-1)^2/(b+c) (continuity-corrected).
    One pivot by sample id and one aggregation; no pairwise join of rows."""
    ok = scored.select(id_col, model, (F.col(y_true) == F.col(y_pred)).alias("_ok"))
    wide = ok.groupBy(id_col).pivot(model, list(models)).agg(F.first("_ok"))
    aggs = []
    pairs = [(a, b) for i, a in enumerate(models) for b in models[i + 1:]]
    for a, b in pairs:
        ca, cb = F.col(f"`{a}`"), F.col(f"`{b}`")
        aggs += [F.count_if(ca & ~cb).alias(f"b_{a}_{b}"), F.count_if(~ca & cb).alias(f"c_{a}_{b}")]
    counts = wide.agg(*aggs)
    rows = F.explode(F.array(*[F.struct(F.lit(a).alias("model_a"), F.lit(b).alias("model_b"),
                                        F.col(f"b_{a}_{b}").alias("b"), F.col(f"c_{a}_{b}").alias("c"))
                               for a, b in pairs]))
    out = counts.select(rows.alias("_r")).select("_r.*")
    stat = F.when(F.col("b") + F.col("c") > 0,
                  F.pow(F.abs(F.col("b") - F.col("c")) - 1, 2) / (F.col("b") + F.col("c"))).otherwise(F.lit(0.0))
    return out.withColumn("statistic", F.round(stat, 4) if digits is not None else stat)


def chi2_sf_udf():
    """Upper tail of the chi-square distribution (applied to small result tables)."""
    from neurotab.functions.kernels import chi2_sf_udf as make
    return make()


def friedman(acc: DataFrame, block: str = "fold", treatment: str = "model", value: str = "accuracy") -> DataFrame:
    """Friedman chi-square across treatments over blocks, tie-corrected, with its
    p-value (k - 1 degrees of freedom); with fewer than 3 treatments the result is (0, 1).  Average ranks within a block:
    rank() + (ties - 1)/2."""
    w_rank = Window.partitionBy(block).orderBy(value)
    w_tie = Window.partitionBy(block, value)
    r = acc.select(block, treatment, value,
                   (F.rank().over(w_rank) + (F.count(F.lit(1)).over(w_tie) - 1) / 2.0).alias("_rank"),
                   F.count(F.lit(1)).over(w_tie).alias("_t"))
    ties = r.groupBy(block, value).agg(F.first("_t").alias("_t")) \
        .select(F.lit(None).cast("string").alias("_tr"), F.lit(None).cast("string").alias("_bl"),
                F.lit(0.0).alias("_r2"), (F.pow(F.col("_t"), 3) - F.col("_t")).alias("_tt"))
    sums = r.groupBy(treatment).agg(F.sum("_rank").alias("_R")) \
        .select(F.col(treatment).cast("string").alias("_tr"), F.lit(None).cast("string").alias("_bl"),
                (F.col("_R") * F.col("_R")).alias("_r2"), F.lit(0.0).alias("_tt"))
    blocks = acc.select(F.lit(None).cast("string").alias("_tr"), F.col(block).cast("string").alias("_bl"),
                        F.lit(0.0).alias("_r2"), F.lit(0.0).alias("_tt"))
    # one aggregation over the three tagged pieces gives k, n, sum R^2 and the tie term
    t = ties.unionByName(sums).unionByName(blocks).agg(
        F.countDistinct("_tr").alias("k"), F.countDistinct("_bl").alias("n"),
        F.sum("_r2").alias("_ss"), F.sum("_tt").alias("_ties"))
    k, n = F.col("k").cast("double"), F.col("n").cast("double")
    c = 1 - F.col("_ties") / (n * (k * k * k - k))
    chisq = (12.0 / (n * k * (k + 1)) * F.col("_ss") - 3 * n * (k + 1)) / c
    return t.select(F.col("k").cast("int").alias("n_treatments"), F.col("n").cast("int").alias("n_blocks"),
                    F.round(F.when(F.col("k") >= 3, chisq).otherwise(F.lit(0.0)), 4).alias("statistic"),
                    F.round(F.when(F.col("k") >= 3, chi2_sf_udf()(chisq, F.col("k").cast("int") - 1)).otherwise(F.lit(1.0)), 6).alias("p_value"))


def cv_summary(per_fold: DataFrame, group: Sequence[str], value: str, fold: str = "fold") -> DataFrame:
    """Mean, population std, min, max and the list of values across folds (in
    fold order), 4 decimals (missing -> 0)."""
    v = F.coalesce(F.col(value), F.lit(0.0))
    return per_fold.groupBy(*group).agg(
        F.round(F.avg(v), 4).alias("mean"), F.round(F.stddev_pop(v), 4).alias("std"),
        F.round(F.min(v), 4).alias("min"), F.round(F.max(v), 4).alias("max"), F.count(F.lit(1)).alias("n_folds"),
        F.transform(F.array_sort(F.collect_list(F.struct(F.col(fold), v.alias("v")))), lambda x: F.round(x["v"], 4)).alias("values"))


def evaluation_report(scored: DataFrame, group: Sequence[str], prob_cols: Sequence[str], y_true: str = "y_true",
                      y_pred: str = "y_pred", id_col: str = "id", classes: Sequence[int] = CLASSES) -> DataFrame:
    """Every metric of one scored table in one long table
    (group..., section, class, metric, value): per-class precision / recall /
    F1 / support / specificity, overall scalars, confusion cells (raw and
    normalised, metric ``cm_{true}_{pred}`` / ``cmn_{true}_{pred}``), per-class
    and macro ROC-AUC and average precision.  Class -1 marks overall rows."""
    g = list(group)
    pc = per_class_metrics(scored, g, y_true, y_pred, classes)
    pc_long = pc.unpivot([*g, "class"], ["precision", "recall", "f1", "support", "specificity"], "metric", "value") \
        .select(*g, F.lit("per_class").alias("section"), "class", "metric", F.col("value").cast("double"))
    ov = overall_metrics(scored, g, y_true, y_pred, classes)
    ov_long = ov.unpivot(g, ["accuracy", "macro_f1", "weighted_f1", "cohens_kappa", "mcc", "balanced_accuracy"],
                         "metric", "value") \
        .select(*g, F.lit("overall").alias("section"), F.lit(-1).alias("class"), "metric", "value")
    cm = confusion_matrix(scored, g, y_true, y_pred, classes)
    cell = F.concat_ws("_", F.col(y_true).cast("string"), F.col(y_pred).cast("string"))
    cm_long = cm.select(*g, F.lit("confusion").alias("section"), F.col(y_true).alias("class"),
                        F.concat(F.lit("cm_"), cell).alias("metric"), F.col("n").cast("double").alias("value")) \
        .unionByName(cm.select(*g, F.lit("confusion").alias("section"), F.col(y_true).alias("class"),
                               F.concat(F.lit("cmn_"), cell).alias("metric"), F.col("ratio").alias("value")))
    ovr = one_vs_rest(scored, g, prob_cols, y_true, id_col)
    auc = roc_auc(ovr, g).select(*g, F.lit("roc_auc").alias("section"), "class", F.lit("roc_auc").alias("metric"),
                                 F.col("roc_auc").alias("value"))
    ap = average_precision(ovr, g).select(*g, F.lit("average_precision").alias("section"), "class",
                                          F.lit("average_precision").alias("metric"),
                                          F.col("average_precision").alias("value"))
    return pc_long.unionByName(ov_long).unionByName(cm_long).unionByName(auc).unionByName(ap)
