"""Feature selection and scaling on the long feature table
(row id, label, feature, value).

Fitting reduces the data to one row per feature (or feature x class), so
the fitted state is O(features); applying it is a semi-join / join with that
small table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from neurotab import config


def feature_variance(long: DataFrame, feature: str = "feature", value: str = "value") -> DataFrame:
    return long.groupBy(feature).agg(F.var_pop(value).alias("variance"))


def variance_threshold(long: DataFrame, threshold: float = config.VARIANCE_THRESHOLD, feature: str = "feature",
                       value: str = "value") -> DataFrame:
    """(feature, variance, keep): keep when the population variance > threshold."""
    return feature_variance(long, feature, value).withColumn("keep", F.col("variance") > threshold)


def anova_f(long: DataFrame, label: str = "label", feature: str = "feature", value: str = "value") -> DataFrame:
    """One-way ANOVA F per feature: (SSB/(k-1)) / (SSW/(n-k)); null with one class."""
    per = long.groupBy(feature, label).agg(F.count(F.lit(1)).alias("_n"), F.avg(value).alias("_m"),
                                           F.var_pop(value).alias("_v"))
    w = Window.partitionBy(feature)
    tot_n = F.sum("_n").over(w)
    grand = F.sum(F.col("_n") * F.col("_m")).over(w) / tot_n
    per = per.select(feature, "_n", "_m", "_v", grand.alias("_g"), tot_n.alias("_ntot"),
                     F.count(F.lit(1)).over(w).alias("_k"))
    agg = per.groupBy(feature).agg(
        F.sum(F.col("_n") * F.pow(F.col("_m") - F.col("_g"), 2)).alias("_ssb"),
        F.sum(F.col("_n") * F.col("_v")).alias("_ssw"), F.first("_ntot").alias("_ntot"), F.first("_k").alias("_k"))
    msb = F.try_divide(F.col("_ssb"), F.col("_k") - 1)
    msw = F.try_divide(F.col("_ssw"), F.col("_ntot") - F.col("_k"))
    return agg.select(feature, F.try_divide(msb, msw).alias("f_score"))


def select_k_best(scores: DataFrame, k: int = config.SELECT_K, feature: str = "feature",
                  score: str = "f_score", position: str | None = None) -> DataFrame:
    """The k features with the highest score; NaN/null scores rank last and on
    equal scores the later feature (by position) wins.  Input has one row per
    feature, so the global ordering runs over O(features) rows."""
    pos = F.col(position or feature)
    bad = F.col(score).isNull() | F.isnan(score)
    w = Window.orderBy(bad.asc(), F.col(score).desc(), pos.desc())
    k_eff = F.least(F.lit(k), F.count(F.lit(1)).over(Window.partitionBy()))
    ranked = scores.withColumn("rank", F.row_number().over(w))
    return ranked.withColumn("keep", F.col("rank") <= k_eff)


def apply_selection(long: DataFrame, selected: DataFrame, feature: str = "feature") -> DataFrame:
    """Keep only selected features (left semi join with the small selection table)."""
    return long.join(selected.where("keep").select(feature), feature, "left_semi")


def fit_selector(long: DataFrame, threshold: float = config.VARIANCE_THRESHOLD, k: int = config.SELECT_K,
                 label: str = "label", feature: str = "feature", value: str = "value") -> DataFrame:
    """Variance threshold, then k best by ANOVA F among the survivors.
    Returns the fitted table (feature, variance, f_score, rank, keep)."""
    var = variance_threshold(long, threshold, feature, value)
    survivors = apply_selection(long, var, feature)
    f = anova_f(survivors, label, feature, value)
    best = select_k_best(f, k, feature)
    return var.join(best.select(feature, "f_score", "rank", F.col("keep").alias("_kb")), feature, "left") \
        .select(feature, "variance", "f_score", "rank", (F.col("keep") & F.coalesce("_kb", F.lit(False))).alias("keep"))


def standard_scale_fit(long: DataFrame, feature: str = "feature", value: str = "value") -> DataFrame:
    """Mean and population std per feature; a constant feature scales by 1."""
    return long.groupBy(feature).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("_sd")) \
        .select(feature, "mean", F.when(F.col("_sd") == 0, 1.0).otherwise(F.col("_sd")).alias("scale"))


def standard_scale_apply(long: DataFrame, fitted: DataFrame, feature: str = "feature",
                         value: str = "value") -> DataFrame:
    return long.join(fitted, feature).withColumn(value, (F.col(value) - F.col("mean")) / F.col("scale")) \
        .drop("mean", "scale")
