"""Feature attributions and their summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from neurotab import config


def linear_attribution(long: DataFrame, weights: DataFrame, background: DataFrame | None = None,
                       id_col: str = "id", feature: str = "feature", value: str = "value", klass: str = "class",
                       weight: str = "weight") -> DataFrame:
    """Exact attribution of a linear score: w[class, f] * (x[f] - mean x[f]),
    the mean taken over the background rows (default: the explained rows).
    ``weights`` has one row per (class, feature).  Output: (id, class, feature, attribution)."""
    mean = (background if background is not None else long).groupBy(feature).agg(F.avg(value).alias("_mu"))
    x = long.join(mean, feature)
    return x.join(weights, feature).select(id_col, klass, feature,
                                           (F.col(weight) * (F.col(value) - F.col("_mu"))).alias("attribution"))


def attribution_summary(attr: DataFrame, feature: str = "feature", klass: str = "class",
                        value: str = "attribution") -> DataFrame:
    """Per feature: mean |attribution| (per class over rows, then over classes);
    direction = sign of the mean attribution of the class whose mean has the
    largest magnitude ('positive' iff > 0)."""
    per_class = attr.groupBy(feature, klass).agg(F.avg(F.abs(value)).alias("_ma"), F.avg(value).alias("_m"))
    out = per_class.groupBy(feature).agg(
        F.avg("_ma").alias("mean_abs"),
        F.max_by("_m", F.struct(F.abs("_m"), -F.col(klass))).alias("_dir"))
    return out.select(feature, "mean_abs",
                      F.when(F.col("_dir") > 0, "positive").otherwise("negative").alias("direction"))


def top_features(summary: DataFrame, k: int = config.TOP_ATTRIBUTIONS, feature: str = "feature",
                 score: str = "mean_abs", position: str | None = None) -> DataFrame:
    """The k largest by score (ties: later feature first), rank 1..k.
    A top-k report: one row per feature is ranked globally."""
    w = Window.orderBy(F.col(score).desc(), F.col(position or feature).desc())
    return summary.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def channel_of(name: F.Column, channels: Sequence[str] = config.CHANNELS) -> F.Column:
    """First channel of the fixed ordered list contained in the name, else 'N/A'."""
    expr = F.lit("N/A")
    for ch in reversed(channels):
        expr = F.when(name.contains(ch), F.lit(ch)).otherwise(expr)
    return expr


def band_of(name: F.Column, bands: Sequence[str] = tuple(b[0] for b in config.BANDS)) -> F.Column:
    """First band contained in the lower-cased name, capitalised; names with
    'dwt' take their last '_' token (or 'DWT'); else 'N/A'."""
    low = F.lower(name)
    expr = F.lit("N/A")
    for b in reversed(bands):
        expr = F.when(low.contains(b), F.lit(b.capitalize())).otherwise(expr)
    dwt = F.when(name.contains("_"), F.element_at(F.split(name, "_"), -1)).otherwise(F.lit("DWT"))
    return F.when(low.contains("dwt"), dwt).otherwise(expr)


def permutation_importance(scorer, data: DataFrame, feature_names: Sequence[str], id_col: str = "id", label: str = "label",
                           vec: str = "features", seed: int = config.SEED) -> DataFrame:
    """Drop of the accuracy when one feature is permuted across rows.

    A row's donor is the row before it in md5 order (cyclic): one join brings the
    donor's features to each row.  All permuted variants, and the row as it is,
    go through the scorer in one pass; what is right is known to each variant
    itself, so counting by feature is the only aggregation, and the number of
    jobs does not grow with the features.  Returns (feature, importance)."""
    from neurotab.operators.ordering import sequence_index

    n = data.count()
    order = F.md5(F.concat_ws("-", F.lit(seed), F.col(id_col).cast("string")))
    ranked = sequence_index(data.select(id_col, label, vec, F.lit(0).alias("_all"), order.alias("_h")), ["_all"], ["_h", id_col], name="_r")
    donors = ranked.select(((F.col("_r") + 1) % n).alias("_r"), F.col(vec).alias("_d"))
    variants = ranked.join(donors, "_r").select(id_col, label, vec, "_d", F.explode(F.sequence(F.lit(-1), F.lit(len(feature_names) - 1))).alias("_j"))
    taken = F.transform(F.col(vec), lambda x, i: F.when(i == F.col("_j"), F.get("_d", i)).otherwise(x))
    scored = scorer.score(variants.select(F.struct(F.col(id_col).alias("id"), F.col(label).alias("label"), F.col("_j").alias("j")).alias("id"), taken.alias("features")))
    right = scored.groupBy("id.j").agg(F.avg((F.col("prediction") == F.col("id.label")).cast("double")).alias("a"))
    names = F.array(*[F.lit(f) for f in feature_names])
    whole = right.where("j = -1").select("a").scalar()
    return right.where("j >= 0").select(F.get(names, F.col("j")).alias("feature"), (whole - F.col("a")).alias("importance"))
