"""From raw signals, or from named features, to prediction records.

The chain of one recording: cleaning (filters, average reference, baseline,
z-score, epochs), every feature of each epoch, the stored model, and beside its
probabilities what a reader wants to see: the features that moved the score
most, band powers, alpha/beta ratio and frontal asymmetry.  The model carries
the names of its inputs and their training means, so a scorer that is loaded in
another process (a stream, say) needs nothing else.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Sequence

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from neurotab import config
from neurotab.learn.models import Scorer, scorer_of
from neurotab.operators import spectral as sp
from neurotab.operators.assemble import assemble, manual_vector
from neurotab.operators.blockfilter import BLOCK
from neurotab.operators.features import epoch_features
from neurotab.operators.preprocess import clean, to_arrays
from neurotab.session import cut_lineage

TOP = 5


def clean_epochs(long: DataFrame, rec_key: str, epoch_size: int = config.EPOCH_SAMPLES, baseline: int = config.BASELINE_SAMPLES,
                 sr_in: float = config.SAMPLING_RATE, block: int = BLOCK) -> DataFrame:
    """(rec_key, epoch_id, channel, sample_idx, value): cleaned epochs, written once."""
    out = clean(long, [rec_key], sr_in=sr_in, baseline=baseline, epoch_size=epoch_size, block=block)
    return cut_lineage(out.select(rec_key, "epoch_id", "channel", F.col("pos").alias("sample_idx"), "value"))


def feature_vectors(feats: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """(id struct of the keys, features array<double>) in the given name order."""
    wide = assemble(feats, keys, names)
    return wide.select(F.struct(*keys).alias("id"), vector_to_array("features").alias("features"))


def with_inputs(scorer: Scorer, train: DataFrame, names: Sequence[str]) -> Scorer:
    """The scorer with the names of its features and their means in the training rows."""
    means = train.select(F.posexplode("features").alias("j", "x")).groupBy("j").agg(F.avg("x").alias("m")).orderBy("j").collect()
    params = scorer.params | {"names": list(names), "means": [float(r["m"]) for r in means]}
    return dataclasses.replace(scorer_of(scorer.kind, scorer.name, params, scorer.stage, scorer.members))


def linear_weights(scorer: Scorer) -> list[list[float]] | None:
    """Weights by label of a scorer whose scores are linear in its features."""
    if scorer.kind == "discriminant":
        by_class = dict(zip(scorer.params["classes"], scorer.params["coef"], strict=True))
        return [by_class.get(c, [0.0] * len(scorer.params["names"])) for c in range(max(scorer.params["k"], max(by_class) + 1))]
    if scorer.kind == "probability" and hasattr(scorer.stage, "coefficientMatrix"):
        _, scale = scorer.params["scaler"]
        return [[w / s for w, s in zip(row, scale, strict=True)] for row in scorer.stage.coefficientMatrix.toArray().tolist()]
    return None


def top_features(scorer: Scorer, features: Column, prediction: Column, k: int = TOP) -> Column:
    """The k features that moved the predicted class's score furthest from its
    value at the training means: weight x (value - mean), largest first (ties by
    name), as array<struct<feature, attribution>>; null for other models."""
    kind = "array<struct<feature:string,attribution:double>>"
    weights = linear_weights(scorer)
    if weights is None:
        return F.lit(None).cast(kind)
    numbers = lambda v: F.array(*[F.lit(float(x)) for x in v])
    names, own = F.array(*[F.lit(n) for n in scorer.params["names"]]), F.get(F.array(*[numbers(w) for w in weights]), prediction)
    moved = F.zip_with(F.zip_with(features, numbers(scorer.params["means"]), lambda x, m: x - m), own, lambda d, w: d * w)
    ranked = F.sort_array(F.zip_with(moved, names, lambda a, n: F.struct((-F.abs(a)).alias("r"), n.alias("feature"), a.alias("attribution"))))
    return F.transform(F.slice(ranked, 1, k), lambda s: F.struct(s["feature"].alias("feature"), s["attribution"].alias("attribution"))).cast(kind)


def scored_records(vectors: DataFrame, scorer: Scorer, k: int = TOP) -> DataFrame:
    """(id, level, confidence, p_low, p_moderate, p_high, top_features, model_used)."""
    levels = F.array(*[F.lit(n) for _, n in config.LEVELS])
    scored = vectors.join(scorer.score(vectors), "id")
    return scored.select(
        "id", F.get(levels, F.col("prediction")).alias("level"), F.greatest("p0", "p1", "p2").alias("confidence"),
        F.col("p0").alias("p_low"), F.col("p1").alias("p_moderate"), F.col("p2").alias("p_high"),
        top_features(scorer, F.col("features"), F.col("prediction"), k).alias("top_features"), F.col("model").alias("model_used"))


def prediction_records(epochs: DataFrame, keys: Sequence[str], scorer: Scorer, fs: float = config.SAMPLING_RATE,
                       feats: DataFrame | None = None, k: int = TOP) -> DataFrame:
    """One record per epoch (``keys``) of cleaned epochs: ``scored_records``, band
    powers (mean of bins, mean over channels), the alpha/beta ratio of those and
    the primary frontal asymmetry.  ``feats`` are the epochs' features, if they
    are there already."""
    keys = list(keys)
    feats = epoch_features(epochs, keys, "channel", fs=fs) if feats is None else feats
    record = scored_records(feature_vectors(feats, keys, scorer.params["names"]), scorer, k)
    psd = cut_lineage(sp.welch_psd(to_arrays(epochs, [*keys, "channel"]), [*keys, "channel"], "values", fs=fs))
    bands = [b[0] for b in config.BANDS]
    powers = sp.band_power_mean(psd, keys).groupBy(*keys).pivot("band", bands).agg(F.first("band_power"))
    asymmetry = sp.frontal_asymmetry(psd, keys).where(F.col("pair") == "frontal_alpha_asymmetry") \
        .select(*keys, F.col("asymmetry").alias("frontal_asymmetry"))
    out = record.select(*[F.col(f"id.{c}").alias(c) for c in keys], *[c for c in record.columns if c != "id"]) \
        .join(powers, keys, "left").join(asymmetry, keys, "left")
    return out.select(
        *keys, "level", "confidence", "p_low", "p_moderate", "p_high", "top_features", *bands,
        (F.col("alpha") / F.greatest(F.col("beta"), F.lit(1e-10))).alias("alpha_beta_ratio"),
        F.coalesce("frontal_asymmetry", F.lit(0.0)).alias("frontal_asymmetry"), "model_used")


def predict_signals(long: DataFrame, rec_key: str, scorer: Scorer, fs: float = config.SAMPLING_RATE, **cleaning) -> DataFrame:
    """Raw signals (rec_key, channel, sample_idx, value) to one record per epoch."""
    return prediction_records(clean_epochs(long, rec_key, **cleaning), [rec_key, "epoch_id"], scorer, fs)


def predict_manual(requests: DataFrame, scorer: Scorer, key: str = "request_id", features: str = "features", k: int = TOP) -> DataFrame:
    """Records of feature maps typed in by hand; names that a map lacks count 0."""
    vectors = manual_vector(requests, scorer.params["names"], features).select(F.col(key).alias("id"), F.col("vector").alias("features"))
    return scored_records(vectors, scorer, k).withColumnRenamed("id", key)
