"""Spectral features over a long PSD table (keys..., freq, power).

The PSD is computed once per signal (``welch_psd``) and every spectral
feature is an aggregate over it, so the FFT work is never repeated.
Per-signal groups are bounded by the number of frequency bins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from neurotab import config
from neurotab.functions.kernels import welch_udf

TOTAL_FLOOR = 1e-20
RATIO_FLOOR = 1e-10


def welch_psd(df: DataFrame, keys: Sequence[str], values: str = "values", fs: float = config.SAMPLING_RATE,
              nperseg: int = config.WELCH_NPERSEG) -> DataFrame:
    """Array layout in, long PSD out: (keys..., freq, power)."""
    seg = F.least(F.lit(nperseg), F.size(values))
    psd = df.select(*keys, seg.alias("_seg"), welch_udf(float(fs), int(nperseg))(F.col(values)).alias("_psd"))
    return psd.select(*keys, "_seg", F.posexplode("_psd").alias("_k", "power")) \
        .select(*keys, (F.col("_k") * F.lit(float(fs)) / F.col("_seg")).alias("freq"), "power")


def _band_sum(lo: float, hi: float) -> F.Column:
    return F.sum(F.when(F.col("freq").between(lo, hi), F.col("power")).otherwise(F.lit(0.0)))


def band_power(psd: DataFrame, keys: Sequence[str], bands=config.BANDS) -> DataFrame:
    """Absolute (sum of bins, edges closed on both sides) and relative band power,
    long form (keys..., band, abs_power, rel_power).  One aggregation; bands
    without bins give 0."""
    aggs = [F.greatest(F.sum("power"), F.lit(TOTAL_FLOOR)).alias("total_power")]
    aggs += [_band_sum(lo, hi).alias(f"_b_{name}") for name, lo, hi in bands]
    wide = psd.groupBy(*keys).agg(*aggs)
    long = wide.unpivot([*keys, "total_power"], [f"_b_{b[0]}" for b in bands], "band", "abs_power")
    return long.select(*keys, F.regexp_replace("band", "^_b_", "").alias("band"), "abs_power",
                       (F.col("abs_power") / F.col("total_power")).alias("rel_power"))


def band_ratios(psd: DataFrame, keys: Sequence[str]) -> DataFrame:
    bands = dict((n, (lo, hi)) for n, lo, hi in config.BANDS)
    wide = psd.groupBy(*keys).agg(_band_sum(*bands["alpha"]).alias("alpha"),
                                  _band_sum(*bands["beta"]).alias("beta"),
                                  _band_sum(*bands["theta"]).alias("theta"))
    return wide.select(*keys,
                       (F.col("alpha") / F.greatest("beta", F.lit(RATIO_FLOOR))).alias("alpha_beta_ratio"),
                       (F.col("theta") / F.greatest("alpha", F.lit(RATIO_FLOOR))).alias("theta_alpha_ratio"))


def spectral_summary(psd: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Spectral entropy in bits (of psd/total over positive bins, renormalised),
    mean frequency (sum f*p / total) and normalised spectral entropy
    (entropy / log2(number of bins))."""
    pos = F.col("power") > 0
    s_pos = F.sum(F.when(pos, F.col("power")))
    s_plogp = F.sum(F.when(pos, F.col("power") * F.log2("power")))
    agg = psd.groupBy(*keys).agg(
        F.greatest(F.sum("power"), F.lit(TOTAL_FLOOR)).alias("_total"),
        F.sum("power").alias("_raw_total"),
        s_pos.alias("_spos"), s_plogp.alias("_splogp"),
        F.sum(F.col("freq") * F.col("power")).alias("_fp"), F.count(F.lit(1)).alias("_nbins"))
    entropy = F.log2("_spos") - F.col("_splogp") / F.col("_spos")
    return agg.select(
        *keys,
        entropy.alias("spectral_entropy"),
        (F.col("_fp") / F.col("_total")).alias("mean_frequency"),
        (entropy / F.log2(F.col("_nbins").cast("double"))).alias("spectral_entropy_norm"))


def median_frequency(psd: DataFrame, keys: Sequence[str]) -> DataFrame:
    """First bin whose cumulative power reaches total/2, clamped to the last bin."""
    w_cum = Window.partitionBy(*keys).orderBy("freq").rowsBetween(Window.unboundedPreceding, 0)
    w_all = Window.partitionBy(*keys)
    cum = psd.select(*keys, "freq", F.sum("power").over(w_cum).alias("_cum"),
                     F.greatest(F.sum("power").over(w_all), F.lit(TOTAL_FLOOR)).alias("_total"))
    return cum.groupBy(*keys).agg(
        F.coalesce(F.min(F.when(F.col("_cum") >= F.col("_total") / 2, F.col("freq"))), F.max("freq"))
        .alias("median_frequency"))


def alpha_power(psd: DataFrame, keys: Sequence[str]) -> DataFrame:
    lo, hi = dict((n, (l, h)) for n, l, h in config.BANDS)["alpha"]
    return psd.groupBy(*keys).agg(_band_sum(lo, hi).alias("alpha_power"))


def frontal_asymmetry(psd: DataFrame, epoch_keys: Sequence[str], channel: str = "channel",
                      pairs: DataFrame | None = None) -> DataFrame:
    """ln(alpha_right) - ln(alpha_left) per electrode pair present in the epoch,
    floors 1e-20; plus ``frontal_alpha_asymmetry`` = first pair by priority
    (F3/F4 first), 0 when no pair is present.  Long form:
    (epoch_keys..., pair, asymmetry)."""
    spark = psd.sparkSession
    if pairs is None:
        pairs = spark.createDataFrame([(l, r, i) for i, (l, r) in enumerate(config.FRONTAL_PAIRS)],
                                      "left_ch string, right_ch string, pair_ord int")
    alpha = alpha_power(psd, [*epoch_keys, channel])
    p = F.broadcast(pairs)
    left = alpha.join(p, alpha[channel] == p["left_ch"]).select(
        *epoch_keys, "left_ch", "right_ch", "pair_ord", F.col("alpha_power").alias("_al"))
    right = alpha.select(*epoch_keys, F.col(channel).alias("right_ch"), F.col("alpha_power").alias("_ar"))
    both = left.join(right, [*epoch_keys, "right_ch"])
    per_pair = both.select(
        *epoch_keys, F.concat_ws("_", F.lit("frontal_asymmetry"), "left_ch", "right_ch").alias("pair"), "pair_ord",
        (F.log(F.greatest("_ar", F.lit(TOTAL_FLOOR))) - F.log(F.greatest("_al", F.lit(TOTAL_FLOOR))))
        .alias("asymmetry"))
    # every epoch has the primary value, also one without any pair
    none = alpha.select(*epoch_keys, F.lit(None).cast("int").alias("pair_ord"), F.lit(None).cast("double").alias("asymmetry"))
    primary = per_pair.select(*epoch_keys, "pair_ord", "asymmetry").unionByName(none).groupBy(*epoch_keys).agg(
        F.coalesce(F.min_by("asymmetry", F.col("pair_ord")), F.lit(0.0)).alias("asymmetry")) \
        .select(*epoch_keys, F.lit("frontal_alpha_asymmetry").alias("pair"), "asymmetry")
    return per_pair.drop("pair_ord").unionByName(primary)


def band_power_mean(psd: DataFrame, recording_keys: Sequence[str], channel: str = "channel") -> DataFrame:
    """Inference-time band power: mean of the bins of a band per channel, then
    mean over channels, rounded to 4 decimals; a band without bins counts as 0
    for its channel.  One aggregation with conditional means, then an unpivot
    of the fixed band list."""
    names = [b for b, _, _ in config.BANDS]
    inside = [F.coalesce(F.avg(F.when((F.col("freq") >= lo) & (F.col("freq") <= hi), F.col("power"))), F.lit(0.0)).alias(b)
              for b, lo, hi in config.BANDS]
    per_ch = psd.groupBy(*recording_keys, channel).agg(*inside)
    means = per_ch.groupBy(*recording_keys).agg(*[F.round(F.avg(b), 4).alias(b) for b in names])
    return means.unpivot(list(recording_keys), names, "band", "band_power")
