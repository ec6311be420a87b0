"""Spectral queries on epochs64 (64 samples at 128 Hz, F3/F4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from neurotab import fixtures as fx
from neurotab.operators import spectral as sp
from neurotab.plans.common import rounded
from neurotab.plans.oracle_views import sql
from neurotab.plans.registry import register

K = ["epoch_id", "channel"]


def psd64(spark, sf_dir):
    return sp.welch_psd(fx.epochs64_arrays(spark, sf_dir), K, "values", fs=128, nperseg=256)


@register("welch_psd", sql(["psd64"], "SELECT epoch_id, channel, freq, round(power, 9) AS power FROM psd64"))
def q_welch_psd(spark, sf_dir):
    return rounded(psd64(spark, sf_dir), 9)


BAND_SQL = """SELECT epoch_id, channel, band, round(abs_power, 9) AS abs_power, round(abs_power / total_power, 9) AS rel_power
FROM (SELECT p.epoch_id, p.channel, b.band,
             sum(CASE WHEN p.freq BETWEEN b.low AND b.high THEN p.power ELSE 0.0 END) AS abs_power,
             greatest(sum(p.power), 1e-20) AS total_power
      FROM psd64 p CROSS JOIN bands b GROUP BY 1, 2, 3)"""


@register("band_power", sql(["psd64", "bands"], BAND_SQL))
def q_band_power(spark, sf_dir):
    out = sp.band_power(psd64(spark, sf_dir), K)
    return rounded(out.select(*K, "band", "abs_power", "rel_power"), 9)


RATIO_SQL = """SELECT epoch_id, channel,
       round(alpha / greatest(beta, 1e-10), 6) AS alpha_beta_ratio,
       round(theta / greatest(alpha, 1e-10), 6) AS theta_alpha_ratio
FROM (SELECT epoch_id, channel,
             sum(CASE WHEN freq BETWEEN 8 AND 13 THEN power ELSE 0 END) AS alpha,
             sum(CASE WHEN freq BETWEEN 13 AND 30 THEN power ELSE 0 END) AS beta,
             sum(CASE WHEN freq BETWEEN 4 AND 8 THEN power ELSE 0 END) AS theta
      FROM psd64 GROUP BY 1, 2)"""


@register("band_ratios", sql(["psd64"], RATIO_SQL))
def q_band_ratios(spark, sf_dir):
    return rounded(sp.band_ratios(psd64(spark, sf_dir), K))


ENTROPY_SQL = """SELECT p.epoch_id, p.channel, round(-sum((p.power / t.spos) * log2(p.power / t.spos)), 6) AS spectral_entropy
FROM psd64 p JOIN (SELECT epoch_id, channel, sum(power) AS spos FROM psd64 WHERE power > 0 GROUP BY 1, 2) t
  ON p.epoch_id = t.epoch_id AND p.channel = t.channel
WHERE p.power > 0 GROUP BY 1, 2"""


@register("spectral_entropy", sql(["psd64"], ENTROPY_SQL))
def q_spectral_entropy(spark, sf_dir):
    return rounded(sp.spectral_summary(psd64(spark, sf_dir), K).select(*K, "spectral_entropy"))


ENTROPY_NORM_SQL = """SELECT p.epoch_id, p.channel,
       round(-sum((p.power / t.spos) * log2(p.power / t.spos)) / log2(max(t.nb)), 6) AS spectral_entropy_norm
FROM psd64 p JOIN (SELECT epoch_id, channel, sum(power) AS spos, CAST(count(*) AS DOUBLE) AS nb
                   FROM psd64 GROUP BY 1, 2) t
  ON p.epoch_id = t.epoch_id AND p.channel = t.channel
WHERE p.power > 0 GROUP BY 1, 2"""


@register("spectral_entropy_norm", sql(["psd64"], ENTROPY_NORM_SQL))
def q_spectral_entropy_norm(spark, sf_dir):
    return rounded(sp.spectral_summary(psd64(spark, sf_dir), K).select(*K, "spectral_entropy_norm"))


CENTROID_SQL = """SELECT epoch_id, channel, round(sum(freq * power) / greatest(sum(power), 1e-20), 6) AS mean_frequency
FROM psd64 GROUP BY 1, 2"""


@register("spectral_centroid", sql(["psd64"], CENTROID_SQL))
def q_spectral_centroid(spark, sf_dir):
    return rounded(sp.spectral_summary(psd64(spark, sf_dir), K).select(*K, "mean_frequency"))


MEDIAN_SQL = """SELECT epoch_id, channel,
       coalesce(min(CASE WHEN cum >= total / 2 THEN freq END), max(freq)) AS median_frequency
FROM (SELECT epoch_id, channel, freq,
             sum(power) OVER (PARTITION BY epoch_id, channel ORDER BY freq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum,
             greatest(sum(power) OVER (PARTITION BY epoch_id, channel), 1e-20) AS total
      FROM psd64) GROUP BY 1, 2"""


@register("median_frequency", sql(["psd64"], MEDIAN_SQL))
def q_median_frequency(spark, sf_dir):
    return sp.median_frequency(psd64(spark, sf_dir), K)


FAA_SQL = """, alpha AS (SELECT epoch_id, channel, sum(CASE WHEN freq BETWEEN 8 AND 13 THEN power ELSE 0 END) AS a
               FROM psd64 GROUP BY 1, 2),
pp AS (SELECT l.epoch_id, 'frontal_asymmetry_' || fp.left_ch || '_' || fp.right_ch AS pair, fp.pair_ord,
              ln(greatest(r.a, 1e-20)) - ln(greatest(l.a, 1e-20)) AS asymmetry
       FROM alpha l JOIN frontal_pairs fp ON l.channel = fp.left_ch
       JOIN alpha r ON r.epoch_id = l.epoch_id AND r.channel = fp.right_ch)
SELECT epoch_id, pair, round(asymmetry, 6) AS asymmetry FROM pp
UNION ALL
SELECT epoch_id, 'frontal_alpha_asymmetry' AS pair, round(arg_min(asymmetry, pair_ord), 6) AS asymmetry FROM pp GROUP BY 1"""


def _faa_sql():
    s = sql(["psd64", "frontal_pairs"], "")
    return s.rstrip("\n") + FAA_SQL


@register("frontal_asymmetry", _faa_sql())
def q_frontal_asymmetry(spark, sf_dir):
    return rounded(sp.frontal_asymmetry(psd64(spark, sf_dir), ["epoch_id"], "channel"))


BPM_SQL = """SELECT epoch_id, band, round(avg(m), 4) AS band_power
FROM (SELECT p.epoch_id, p.channel, b.band, avg(p.power) AS m
      FROM psd64 p JOIN bands b ON p.freq BETWEEN b.low AND b.high GROUP BY 1, 2, 3) GROUP BY 1, 2"""


@register("band_power_mean", sql(["psd64", "bands"], BPM_SQL))
def q_band_power_mean(spark, sf_dir):
    return sp.band_power_mean(psd64(spark, sf_dir), ["epoch_id"], "channel")


def flagship(spark, sf_dir):
    """Relative band power (wide, one column per band) and alpha/beta ratio per epoch and channel."""
    psd = psd64(spark, sf_dir)
    bp = sp.band_power(psd, K).groupBy(*K).pivot("band", [b[0] for b in sp.config.BANDS]).agg(F.first("rel_power"))
    bp = bp.select(*K, *[F.col(b[0]).alias(f"{b[0]}_rel_power") for b in sp.config.BANDS])
    return rounded(bp.join(sp.band_ratios(psd, K), K))
