"""Whole feature set of an epoch table: time, spectral, wavelet, asymmetry and
nonlinear features, merged by stage (later stage wins on equal names)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from neurotab import config
from neurotab.operators import nonlinear as nl
from neurotab.operators import spectral as sp
from neurotab.operators import wavelet as wv
from neurotab.operators.assemble import merge_features
from neurotab.operators.preprocess import to_arrays
from neurotab.operators.time_features import TIME_FEATURES, time_features, to_feature_rows
from neurotab.session import cut_lineage

STAGE_TIME, STAGE_FREQ, STAGE_NONLINEAR = 0, 1, 2


def _rows(wide: DataFrame, epoch_keys, channel, names, stage):
    return to_feature_rows(wide, epoch_keys, channel, names, stage)


def epoch_features(long: DataFrame, epoch_keys: Sequence[str], channel: str = "channel", idx: str = "sample_idx",
                   value: str = "value", fs: float = config.SAMPLING_RATE, kernels: bool = True,
                   wavelet: bool = True, materialize: bool = True) -> DataFrame:
    """Long feature rows (epoch_keys..., feature, value) with names ``{channel}_{name}``
    plus the cross-channel asymmetry features.  ``kernels`` adds sample and
    approximate entropy (Arrow kernel).

    The PSD is computed once and written to the checkpoint folder (every
    spectral feature and the asymmetry read it); with ``materialize`` the
    merged feature table is written too, so selection, training and scoring
    reuse it instead of recomputing the whole feature plan."""
    sig = [*epoch_keys, channel]
    arrays = to_arrays(long, sig, idx, value)
    psd = cut_lineage(sp.welch_psd(arrays, sig, "values", fs=fs))
    tf = time_features(long, sig, idx, value)
    stages = [_rows(tf, epoch_keys, channel, TIME_FEATURES, STAGE_TIME)]
    bands = sp.band_power(psd, sig)
    abs_rows = bands.select(*epoch_keys, F.concat_ws("_", channel, "band", F.lit("abs_power")).alias("feature"),
                            F.col("abs_power").alias("value"), F.lit(STAGE_FREQ).alias("stage"))
    rel_rows = bands.select(*epoch_keys, F.concat_ws("_", channel, "band", F.lit("rel_power")).alias("feature"),
                            F.col("rel_power").alias("value"), F.lit(STAGE_FREQ).alias("stage"))
    spec = sp.spectral_summary(psd, sig)
    summ = spec.join(sp.band_ratios(psd, sig), sig).join(sp.median_frequency(psd, sig), sig)
    stages += [abs_rows, rel_rows,
               _rows(summ, epoch_keys, channel, ["alpha_beta_ratio", "theta_alpha_ratio", "spectral_entropy",
                                                  "mean_frequency", "median_frequency"], STAGE_FREQ)]
    if wavelet:
        ee = wv.energy_entropy(wv.dwt(long, sig, idx, value, level=4), sig)
        for name in ("dwt_energy", "dwt_entropy"):
            stages.append(ee.select(*epoch_keys, F.concat_ws("_", channel, F.lit(name), "band").alias("feature"),
                                    F.col(name).alias("value"), F.lit(STAGE_FREQ).alias("stage")))
    faa = sp.frontal_asymmetry(psd, epoch_keys, channel)
    stages.append(faa.select(*epoch_keys, F.col("pair").alias("feature"), F.col("asymmetry").alias("value"),
                             F.lit(STAGE_FREQ).alias("stage")))
    nonlin = nl.permutation_entropy(long, sig, idx, value) \
        .join(nl.higuchi_fd(long, sig, idx, value), sig) \
        .join(nl.dfa_exponent(long, sig, idx, value), sig) \
        .join(spec.select(*sig, F.col("spectral_entropy_norm").alias("spectral_entropy")), sig) \
        .join(tf.select(*sig, "hjorth_fd"), sig)
    names = ["permutation_entropy", "higuchi_fd", "dfa", "spectral_entropy", "hjorth_fd"]
    if kernels:
        nonlin = nonlin.join(nl.sample_entropy(arrays, sig).join(nl.approx_entropy(arrays, sig), sig), sig)
        names += ["sample_entropy", "approx_entropy"]
    stages.append(_rows(nonlin, epoch_keys, channel, names, STAGE_NONLINEAR))
    merged = merge_features(stages, epoch_keys)
    return cut_lineage(merged) if materialize else merged
