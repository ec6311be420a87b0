"""Cleaning steps on the long signal layout (keys..., channel, sample_idx, value).

Group statistics of a whole (recording, channel) signal are computed with
``groupBy`` (partial aggregation on the map side, so a very long recording is
not one task) and joined back on the group key; the per-group table has one
row per signal and AQE turns the join into a broadcast when it is small.
Windows are only used where the frame is bounded: across channels at one
sample (CAR), or inside an epoch.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from neurotab import config
from neurotab.functions import iir
from neurotab.functions.kernels import resample_udf, zero_phase_udf
from neurotab.operators.blockfft import resample
from neurotab.operators.blockfilter import BLOCK, zero_phase
from neurotab.session import cut_lineage


def car_reference(df: DataFrame, rec_keys: Sequence[str], idx: str = "sample_idx", value: str = "value") -> DataFrame:
    """Common average reference: subtract the mean over channels at each sample."""
    w = Window.partitionBy(*rec_keys, idx)
    return df.withColumn(value, F.col(value) - F.avg(value).over(w))


def baseline_correct(df: DataFrame, sig_keys: Sequence[str], idx: str = "sample_idx", value: str = "value",
                     baseline: int = config.BASELINE_SAMPLES) -> DataFrame:
    """Subtract the mean of the first min(baseline, n) samples of each signal."""
    base = df.where(F.col(idx) < baseline).groupBy(*sig_keys).agg(F.avg(value).alias("_base"))
    return df.join(base, list(sig_keys), "left") \
        .withColumn(value, F.col(value) - F.coalesce("_base", F.lit(0.0))).drop("_base")


def zscore(df: DataFrame, sig_keys: Sequence[str], value: str = "value", eps: float = 1e-10) -> DataFrame:
    """Per-signal z-score with the population std; a flat signal is only centred."""
    st = df.groupBy(*sig_keys).agg(F.avg(value).alias("_mu"), F.stddev_pop(value).alias("_sd"))
    out = df.join(st, list(sig_keys))
    centred = F.col(value) - F.col("_mu")
    return out.withColumn(value, F.when(F.col("_sd") > eps, centred / F.col("_sd")).otherwise(centred)) \
        .drop("_mu", "_sd")


def epoching(df: DataFrame, sig_keys: Sequence[str], idx: str = "sample_idx", value: str = "value",
             size: int = config.EPOCH_SAMPLES) -> DataFrame:
    """Non-overlapping epochs of ``size`` samples, tail dropped; a signal shorter
    than one epoch gives one epoch zero-padded to ``size``.
    Output: (sig_keys..., epoch_id, pos, value)."""
    n = df.groupBy(*sig_keys).agg(F.count(F.lit(1)).alias("_n"))
    full = df.join(n, list(sig_keys)).where(
        (F.col("_n") < size) | (F.floor(F.col(idx) / size) < F.floor(F.col("_n") / size)))
    main = full.select(*sig_keys, F.floor(F.col(idx) / size).cast("long").alias("epoch_id"),
                       (F.col(idx) % size).cast("long").alias("pos"), F.col(value).cast("double").alias(value))
    # padding rows only for short signals: at most size-1 rows per signal
    pad = n.where(F.col("_n") < size).select(
        *sig_keys, F.lit(0).cast("long").alias("epoch_id"),
        F.explode(F.sequence(F.col("_n"), F.lit(size - 1))).alias("pos"),
        F.lit(0.0).alias(value)).withColumn("pos", F.col("pos").cast("long"))
    return main.unionByName(pad)


def artifact_flags(df: DataFrame, rec_keys: Sequence[str], channel: str = "channel", value: str = "value",
                   n_std: float = 2.0, max_flagged: int = config.ARTIFACT_MAX_FLAGGED,
                   min_channels: int = config.ARTIFACT_MIN_CHANNELS) -> DataFrame:
    """Flag channels whose variance exceeds mean + n_std * std of the channel
    variances of their recording (population moments); at most the first
    ``max_flagged`` in channel order; only recordings with >= ``min_channels``.
    Output: (rec_keys..., channel, variance, flagged)."""
    var = df.groupBy(*rec_keys, channel).agg(F.var_pop(value).alias("variance"))
    w = Window.partitionBy(*rec_keys)
    thr = var.withColumn("_thr", F.avg("variance").over(w) + n_std * F.stddev_pop("variance").over(w)) \
             .withColumn("_nch", F.count(F.lit(1)).over(w))
    exceed = (F.col("variance") > F.col("_thr")) & (F.col("_nch") >= min_channels)
    w_rank = Window.partitionBy(*rec_keys).orderBy(F.when(exceed, 0).otherwise(1), channel)
    return thr.withColumn("flagged", exceed & (F.row_number().over(w_rank) <= max_flagged)) \
              .select(*rec_keys, channel, "variance", "flagged")


def moving_average(df: DataFrame, sig_keys: Sequence[str], k: int, idx: str = "sample_idx", value: str = "value",
                   block: int = 8192, out: str = "moving_avg") -> DataFrame:
    """Trailing mean over the last ``k`` samples (fewer at the start).

    The signal is cut into blocks of ``block`` samples; each block also gets a
    copy of the last k-1 samples of the previous block (halo), so the window
    runs per (signal, block) and no signal is ever one task."""
    block = max(block, k)        # a window reaches into the block before it, not further
    blk = F.floor(F.col(idx) / block)
    own = df.withColumn("_blk", blk).withColumn("_halo", F.lit(False))
    halo = df.where(F.col(idx) % block >= block - (k - 1)) \
        .withColumn("_blk", blk + 1).withColumn("_halo", F.lit(True)) if k > 1 else None
    both = own.unionByName(halo) if halo is not None else own
    w = Window.partitionBy(*sig_keys, "_blk").orderBy(idx).rowsBetween(-(k - 1), 0)
    return both.withColumn(out, F.avg(value).over(w)).where(~F.col("_halo")).drop("_blk", "_halo")


def to_arrays(df: DataFrame, sig_keys: Sequence[str], idx: str = "sample_idx", value: str = "value",
              out: str = "values") -> DataFrame:
    """Long -> array layout: one row per signal with values in index order.
    Use on epochs (bounded length); a whole recording should stay long."""
    return df.groupBy(*sig_keys).agg(F.array_sort(F.collect_list(F.struct(idx, value))).alias("_s")) \
        .select(*sig_keys, F.col(f"_s.{value}").alias(out))


def to_long(df: DataFrame, keys: Sequence[str], values: str = "values", idx: str = "sample_idx",
            value: str = "value") -> DataFrame:
    return df.select(*keys, F.posexplode(values).alias(idx, value)).withColumn(idx, F.col(idx).cast("long"))


def fourier_resample(df: DataFrame, values: str, sr_in: float, sr_out: float = config.SAMPLING_RATE) -> DataFrame:
    """Array layout: resample each signal to int(n * sr_out / sr_in) samples
    (no-op when the rates agree)."""
    if sr_in == sr_out:
        return df
    return df.withColumn(values, resample_udf(float(sr_in), float(sr_out))(F.col(values)))


def bandpass(df: DataFrame, values: str, fs: float = config.SAMPLING_RATE, low: float = config.BANDPASS_LOW,
             high: float = config.BANDPASS_HIGH, order: int = config.FILTER_ORDER) -> DataFrame:
    """Zero-phase Butterworth band-pass (array layout); too-short signals pass through."""
    return df.withColumn(values, zero_phase_udf(iir.bandpass_sections(low, high, fs, order))(F.col(values)))


def notch(df: DataFrame, values: str, fs: float = config.SAMPLING_RATE, freq: float = config.NOTCH_FREQ,
          q: float = config.NOTCH_Q) -> DataFrame:
    """Zero-phase notch (array layout); too-short signals pass through."""
    return df.withColumn(values, zero_phase_udf([iir.notch(freq, q, fs)])(F.col(values)))


def cleaning_filters(fs: float = config.SAMPLING_RATE) -> list[list[iir.Section]]:
    """The chain's band-pass and notch, for ``blockfilter.zero_phase``."""
    band = iir.bandpass_sections(config.BANDPASS_LOW, config.BANDPASS_HIGH, fs, config.FILTER_ORDER)
    return [band, [iir.notch(config.NOTCH_FREQ, config.NOTCH_Q, fs)]]


def clean(df_long: DataFrame, rec_keys: Sequence[str], channel: str = "channel", sr_in: float = config.SAMPLING_RATE,
          filters: bool = True, baseline: int = config.BASELINE_SAMPLES, epoch_size: int = config.EPOCH_SAMPLES,
          eps: float = 1e-10, block: int = BLOCK) -> DataFrame:
    """Whole cleaning chain, in order: resample -> band-pass -> notch ->
    CAR -> baseline -> z-score -> epochs.  All channels stay; ``artifact_flags``
    names suspicious ones in a table of its own.

    The filters run over blocks of ``block`` samples (``blockfilter``); the
    filtered long table is written once to the checkpoint folder, since
    statistics and the main chain both read it.  Baseline, z-score and epoch statistics of a signal come from ONE
    aggregation over the CAR output (baseline mean, mean, population std,
    length) and ONE join; chaining the steps as separate aggregate-and-join
    pairs would re-evaluate the upstream plan at every step.
    Output: (rec_keys..., channel, epoch_id, pos, value)."""
    sig = [*rec_keys, channel]
    if sr_in != config.SAMPLING_RATE:
        df_long = resample(df_long, sig, sr_in, config.SAMPLING_RATE)
    if filters:
        df_long = zero_phase(df_long, sig, cleaning_filters(), block)
    if filters or sr_in != config.SAMPLING_RATE:
        df_long = cut_lineage(df_long)
    car = car_reference(df_long, rec_keys)
    st = car.groupBy(*sig).agg(
        F.coalesce(F.avg(F.when(F.col("sample_idx") < baseline, F.col("value"))), F.lit(0.0)).alias("_b"),
        F.avg("value").alias("_m"), F.stddev_pop("value").alias("_sd"), F.count(F.lit(1)).alias("_n"))
    x = car.join(st, sig)
    based = F.col("value") - F.col("_b")                  # baseline correction
    centred = based - (F.col("_m") - F.col("_b"))         # minus the mean of the corrected signal
    z = F.when(F.col("_sd") > eps, centred / F.col("_sd")).otherwise(centred)
    x = x.select(*sig, "sample_idx", z.alias("value"), "_n")
    main = x.where((F.col("_n") < epoch_size) | (F.floor(F.col("sample_idx") / epoch_size)
                                                 < F.floor(F.col("_n") / epoch_size))) \
        .select(*sig, F.floor(F.col("sample_idx") / epoch_size).cast("long").alias("epoch_id"),
                (F.col("sample_idx") % epoch_size).cast("long").alias("pos"), "value")
    pad = st.where(F.col("_n") < epoch_size).select(
        *sig, F.lit(0).cast("long").alias("epoch_id"),
        F.explode(F.sequence(F.col("_n"), F.lit(epoch_size - 1))).alias("pos"), F.lit(0.0).alias("value")) \
        .withColumn("pos", F.col("pos").cast("long"))
    return main.unionByName(pad)
