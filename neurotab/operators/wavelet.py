"""Discrete wavelet transform (db4, symmetric extension) of epochs.

Signals are gathered into arrays (one shuffle, by signal) and all levels of a
batch of equal-length epochs are computed in one Arrow kernel.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from neurotab import config
from neurotab.functions.kernels import wavelet_udf
from neurotab.operators.preprocess import to_arrays

FILTER_LEN = 8


def max_level(n: int, filter_len: int = FILTER_LEN) -> int:
    if n < filter_len - 1:
        return 0
    return int(math.floor(math.log2(n / (filter_len - 1))))


def dwt(df: DataFrame, sig_keys: Sequence[str], idx: str = "sample_idx", value: str = "value",
        level: int = 4) -> DataFrame:
    """Multilevel db4 decomposition, level = min(level, max level of n).
    Output: (sig_keys..., band, pos, coef) with bands A{L}, D{L} ... D1."""
    return dwt_arrays(to_arrays(df, sig_keys, idx, value), sig_keys, "values", level)


def dwt_arrays(df: DataFrame, sig_keys: Sequence[str], values: str = "values", level: int = 4) -> DataFrame:
    """``dwt`` of signals held as arrays (epochs of bounded length): no shuffle."""
    bands = wavelet_udf(config.DB4_LOW, config.DB4_HIGH, level)
    x = df.select(*sig_keys, bands(F.col(values)).alias("_b")).select(*sig_keys, F.size("_b").alias("_n"), F.posexplode("_b").alias("_i", "_c"))
    name = F.when(F.col("_i") == 0, F.concat(F.lit("A"), F.col("_n") - 1)).otherwise(F.concat(F.lit("D"), F.col("_n") - F.col("_i")))
    return x.select(*sig_keys, name.alias("band"), F.posexplode("_c").alias("pos", "coef")) \
        .select(*sig_keys, "band", F.col("pos").cast("long").alias("pos"), "coef")


def energy_entropy(coeffs: DataFrame, sig_keys: Sequence[str]) -> DataFrame:
    """Per band: energy = sum c^2; entropy (bits) of |c| / sum|c| over non-zero entries."""
    a = F.abs("coef")
    agg = coeffs.groupBy(*sig_keys, "band").agg(
        F.sum(F.col("coef") * F.col("coef")).alias("dwt_energy"),
        F.sum(F.when(a > 0, a)).alias("_s"), F.sum(F.when(a > 0, a * F.log2(a))).alias("_sl"))
    return agg.select(*sig_keys, "band", "dwt_energy",
                      (F.log2("_s") - F.col("_sl") / F.col("_s")).alias("dwt_entropy"))
