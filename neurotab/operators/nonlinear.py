"""Nonlinear signal features.

Permutation entropy, Higuchi fractal dimension and detrended fluctuation are
native Spark plans (lags inside a signal, a fixed small parameter table,
grouped regressions).  Sample and approximate entropy compare every template
with every other within tolerance r; they run as an Arrow kernel on the
array layout (sorted-neighbour search per signal), because the relational
pair table would be ~n^2/2 rows per signal.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from neurotab.functions.kernels import approx_entropy_udf, sample_entropy_udf


def sample_entropy(df: DataFrame, keys: Sequence[str], values: str = "values") -> DataFrame:
    return df.select(*keys, sample_entropy_udf()(F.col(values)).alias("sample_entropy"))


def approx_entropy(df: DataFrame, keys: Sequence[str], values: str = "values") -> DataFrame:
    return df.select(*keys, approx_entropy_udf()(F.col(values)).alias("approx_entropy"))


def permutation_entropy(df: DataFrame, sig_keys: Sequence[str], idx: str = "sample_idx",
                        value: str = "value") -> DataFrame:
    """Order 3, delay 1, normalised by log2(3!); ties ordered by position."""
    w = Window.partitionBy(*sig_keys).orderBy(idx)
    a, b, c = F.col(value), F.lead(value, 1).over(w), F.lead(value, 2).over(w)
    pat = df.select(*sig_keys, (F.when(a <= b, 1).otherwise(0) + F.when(a <= c, 2).otherwise(0)
                                + F.when(b <= c, 4).otherwise(0)).alias("_pat"), c.isNotNull().alias("_ok"))
    cnt = pat.where("_ok").groupBy(*sig_keys, "_pat").agg(F.count(F.lit(1)).alias("_c"))
    tot = F.sum("_c").over(Window.partitionBy(*sig_keys))
    p = cnt.withColumn("_p", F.col("_c") / tot)
    return p.groupBy(*sig_keys).agg(
        (-F.sum(F.col("_p") * F.log2("_p")) / F.lit(math.log2(6.0))).alias("permutation_entropy"))


def higuchi_fd(df: DataFrame, sig_keys: Sequence[str], idx: str = "sample_idx", value: str = "value",
               kmax: int = 10) -> DataFrame:
    """Slope of ln L(k) on ln(1/k), k = 1..kmax.  For offset m the curve sums
    |x[m+jk] - x[m+(j-1)k]| for j = 1 .. n_max-1, n_max = floor((N-m-1)/k),
    normalised by (N-1)/(k*n_max)/k; L(k) = sum over m / k."""
    w = Window.partitionBy(*sig_keys).orderBy(idx)
    lags = [F.abs(F.col(value) - F.lag(value, k).over(w)) for k in range(1, kmax + 1)]
    n = F.count(F.lit(1)).over(Window.partitionBy(*sig_keys))
    d = df.select(*sig_keys, F.col(idx).alias("_i"), n.alias("_N"),
                  F.array(*[F.struct(F.lit(k).alias("k"), lags[k - 1].alias("d")) for k in range(1, kmax + 1)])
                  .alias("_arr"))
    d = d.select(*sig_keys, "_i", "_N", F.explode("_arr").alias("_e")) \
        .select(*sig_keys, "_i", "_N", F.col("_e.k").alias("k"), F.col("_e.d").alias("d"))
    m = F.col("_i") % F.col("k")
    j = F.floor(F.col("_i") / F.col("k"))
    nmax = F.floor((F.col("_N") - m - 1) / F.col("k"))
    d = d.where(F.col("d").isNotNull() & (j >= 1) & (j <= nmax - 1))
    lm = d.groupBy(*sig_keys, "k", m.alias("m"), "_N", nmax.alias("_nmax")).agg(F.sum("d").alias("_ll"))
    lm = lm.withColumn("_lm", F.col("_ll") / F.col("k") * (F.col("_N") - 1) / (F.col("k") * F.col("_nmax")))
    lk = lm.groupBy(*sig_keys, "k").agg((F.sum("_lm") / F.col("k")).alias("_lk"))
    return lk.groupBy(*sig_keys).agg(
        F.regr_slope(F.log("_lk"), F.log(1.0 / F.col("k"))).alias("higuchi_fd"))


def dfa_exponent(df: DataFrame, sig_keys: Sequence[str], idx: str = "sample_idx", value: str = "value",
                 min_box: int = 4, factor: float = 1.2, max_frac: float = 0.1) -> DataFrame:
    """Detrended fluctuation: profile = cumulative sum of the mean-removed
    signal; box sizes = distinct floor(min_box * factor^i) for
    i <= floor(ln(max_frac*N/min_box)/ln factor); per box the residual sum of
    squares of a straight-line fit; F(s) = sqrt(mean over whole boxes of RSS/s);
    exponent = slope of ln F on ln s over boxes with F > 0."""
    w_all = Window.partitionBy(*sig_keys)
    w_cum = Window.partitionBy(*sig_keys).orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    prof = df.select(*sig_keys, F.col(idx).alias("_i"), (F.col(value) - F.avg(value).over(w_all)).alias("_xc"),
                     F.count(F.lit(1)).over(w_all).alias("_N"))
    prof = prof.select(*sig_keys, "_i", "_N", F.sum("_xc").over(w_cum).alias("_y"))
    max_i = F.floor(F.log(F.lit(max_frac) * F.col("_N") / min_box) / F.lit(math.log(factor)))
    sizes = F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(max_i, F.lit(0)).cast("int")),
                                         lambda i: F.floor(F.lit(float(min_box)) * F.pow(F.lit(factor), i)).cast("int")))
    sizes = F.when(max_i >= 0, sizes).otherwise(F.array(F.lit(min_box)))
    boxed = prof.select(*sig_keys, "_i", "_N", "_y", F.explode(sizes).alias("s"))
    boxed = boxed.where(F.col("_i") < F.col("_N") - F.col("_N") % F.col("s"))
    pos = (F.col("_i") % F.col("s")).cast("double")
    box = boxed.groupBy(*sig_keys, "s", F.floor(F.col("_i") / F.col("s")).alias("_b")).agg(
        F.regr_syy("_y", pos).alias("_syy"), F.regr_sxy("_y", pos).alias("_sxy"), F.regr_sxx("_y", pos).alias("_sxx"))
    rss = F.greatest(F.col("_syy") - F.col("_sxy") * F.col("_sxy") / F.col("_sxx"), F.lit(0.0))
    fl = box.groupBy(*sig_keys, "s").agg(F.sqrt(F.avg(rss / F.col("s"))).alias("_F")).where(F.col("_F") > 0)
    return fl.groupBy(*sig_keys).agg(F.regr_slope(F.log("_F"), F.log(F.col("s").cast("double"))).alias("dfa"))
