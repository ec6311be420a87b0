"""Time-domain features per signal (typically per epoch and channel).

One window pass (lags inside the signal, bounded by the epoch length) then
one aggregation.  Moments are population moments (ddof 0).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-10
TIME_FEATURES = ["mean", "variance", "std", "skewness", "kurtosis", "zero_crossing_rate", "peak_to_peak",
                 "hjorth_activity", "hjorth_mobility", "hjorth_complexity", "rms"]


def scrub(c: F.Column) -> F.Column:
    """NaN, +inf, -inf and null -> 0.0."""
    return F.when(c.isNull() | F.isnan(c) | c.isin(float("inf"), float("-inf")), F.lit(0.0)).otherwise(c)


def _with_differences(df: DataFrame, sig_keys: Sequence[str], idx: str, value: str) -> DataFrame:
    w = Window.partitionBy(*sig_keys).orderBy(idx)
    d = df.select(*sig_keys, idx, value,
                  (F.col(value) - F.lag(value).over(w)).alias("_d1"),
                  (F.signum(value) != F.lag(F.signum(value)).over(w)).alias("_cross"))
    return d.withColumn("_d2", F.col("_d1") - F.lag("_d1").over(w))


def time_features(df: DataFrame, sig_keys: Sequence[str], idx: str = "sample_idx", value: str = "value") -> DataFrame:
    """Wide result: sig_keys + TIME_FEATURES + hjorth_fd (unguarded complexity).
    Raw values: a flat signal gives null skewness/kurtosis, as the moment
    definitions do; ``scrub`` maps them to 0 at assembly."""
    d = _with_differences(df, sig_keys, idx, value)
    agg = d.groupBy(*sig_keys).agg(
        F.avg(value).alias("mean"), F.var_pop(value).alias("variance"), F.stddev_pop(value).alias("std"),
        F.skewness(value).alias("skewness"), F.kurtosis(value).alias("kurtosis"),
        (F.count_if(F.col("_cross")) / F.count(F.lit(1))).alias("zero_crossing_rate"),
        (F.max(value) - F.min(value)).alias("peak_to_peak"),
        F.sqrt(F.avg(F.col(value) * F.col(value))).alias("rms"),
        F.var_pop("_d1").alias("_vd1"), F.var_pop("_d2").alias("_vd2"))
    act, vd1, vd2 = F.col("variance"), F.col("_vd1"), F.col("_vd2")
    mobility = F.when(act > EPS, F.sqrt(F.try_divide(vd1, act))).otherwise(F.lit(0.0))
    complexity = F.when((vd1 > EPS) & (mobility > EPS), F.sqrt(F.try_divide(vd2, vd1)) / mobility) \
        .otherwise(F.lit(0.0))
    raw_complexity = F.try_divide(F.sqrt(F.try_divide(vd2, vd1)), F.sqrt(F.try_divide(vd1, act)))
    return agg.select(*sig_keys, "mean", "variance", "std", "skewness", "kurtosis", "zero_crossing_rate",
                      "peak_to_peak", act.alias("hjorth_activity"), mobility.alias("hjorth_mobility"),
                      complexity.alias("hjorth_complexity"), "rms", raw_complexity.alias("hjorth_fd"))


def _array_variance(a: F.Column) -> F.Column:
    """Population variance of an array (null if empty)."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    mean = F.try_divide(total(a), F.size(a))
    return F.get(F.transform(F.array(mean), lambda m: F.try_divide(total(F.transform(a, lambda v: (v - m) * (v - m))), F.size(a))), F.lit(0))


def ordered_features(values: F.Column) -> F.Column:
    """Struct (zero_crossing_rate, hjorth_mobility, hjorth_complexity) of one
    array of samples in order; for windows of bounded length (streaming)."""
    let = lambda x, body: F.get(F.transform(F.array(x), body), F.lit(0))
    differences = lambda a: F.zip_with(F.slice(a, 2, F.greatest(F.size(a), F.lit(1))),
                                       F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), lambda x, y: x - y)
    signs = lambda a: F.transform(a, lambda v: F.signum(v))
    crossings = lambda a: F.size(F.filter(differences(signs(a)), lambda v: v != 0))

    def shape(a: F.Column) -> F.Column:
        def of(v: F.Column) -> F.Column:
            mobility = F.when(v["v0"] > EPS, F.sqrt(F.try_divide(v["v1"], v["v0"]))).otherwise(F.lit(0.0))
            complexity = F.when((v["v1"] > EPS) & (mobility > EPS), F.sqrt(F.try_divide(v["v2"], v["v1"])) / mobility).otherwise(F.lit(0.0))
            return F.struct((crossings(a) / F.size(a)).alias("zero_crossing_rate"), F.coalesce(mobility, F.lit(0.0)).alias("hjorth_mobility"),
                            F.coalesce(complexity, F.lit(0.0)).alias("hjorth_complexity"))
        return let(differences(a), lambda d: let(F.struct(
            _array_variance(a).alias("v0"), _array_variance(d).alias("v1"), _array_variance(differences(d)).alias("v2")), of))

    return let(values, shape)


def to_feature_rows(wide: DataFrame, epoch_keys: Sequence[str], channel: str, names: Sequence[str],
                    stage: int = 0) -> DataFrame:
    """Wide per-channel features -> long (epoch_keys..., feature, value, stage)
    with names ``{channel}_{feature}``."""
    long = wide.unpivot([*epoch_keys, channel], list(names), "_f", "value")
    return long.select(*epoch_keys, F.concat_ws("_", F.col(channel), F.col("_f")).alias("feature"),
                       F.col("value").cast("double").alias("value"), F.lit(stage).alias("stage"))
