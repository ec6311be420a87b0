"""Feature assembly: merge stage outputs, scrub, order, vectorise."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from neurotab.operators.time_features import scrub


def merge_features(stages: Sequence[DataFrame], keys: Sequence[str], feature: str = "feature",
                   value: str = "value", stage: str = "stage") -> DataFrame:
    """Union of stage outputs (keys..., feature, value, stage); on equal names
    the later stage wins; values scrubbed (NaN/inf/null -> 0)."""
    allf = stages[0]
    for s in stages[1:]:
        allf = allf.unionByName(s)
    return allf.groupBy(*keys, feature).agg(F.max_by(value, stage).alias(value)) \
        .withColumn(value, scrub(F.col(value)))


def feature_names(long: DataFrame, feature: str = "feature") -> list[str]:
    """Sorted union of feature names over all rows (O(features) to the driver)."""
    return sorted(r[0] for r in long.select(feature).distinct().collect())


def assemble(long: DataFrame, keys: Sequence[str], names: Sequence[str], feature: str = "feature",
             value: str = "value", out: str = "features") -> DataFrame:
    """One row per key with a dense vector in the given (sorted) name order;
    names missing for a row are 0.0."""
    wide = long.groupBy(*keys).pivot(feature, list(names)).agg(F.first(value))
    arr = F.array(*[F.coalesce(F.col(f"`{n}`"), F.lit(0.0)) for n in names])
    return wide.select(*keys, array_to_vector(arr).alias(out))


def ordered_positions(long: DataFrame, keys: Sequence[str], feature: str = "feature",
                      value: str = "value") -> DataFrame:
    """(keys..., position, feature, value): features of each row in sorted-name order."""
    srt = long.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(feature, value))).alias("_a"))
    return srt.select(*keys, F.posexplode("_a").alias("position", "_s")) \
        .select(*keys, "position", F.col(f"_s.{feature}").alias(feature), F.col(f"_s.{value}").alias(value))


def manual_vector(requests: DataFrame, names: Sequence[str], features: str = "features",
                  out: str = "vector") -> DataFrame:
    """Map<string,double> request -> ordered array, absent names 0.0."""
    arr = F.array(*[F.coalesce(F.try_element_at(F.col(features), F.lit(n)), F.lit(0.0)) for n in names])
    return requests.withColumn(out, arr)
