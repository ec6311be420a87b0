"""Labels and ids derived from ratings and folder names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from neurotab import config


def anxiety_label(ratings: DataFrame, dataset: str = "dataset", valence: str = "valence", arousal: str = "arousal",
                  out: str = "label", thresholds: dict[str, float] | None = None) -> DataFrame:
    """3-level label: high arousal and low valence -> 2, low arousal and high
    valence -> 0, anything else -> 1; the threshold comes with the dataset.  A
    missing rating gives a null label, an unknown dataset fails the query."""
    name, a, v = F.col(dataset), F.col(arousal), F.col(valence)
    t = F.raise_error(F.concat(F.lit("unknown dataset: "), F.coalesce(name, F.lit("null")))).cast("double")
    for known, threshold in (thresholds or config.LABEL_THRESHOLDS).items():
        t = F.when(name == known, F.lit(float(threshold))).otherwise(t)
    lab = F.when((a >= t) & (v < t), 2).when((a < t) & (v >= t), 0).otherwise(1)
    return ratings.withColumn(out, F.when(a.isNotNull() & v.isNotNull(), lab))


def subject_id_from_folder(folder: F.Column) -> F.Column:
    """Text before the first '_', without 'Part' then 'P', as int; otherwise a
    deterministic hash of the folder name mod 100."""
    head = F.split(folder, "_").getItem(0)
    digits = F.regexp_replace(F.regexp_replace(head, "Part", ""), "P", "")
    return F.coalesce(digits.try_cast("int"), F.pmod(F.xxhash64(folder), F.lit(100)).cast("int"))


def class_counts(df: DataFrame, label: str = "label", subject: str | None = "subject_id") -> DataFrame:
    """Rows per class, plus the number of distinct subjects per class."""
    aggs = [F.count(F.lit(1)).alias("n")]
    if subject:
        aggs.append(F.countDistinct(subject).alias("n_subjects"))
    return df.groupBy(label).agg(*aggs)
