"""Fold assignment and splits.

Stratified folds number the rows of each class in a repeatable pseudo-random
order (md5 of the id, then the id) and take the number modulo k.  The
numbering uses the balanced ``sequence_index``: a class holding most rows is
still numbered by many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from neurotab import config
from neurotab.operators.ordering import dense_index, sequence_index


def stratified_folds(df: DataFrame, id_col: str = "id", label: str = "label", k: int = config.CV_FOLDS,
                     out: str = "fold") -> DataFrame:
    key = F.md5(F.col(id_col).cast("string"))
    numbered = sequence_index(df.withColumn("_nt_h", key), [label], ["_nt_h", id_col], name="_nt_seq")
    return numbered.withColumn(out, (F.col("_nt_seq") % k).cast("int")).drop("_nt_h", "_nt_seq")


def loso_folds(df: DataFrame, subject: str = "subject_id", out: str = "fold") -> DataFrame:
    """Leave-one-subject-out: fold = dense rank of the subject (1-based)."""
    return dense_index(df, subject, out)


def split(df: DataFrame, fold_col: str, fold: int) -> tuple[DataFrame, DataFrame]:
    """(train, validation) for one fold: validation = rows of that fold."""
    return df.where(F.col(fold_col) != fold), df.where(F.col(fold_col) == fold)


def split_counts(df: DataFrame, fold_col: str, label: str = "label") -> DataFrame:
    """Per fold f: rows in train (fold != f) and validation (fold = f) by label,
    from per-fold counts (k x classes rows), not from k copies of the data."""
    per = df.groupBy(fold_col, label).agg(F.count(F.lit(1)).alias("_n"))
    tot = per.groupBy(label).agg(F.sum("_n").alias("_tot"))
    j = per.join(tot, label)
    val = j.select(F.col(fold_col).alias("fold"), F.lit("validation").alias("role"), label, F.col("_n").alias("n"))
    trn = j.select(F.col(fold_col).alias("fold"), F.lit("train").alias("role"), label,
                   (F.col("_tot") - F.col("_n")).alias("n"))
    return val.unionByName(trn)
