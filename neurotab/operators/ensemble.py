"""Probability arrays, voting and stacking of model outputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def softmax(scores: F.Column) -> F.Column:
    """Numerically stable softmax of an array<double> column."""
    m = F.array_max(scores)
    e = F.transform(scores, lambda s: F.exp(s - m))
    tot = F.aggregate(e, F.lit(0.0), lambda a, b: a + b)
    return F.transform(e, lambda v: v / tot)


def argmax(arr: F.Column) -> F.Column:
    """0-based index of the largest element; the lowest index wins ties."""
    return (F.array_position(arr, F.array_max(arr)) - 1).cast("int")


def one_hot(pred: F.Column, k: int) -> F.Column:
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (i == pred).cast("int"))


def soft_vote(scored: DataFrame, id_col: str, prob_cols: Sequence[str], model: str = "model") -> DataFrame:
    """Mean probability over models per sample, then argmax."""
    avg = scored.groupBy(id_col).agg(*[F.avg(c).alias(c) for c in prob_cols],
                                     F.count(model).alias("n_models"))
    arr = F.array(*[F.col(c) for c in prob_cols])
    return avg.withColumn("prediction", argmax(arr)).withColumn("confidence", F.array_max(arr))


def stack_probabilities(scored: DataFrame, id_col: str, prob_cols: Sequence[str], models: Sequence,
                        model: str = "model") -> DataFrame:
    """Probabilities of every base model side by side, one named column per
    (model, class): m{model}_{prob}.  One pivot on the sample id."""
    wide = scored.groupBy(id_col).pivot(model, list(models)).agg(*[F.first(c).alias(c) for c in prob_cols])
    return wide.select(id_col, *[F.col(f"`{m}_{c}`").alias(f"m{m}_{c}") for m in models for c in prob_cols])
