"""Data shaping for reports: previews, level texts, feature tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def waveform_preview(df: DataFrame, rec_keys: Sequence[str], channels: Sequence[str], sr: float,
                     seconds: float = 5.0, max_points: int = 500, idx: str = "sample_idx",
                     value: str = "value", channel: str = "channel") -> DataFrame:
    """First ``seconds`` of the listed channels, every ``step``-th sample with
    step = max(1, floor(n / max_points)) (n = samples per channel of the
    recording), time rounded to 3 decimals, one column per channel, missing 0."""
    n = df.groupBy(*rec_keys, channel).agg(F.count(F.lit(1)).alias("_c")) \
        .groupBy(*rec_keys).agg(F.max("_c").alias("_n"))
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / max_points))
    kept = df.where(F.col(idx) < sr * seconds).where(F.col(channel).isin(list(channels))) \
        .join(n, list(rec_keys)).where(F.col(idx) % step == 0)
    wide = kept.groupBy(*rec_keys, idx).pivot(channel, list(channels)).agg(F.max(value))
    return wide.select(*rec_keys, idx, F.round(F.col(idx) / F.lit(float(sr)), 3).alias("time"),
                       *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in channels])


def level_status(level: F.Column) -> F.Column:
    """High -> Action Required, Moderate -> Monitor, anything else -> Normative."""
    return F.when(level == "High", "Action Required").when(level == "Moderate", "Monitor").otherwise("Normative")


def gauge_position(asymmetry: F.Column) -> F.Column:
    """Asymmetry mapped to 0..100: max(0, min(100, (x + 0.5) * 100))."""
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), (asymmetry + 0.5) * 100))


def ui_band(name: F.Column) -> F.Column:
    """Display band: first of Alpha, Beta, Theta, Gamma contained (case as
    written), else Complex."""
    out = F.lit("Complex")
    for b in reversed(["Alpha", "Beta", "Theta", "Gamma"]):
        out = F.when(name.contains(b), F.lit(b)).otherwise(out)
    return out


def importance_value(importance: F.Column, mean_shap: F.Column) -> F.Column:
    """importance, else mean_shap, else 0 (zero counts as missing)."""
    return F.coalesce(F.when(importance != 0, importance), F.when(mean_shap != 0, mean_shap), F.lit(0.0))
