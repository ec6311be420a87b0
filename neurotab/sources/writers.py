"""Sinks: partitioned result tables and append-only histories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def write_partitioned(df: DataFrame, path: str, by: Sequence[str], mode: str = "overwrite") -> None:
    """Parquet partitioned by ``by`` (e.g. model, dataset), so lookups prune directories."""
    df.write.mode(mode).partitionBy(*by).parquet(path)


def append_history(df: DataFrame, path: str, run_col: str = "run_id") -> None:
    """Append training-history rows (run, fold, epoch, metrics...) partitioned by run."""
    df.write.mode("append").partitionBy(run_col).parquet(path)
