"""Small helpers shared by the plan modules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rounded(df: DataFrame, digits: int = 6, cols: list[str] | None = None) -> DataFrame:
    """Round every double column (or the named ones) for a stable comparison."""
    names = cols or [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")]
    return df.select(*[F.round(F.col(c), digits).alias(c) if c in names else F.col(c) for c in df.columns])
