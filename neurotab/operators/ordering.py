"""Order-dependent numbering and running sums that stay balanced under skew.

A window ``PARTITION BY key ORDER BY ...`` puts every row of a key in one
task.  When one key can hold a large share of all rows (one very long
recording, one dominant class) that task becomes the job.  The operators here
range-partition on (key, order) instead, so a hot key is cut into many
slices, number or sum rows inside each slice, and add the totals of the
earlier slices of the same key.  The per-slice total table has at most one row
per (slice, key), whatever the data size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from neurotab.session import cut_lineage

_PID, _POS = "_nt_pid", "_nt_pos"


def _slices(df: DataFrame, keys: Sequence[str], order: Sequence, n_slices: int | None) -> DataFrame:
    spark = df.sparkSession
    n = n_slices or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order_cols = [F.col(c) if isinstance(c, str) else c for c in order]
    key_cols = [F.col(k) for k in keys]
    sliced = (
        df.repartitionByRange(n, *key_cols, *order_cols)
        .sortWithinPartitions(*key_cols, *order_cols)
        .withColumn(_PID, F.spark_partition_id())
        # position of the row inside its range slice, in sorted order
        .withColumn(_POS, F.monotonically_increasing_id() - F.shiftleft(F.col(_PID).cast("long"), 33))
    )
    # Range bounds come from a sample seeded by the RDD id, so two evaluations
    # of this plan may cut the slices differently.  Slice ids and positions
    # are therefore written once to the shared checkpoint folder; both uses
    # below read that copy, and a lost executor cannot change them.
    return cut_lineage(sliced)


def sequence_index(df: DataFrame, keys: Sequence[str], order: Sequence, name: str = "seq",
                   n_slices: int | None = None) -> DataFrame:
    """Add ``name`` = 0-based row number inside each ``keys`` group by ``order``.

    Same result as ``row_number() OVER (PARTITION BY keys ORDER BY order) - 1``
    when ``order`` is a total order, without a single-task group.
    """
    sliced = _slices(df, keys, order, n_slices)
    starts = sliced.groupBy(_PID, *keys).agg(
        F.min(_POS).alias("_nt_first"), F.count(F.lit(1)).alias("_nt_cnt"))
    w = Window.partitionBy(*keys).orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.withColumn("_nt_before", F.coalesce(F.sum("_nt_cnt").over(w), F.lit(0)))
    out = sliced.join(starts.drop("_nt_cnt"), [_PID, *keys])
    return out.withColumn(name, (F.col(_POS) - F.col("_nt_first") + F.col("_nt_before")).cast("long")) \
              .drop(_PID, _POS, "_nt_first", "_nt_before")


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence, values: Sequence[str],
                suffix: str = "_cum", n_slices: int | None = None) -> DataFrame:
    """Add ``<v><suffix>`` = inclusive running sum of each value column inside
    each ``keys`` group in ``order`` (a total order), without a single-task group."""
    sliced = _slices(df, keys, order, n_slices)
    order_cols = [F.col(c) if isinstance(c, str) else c for c in order]
    w_local = Window.partitionBy(_PID, *keys).orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, 0)
    local = sliced
    for v in values:
        local = local.withColumn(v + "_nt_local", F.sum(v).over(w_local))
    totals = sliced.groupBy(_PID, *keys).agg(*[F.sum(v).alias(v + "_nt_tot") for v in values])
    w_prev = Window.partitionBy(*keys).orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    for v in values:
        totals = totals.withColumn(v + "_nt_before", F.coalesce(F.sum(v + "_nt_tot").over(w_prev), F.lit(0)))
    totals = totals.drop(*[v + "_nt_tot" for v in values])
    out = local.join(totals, [_PID, *keys])
    for v in values:
        out = out.withColumn(v + suffix, F.col(v + "_nt_local") + F.col(v + "_nt_before")) \
                 .drop(v + "_nt_local", v + "_nt_before")
    return out.drop(_PID, _POS)


def dense_index(df: DataFrame, col: str, name: str) -> DataFrame:
    """1-based dense rank of ``col`` over the whole table (LOSO fold numbers).

    Ranks the distinct values (one row per value, not per data row) with the
    balanced numbering above, then joins the rank back on the value.
    """
    distinct = df.select(col).distinct()
    ranked = sequence_index(distinct.withColumn("_nt_all", F.lit(0)), ["_nt_all"], [col], name="_nt_rank")
    ranked = ranked.select(col, (F.col("_nt_rank") + 1).cast("int").alias(name))
    return df.join(ranked, col)
