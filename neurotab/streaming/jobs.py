"""Streaming forms of the batch operators.

Each job is written once as a DataFrame transformation that works on a batch
or a streaming DataFrame; the streaming entry points add the source, the
watermark, the output mode and the sink.  Late rows (older than the
watermark) are dropped by Spark's state store rules.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from neurotab.operators.time_features import ordered_features
from neurotab.operators.training import job_status


def tumbling_features(events: DataFrame, ts: str = "ts", keys=("recording_id", "channel"), value: str = "value",
                      window: str = "4 seconds", watermark: str | None = None) -> DataFrame:
    """Fixed non-overlapping windows per signal: n, mean, variance, std
    (population), peak-to-peak, RMS, and the features of sample order
    (zero-crossing rate, Hjorth mobility and complexity).  A window's samples
    are held as one array: 512 for 4 seconds at 128 Hz."""
    df = events
    if watermark:
        # event-time watermarks need an instant type; wall-clock (ntz) times are read as session-zone instants
        if df.schema[ts].dataType.typeName() == "timestamp_ntz":
            df = df.withColumn(ts, F.col(ts).cast("timestamp"))
        df = df.withWatermark(ts, watermark)
    agg = df.groupBy(F.window(ts, window).alias("w"), *keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.var_pop(value).alias("variance"),
        F.stddev_pop(value).alias("std"), (F.max(value) - F.min(value)).alias("peak_to_peak"),
        F.sqrt(F.avg(F.col(value) * F.col(value))).alias("rms"),
        F.array_sort(F.collect_list(F.struct(F.col(ts).alias("t"), F.col(value).alias("v")))).alias("_s"))
    agg = agg.withColumn("_o", ordered_features(F.transform("_s", lambda x: x["v"])))
    return agg.select(*keys, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                      "n", "mean", "variance", "std", "peak_to_peak", "rms", "_o.zero_crossing_rate", "_o.hjorth_mobility",
                      "_o.hjorth_complexity")


def start_tumbling(spark: SparkSession, source_dir: str, schema, checkpoint: str, out_dir: str,
                   window: str = "4 seconds", watermark: str = "10 seconds", available_now: bool = True,
                   rename: dict | None = None) -> StreamingQuery:
    """Parquet files arriving in ``source_dir`` -> windowed features ->
    Parquet files in ``out_dir`` (append: a window is emitted once the watermark passes it)."""
    src = spark.readStream.schema(schema).parquet(source_dir)
    for a, b in (rename or {}).items():
        src = src.withColumnRenamed(a, b)
    out = tumbling_features(src, window=window, watermark=watermark)
    w = out.writeStream.outputMode("append").format("parquet").option("path", out_dir) \
        .option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()


def start_scoring(spark: SparkSession, source_dir: str, schema, checkpoint: str, out_dir: str,
                  score_batch: Callable[[DataFrame], DataFrame], available_now: bool = True) -> StreamingQuery:
    """Score each arriving message: every micro-batch is a static DataFrame
    handed to ``score_batch`` (the batch prediction chain) and written to its own
    partition ``batch_id=<n>`` of ``out_dir``.  A batch that is retried replaces
    its partition, so each message is scored into the table once."""
    def run(batch: DataFrame, batch_id: int) -> None:
        score_batch(batch).write.mode("overwrite").parquet(f"{out_dir}/batch_id={batch_id}")

    w = spark.readStream.schema(schema).json(source_dir).writeStream.foreachBatch(run) \
        .option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()


def start_job_status(spark: SparkSession, source_dir: str, schema, checkpoint: str, out_dir: str,
                     available_now: bool = True) -> StreamingQuery:
    """Latest status per training job from an event stream (update mode): each
    batch's changed jobs go to their own partition of ``out_dir``, replaced if
    the batch is retried; ``latest_status`` reads the current state."""
    def run(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_dir}/batch_id={batch_id}")

    src = spark.readStream.schema(schema).parquet(source_dir)
    w = job_status(src).writeStream.outputMode("update").foreachBatch(run) \
        .option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()


def latest_status(spark: SparkSession, out_dir: str, job: str = "job_id") -> DataFrame:
    """The newest row per job of what ``start_job_status`` has written."""
    rows = spark.read.parquet(out_dir)
    columns = [c for c in rows.columns if c not in (job, "batch_id")]
    return rows.groupBy(job).agg(F.max_by(F.struct(*columns), "batch_id").alias("_l")).select(job, "_l.*")


class ProgressListener(StreamingQueryListener):
    """Forwards each micro-batch's progress (batch id, input rows, rate) to a
    callback; add with ``spark.streams.addListener``."""

    def __init__(self, callback: Callable[[int, dict], None]):
        self.callback = callback

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        p = event.progress
        self.callback(p.batchId, {"name": p.name, "input_rows": p.numInputRows,
                                  "rows_per_second": p.processedRowsPerSecond})

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass
