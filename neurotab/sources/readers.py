"""Scans of signal files and their metadata.

All readers return DataFrames with a fixed schema; file contents are read by
Spark's file sources (csv, json, parquet, binaryFile) so a directory of many
recordings is split across tasks.  Path listings read metadata only: the
binary content column is never selected, so it is pruned from the scan.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from neurotab import config

# FIXED VALUES: 32 EEG channel names of the 40-channel trial tensor, in file order.
TRIAL_EEG_CHANNELS = [
    "Fp1", "AF3", "F3", "F7", "FC5", "FC1", "C3", "T7",
    "CP5", "CP1", "P3", "P7", "PO3", "O1", "Oz", "Pz",
    "Fp2", "AF4", "F4", "F8", "FC6", "FC2", "C4", "T8",
    "CP6", "CP2", "P4", "P8", "PO4", "O2", "Fz", "Cz",
]
N_EEG = 32
NESTED_KEEP_CHANNELS = 14


def wide_csv_schema(channels: Sequence[str], time_col: str = "time") -> T.StructType:
    return T.StructType([T.StructField(time_col, T.DoubleType())] +
                        [T.StructField(c, T.DoubleType()) for c in channels])


def csv_headers(spark: SparkSession, path: str) -> dict[tuple[str, ...], list[str]]:
    """Files of a folder by their header (the first line with text): a row a
    file, then one group a layout."""
    import csv
    from urllib.parse import unquote

    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"))
    first = lines.where(F.trim("value") != "").withColumn("_n", F.monotonically_increasing_id()) \
        .groupBy("_file").agg(F.min_by("value", F.struct("_start", "_n")).alias("_header"))
    out: dict[tuple[str, ...], list[str]] = {}
    for r in first.groupBy("_header").agg(F.collect_list("_file").alias("_files")).collect():  # a row a layout, with its paths
        names = tuple(c.strip() for c in next(csv.reader([r["_header"].lstrip("\ufeff").rstrip("\r")])))
        out.setdefault(names, []).extend(map(unquote, r["_files"]))
    return out


def read_wide_csv(spark: SparkSession, path: str, channels: Sequence[str], extra: Sequence[T.StructField] = (),
                  time_col: str = "time", missing: str = "raise") -> DataFrame:
    """Wide recording CSV (a time column named ``time`` or ``timestamp`` plus
    one column per channel) -> long (extra..., time, channel, value).

    Files may order their columns differently and quote cells: they are grouped
    by header, and Spark's own CSV reader scans each group once with the columns
    of that header.  A file whose header has no time column ends the read with
    an error that names it (``missing="skip"`` leaves such files out).  A channel
    that a file lacks has no samples there, and neither has an empty cell; a
    cell that does not parse stays as a row with a null value, so sample numbers
    keep their places (``bad_cells`` counts them)."""
    headers = csv_headers(spark, path)
    names_time = lambda h: next((c for c in (time_col, "timestamp") if c in h), None)
    lacking = sorted(f for h, files in headers.items() if names_time(h) is None for f in files)
    if lacking and missing == "raise":
        raise ValueError(f"{len(lacking)} files without a {time_col!r} column, first {lacking[:5]}")
    ids = [f.name for f in extra] + ["time"]
    out = spark.createDataFrame([], T.StructType([*extra, T.StructField("time", T.DoubleType()), T.StructField("channel", T.StringType()),
                                                  T.StructField("value", T.DoubleType())]))
    for header, files in sorted(headers.items()):
        if names_time(header) is None:
            continue
        schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(header))])
        rows = spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").option("escape", '"').csv(files)
        cell = lambda name, h=header: F.trim(F.col(f"c{h.index(name)}")) if name in h else F.lit(None).cast("string")
        here = [c for c in channels if c in header]
        if not here:
            continue
        wide = rows.select(*[cell(f.name).try_cast(f.dataType).alias(f.name) for f in extra], cell(names_time(header)).try_cast("double").alias("time"),
                           *[cell(c).alias(c) for c in here])
        long = wide.unpivot(ids, here, "channel", "_raw").where(F.col("_raw") != "")
        out = out.unionByName(long.select(*ids, "channel", F.col("_raw").try_cast("double").alias("value")))
    return out


def bad_cells(long: DataFrame) -> DataFrame:
    """Rows per channel whose cell did not parse (value null)."""
    return long.groupBy("channel").agg(F.count_if(F.col("value").isNull()).alias("n_bad"))


def trial_channels(trials: DataFrame, data: str = "data", keys: Sequence[str] = ("subject_id", "trial_id"),
                   n_eeg: int = N_EEG, names: Sequence[str] = TRIAL_EEG_CHANNELS) -> DataFrame:
    """Trial tensor rows (keys..., data array<array<double>> channel-major) ->
    one row per channel: channel_idx, kind ('eeg' for index < n_eeg, else
    'peripheral'), channel name (EEG only), values."""
    name_arr = F.array(*[F.lit(n) for n in names])
    x = trials.select(*keys, F.posexplode(data).alias("channel_idx", "values"))
    return x.select(*keys, "channel_idx",
                    F.when(F.col("channel_idx") < n_eeg, "eeg").otherwise("peripheral").alias("kind"),
                    F.when(F.col("channel_idx") < n_eeg, F.element_at(name_arr, F.col("channel_idx") + 1))
                    .alias("channel"), "values")


def nested_trials(df: DataFrame, data: str = "eeg", keys: Sequence[str] = ("subject_id", "trial_id"),
                  keep: int = NESTED_KEEP_CHANNELS) -> DataFrame:
    """Variable-length 2-D trial arrays, stored either channels x samples or
    samples x channels (the longer axis is time) -> long
    (keys..., channel_idx, sample_idx, value), first ``keep`` channels.  A trial
    that is missing, empty or not rectangular is skipped."""
    widths = F.array_distinct(F.transform(data, lambda r: F.coalesce(F.size(r), F.lit(-1))))
    df = df.where(F.col(data).isNotNull() & (F.size(widths) == 1) & (F.get(widths, F.lit(0)) > 0))
    rows = df.select(*keys, F.posexplode(data).alias("_r", "_row"),
                     (F.size(data) > F.size(F.element_at(data, 1))).alias("_t"))
    cells = rows.select(*keys, "_r", "_t", F.posexplode("_row").alias("_c", "value"))
    ch = F.when(F.col("_t"), F.col("_c")).otherwise(F.col("_r"))
    smp = F.when(F.col("_t"), F.col("_r")).otherwise(F.col("_c"))
    out = cells.select(*keys, ch.cast("int").alias("channel_idx"), smp.cast("long").alias("sample_idx"),
                       F.col("value").cast("double").alias("value"))
    return out.where(F.col("channel_idx") < keep)


def before_broken_trials(df: DataFrame, broken: F.Column, subject: str = "subject_id", trial: str = "trial_id") -> DataFrame:
    """Trials of each subject up to its first broken one (for example without
    ratings): the rest of that subject is left out."""
    first = df.where(broken).groupBy(subject).agg(F.min(trial).alias("_first"))
    return df.join(first, subject, "left").where(F.col("_first").isNull() | (F.col(trial) < F.col("_first"))).drop("_first")


def list_files(spark: SparkSession, root: str, glob: str = "*", recursive: bool = True) -> DataFrame:
    """(path, length, modificationTime) of files under root; content is not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob) \
        .option("recursiveFileLookup", str(recursive).lower()).load(root) \
        .select("path", "length", "modificationTime")


def pair_sessions(paths: DataFrame, path: str = "path", signal_ext: str = ".bdf",
                  annotation_ext: str = ".xml") -> DataFrame:
    """Per session folder (its full path): the first signal file and the first
    annotation file; folders lacking either, and hidden ones, are skipped.
    Output (session = the folder's name, signal_path, annotation_path)."""
    folder = F.regexp_extract(F.col(path), r"^(.*)/[^/]+$", 1)
    ext = F.lower(F.regexp_extract(F.col(path), r"(\.[^./]*)$", 1))
    p = paths.select(folder.alias("_f"), ext.alias("_ext"), F.col(path).alias("_p"))
    first = lambda e: F.min(F.when(F.col("_ext") == e, F.col("_p")))
    per = p.groupBy("_f").agg(first(signal_ext).alias("signal_path"), first(annotation_ext).alias("annotation_path"))
    named = per.select(F.regexp_extract("_f", r"([^/]+)$", 1).alias("session"), "signal_path", "annotation_path")
    return named.where(F.col("signal_path").isNotNull() & F.col("annotation_path").isNotNull() & ~F.startswith("session", F.lit(".")))


def _ratings_of(document: str | None) -> tuple[float | None, float | None]:
    """(arousal, valence) of one document; both null if it does not parse, lacks
    one of them, or one of its ratings is no number."""
    from xml.etree import ElementTree

    def last(texts: list[str | None], blank: bool) -> float | None:
        """The last rating; each must be a number (``blank``: or empty)."""
        values = [None if blank and not t else float(t or "") for t in texts]
        return values[-1] if values else None

    try:
        tags = [(e.tag, e.text) for e in ElementTree.fromstring(document or "").iter()]
        felt = [last([t for name, t in tags if name == own], False) for own in ("feltArsl", "feltVlnc")]
        if None in felt:
            alike = [[t for name, t in tags if part in name.lower()] for part in ("arousal", "valence")]
            felt = [last(a, True) if a else f for a, f in zip(alike, felt, strict=True)]
    except (ElementTree.ParseError, ValueError):
        return None, None
    return (None, None) if None in felt else (felt[0], felt[1])


def xml_ratings(df: DataFrame, xml: str = "xml", key: str = "session_id") -> DataFrame:
    """Arousal = last <feltArsl>, valence = last <feltVlnc>, wherever they stand;
    when either is missing, any tag whose lower-cased name contains 'arousal' /
    'valence' (last one wins).  Documents go through an XML parser, so
    attributes, comments, entities and CDATA mean what they should; one that does
    not parse, or a rating that is no number, gives no row."""
    @F.pandas_udf("arousal double, valence double")
    def ratings(documents: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_ratings_of(d) for d in documents], columns=["arousal", "valence"], dtype="float64")

    out = df.select(key, ratings(F.col(xml)).alias("_r")).select(key, "_r.arousal", "_r.valence")
    return out.where(F.col("arousal").isNotNull() & F.col("valence").isNotNull())


def file_admission(paths: DataFrame, path: str = "path",
                   allowed: Sequence[str] = tuple(config.ADMITTED_EXTENSIONS)) -> tuple[DataFrame, DataFrame]:
    """(admitted, rejected): lower-cased last extension in the allowed list."""
    ext = F.lower(F.regexp_extract(F.col(path), r"(\.[^./]*)$", 1))
    tagged = paths.withColumn("ext", ext).withColumn("admitted", F.col("ext").isin(list(allowed)))
    return tagged.where("admitted"), tagged.where(~F.col("admitted"))


UPLOAD_SCHEMA = T.StructType([
    T.StructField("filename", T.StringType()),
    T.StructField("channels", T.ArrayType(T.StringType())),
    T.StructField("sampling_rate", T.IntegerType()),
    T.StructField("duration_sec", T.DoubleType()),
    T.StructField("num_samples", T.LongType()),
    T.StructField("signals", T.ArrayType(T.ArrayType(T.DoubleType()))),
])


def explode_upload(msgs: DataFrame) -> DataFrame:
    """Upload message -> one row per channel: (filename, channel, sampling_rate,
    n_samples, duration_sec = n / sampling_rate, values)."""
    z = msgs.select("filename", "sampling_rate", F.explode(F.arrays_zip("channels", "signals")).alias("_z"))
    return z.select("filename", F.col("_z.channels").alias("channel"), "sampling_rate",
                    F.size("_z.signals").cast("long").alias("n_samples"),
                    (F.size("_z.signals") / F.col("sampling_rate")).alias("duration_sec"),
                    F.col("_z.signals").alias("values"))


def read_partitioned(spark: SparkSession, path: str, **equals) -> DataFrame:
    """Parquet dataset partitioned by columns; equality filters on partition
    columns prune directories before any file is opened."""
    df = spark.read.parquet(path)
    for k, v in equals.items():
        df = df.where(F.col(k) == F.lit(v))
    return df


def read_subjects(spark: SparkSession, path: str, subjects: Sequence[int], col: str = "subject_id") -> DataFrame:
    """Rows of the requested subjects from a subject-partitioned dataset; absent
    subjects contribute nothing.  Fails when none of them is present."""
    df = spark.read.parquet(path).where(F.col(col).isin(list(subjects)))
    if df.limit(1).count() == 0:
        raise ValueError(f"no data for subjects {list(subjects)[:5]}... under {path}")
    return df


# ---------------------------------------------------------------- registry of dataset readers

READERS: dict[str, Callable[..., DataFrame]] = {
    "trial_tensor": trial_channels,
    "nested_trials": nested_trials,
    "wide_csv": read_wide_csv,
    "upload_json": explode_upload,
}


def dataset(name: str) -> dict:
    """Threshold, rating scale, channels and rate of a dataset; unknown names raise."""
    try:
        return dict(config.DATASETS[name])
    except KeyError:
        raise ValueError(f"unknown dataset {name!r}; known: {sorted(config.DATASETS)}") from None


def get_reader(name: str) -> Callable[..., DataFrame]:
    try:
        return READERS[name]
    except KeyError:
        raise ValueError(f"unknown dataset reader {name!r}; known: {sorted(READERS)}") from None
