"""Source and sink queries: files are written from the driver's tables into
the shared scratch folder, then read back through the readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from neurotab import fixtures as fx
from neurotab.operators.evaluation import per_class_metrics
from neurotab.operators.labels import anxiety_label, subject_id_from_folder
from neurotab.sources import readers as rd
from neurotab.sources import writers as wr
from neurotab.plans.common import rounded
from neurotab.plans.q_evaluation import PC_CTES
from neurotab.plans.oracle_views import sql
from neurotab.plans.registry import register
from neurotab.session import scratch_path


@register("scan_wide_unpivot", sql(["samples_big"], """SELECT recording_id, sample_idx / 128.0 AS time, channel, value
FROM samples_big"""))
def q_scan_wide_unpivot(spark, sf_dir):
    """samples_big pivoted to one CSV column per channel (as recordings are
    stored), written, scanned with an explicit schema and unpivoted back."""
    long = fx.samples_big(spark, sf_dir)
    wide = long.groupBy("recording_id", (F.col("sample_idx") / 128.0).alias("time")) \
        .pivot("channel", ["A", "N", "R"]).agg(F.first("value"))
    path = scratch_path(spark, "wide_csv")
    wide.write.option("header", True).csv(path)
    from pyspark.sql import types as T
    return rd.read_wide_csv(spark, path, ["A", "N", "R"], extra=[T.StructField("recording_id", T.LongType())])


@register("scan_wide_layouts", sql(["samples_big"], """SELECT recording_id, sample_idx / 128.0 AS time, channel, value
FROM samples_big"""))
def q_scan_wide_layouts(spark, sf_dir):
    """The same recordings in files of two layouts: other column orders, another
    time column, and a quoted text column with commas and quotes between them."""
    from pyspark.sql import types as T

    long = fx.samples_big(spark, sf_dir)
    wide = long.groupBy("recording_id", (F.col("sample_idx") / 128.0).alias("time")).pivot("channel", ["A", "N", "R"]).agg(F.first("value")) \
        .withColumn("note", F.concat(F.lit('cell "x, y", '), F.col("recording_id").cast("string")))
    path = scratch_path(spark, "wide_layouts")
    odd = F.col("recording_id") % 2 == 1
    save = lambda df, name: df.write.option("header", True).option("escape", '"').csv(f"{path}/{name}")
    save(wide.where(odd).select("time", "A", "note", "N", "R", "recording_id"), "layout=1")
    save(wide.where(~odd).select("R", "recording_id", "note", F.col("time").alias("timestamp"), "N", "A"), "layout=2")
    return rd.read_wide_csv(spark, path, ["A", "N", "R"], extra=[T.StructField("recording_id", T.LongType())])


def _trial_tensors(spark, sf_dir):
    """40 consecutive embeddings form one 40-channel trial (64 samples each)."""
    emb = fx.table(spark, sf_dir, "embeddings")
    t = emb.select((F.col("vec_id") / 40).cast("long").alias("trial_id"), (F.col("vec_id") % 40).alias("_c"),
                   F.col("embedding").cast("array<double>").alias("_v"))
    return t.groupBy("trial_id").agg(F.array_sort(F.collect_list(F.struct("_c", "_v"))).alias("_s")) \
        .select("trial_id", F.col("_s._v").alias("data"))


@register("trial_channel_split", sql(["ratings"], """SELECT CAST(floor(vec_id / 40) AS BIGINT) AS trial_id, CAST(vec_id % 40 AS INT) AS channel_idx,
       CASE WHEN vec_id % 40 < 32 THEN 'eeg' ELSE 'peripheral' END AS kind,
       CASE WHEN vec_id % 40 < 32 THEN list_extract(""" + "['" + "', '".join(rd.TRIAL_EEG_CHANNELS) + """'], CAST(vec_id % 40 AS INT) + 1) END AS channel,
       CAST(len(embedding) AS INT) AS n_samples, round(CAST(embedding[1] AS DOUBLE), 6) AS first_value,
       round(list_sum(list_transform(list_zip(range(1, len(embedding) + 1), embedding), lambda p: p[1] * CAST(p[2] AS DOUBLE))), 5) AS weighted_sum, r.valence, r.arousal
FROM embeddings e JOIN ratings r ON r.trial_id = CAST(floor(e.vec_id / 40) AS BIGINT)"""))
def q_trial_channel_split(spark, sf_dir):
    ch = rd.trial_channels(_trial_tensors(spark, sf_dir), keys=["trial_id"])
    r = fx.ratings(spark, sf_dir).select("trial_id", "valence", "arousal")
    out = ch.join(r, "trial_id")
    return out.select("trial_id", F.col("channel_idx").cast("int").alias("channel_idx"), "kind", "channel",
                      F.size("values").alias("n_samples"), F.round(F.col("values")[0], 6).alias("first_value"),
                      # every sample and its place counts
                      F.round(F.aggregate(F.transform("values", lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v), 5)
                      .alias("weighted_sum"),
                      "valence", "arousal")


@register("nested_trials_explode", sql([], """SELECT vec_id % 23 AS subject_id, vec_id AS trial_id,
       CAST(CASE WHEN vec_id % 2 = 0 THEN pos // 16 ELSE pos % 4 END AS INT) AS channel_idx,
       CAST(CASE WHEN vec_id % 2 = 0 THEN pos % 16 ELSE pos // 4 END AS BIGINT) AS sample_idx,
       round(CAST(x AS DOUBLE), 6) AS value
FROM (SELECT vec_id, unnest(embedding) AS x, unnest(generate_series(0, 63)) AS pos FROM embeddings)"""))
def q_nested_trials_explode(spark, sf_dir):
    """Each embedding as a 2-D trial: 4 channels x 16 samples for even ids,
    16 samples x 4 channels (time on the longer axis) for odd ids."""
    emb = fx.table(spark, sf_dir, "embeddings")
    e = F.col("embedding").cast("array<double>")
    ch_major = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda c: F.slice(e, c * 16 + 1, 16))
    time_major = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda r: F.slice(e, r * 4 + 1, 4))
    df = emb.select((F.col("vec_id") % 23).alias("subject_id"), F.col("vec_id").alias("trial_id"),
                    F.when(F.col("vec_id") % 2 == 0, ch_major).otherwise(time_major).alias("eeg"))
    return rounded(rd.nested_trials(df))


@register("session_pairing", sql(["sessions"], """SELECT s.session, s.signal_path, a.annotation_path
FROM (SELECT regexp_extract(path, '([^/]+)/[^/]+$', 1) AS session, min(path) AS signal_path FROM sessions
      WHERE lower(regexp_extract(path, '(\\.[^./]*)$', 1)) = '.bdf' GROUP BY 1) s
JOIN (SELECT regexp_extract(path, '([^/]+)/[^/]+$', 1) AS session, min(path) AS annotation_path FROM sessions
      WHERE lower(regexp_extract(path, '(\\.[^./]*)$', 1)) = '.xml' GROUP BY 1) a ON a.session = s.session"""))
def q_session_pairing(spark, sf_dir):
    return rd.pair_sessions(fx.sessions(spark, sf_dir))


XML_SQL = """SELECT session_id, arousal, valence FROM (
  SELECT session_id,
         TRY_CAST(list_extract(regexp_extract_all(xml, '<feltArsl>([^<]*)</', 1), -1) AS DOUBLE) AS arousal,
         TRY_CAST(list_extract(regexp_extract_all(xml, '<feltVlnc>([^<]*)</', 1), -1) AS DOUBLE) AS valence
  FROM xml_docs) WHERE arousal IS NOT NULL AND valence IS NOT NULL"""


@register("xml_ratings", sql(["xml_docs"], XML_SQL))
def q_xml_ratings(spark, sf_dir):
    return rd.xml_ratings(fx.xml_docs(spark, sf_dir))


@register("xml_rating_cases", sql([], """SELECT c_custkey AS session_id, CASE WHEN c_custkey % 9 = 2 THEN 1.0::DOUBLE ELSE (1 + c_nationkey % 9)::DOUBLE END AS arousal,
       (1 + c_custkey % 9)::DOUBLE AS valence FROM customer WHERE c_custkey % 9 IN (0, 1, 2, 3, 7)"""))
def q_xml_rating_cases(spark, sf_dir):
    """Attributes, nesting, comments, entities, CDATA, other names; broken documents give no row."""
    return rd.xml_ratings(fx.xml_cases(spark, sf_dir))


PAIRS_SQL = """SELECT CAST(replace(replace(split_part(s.session, '_', 1), 'Part', ''), 'P', '') AS INT) AS session_id,
       s.signal_path, a.annotation_path
FROM (SELECT regexp_extract(path, '([^/]+)/[^/]+$', 1) AS session, min(path) AS signal_path FROM sessions
      WHERE lower(regexp_extract(path, '(\\.[^./]*)$', 1)) = '.bdf' GROUP BY 1) s
JOIN (SELECT regexp_extract(path, '([^/]+)/[^/]+$', 1) AS session, min(path) AS annotation_path FROM sessions
      WHERE lower(regexp_extract(path, '(\\.[^./]*)$', 1)) = '.xml' GROUP BY 1) a ON a.session = s.session"""


def _pairs(spark, sf_dir):
    p = rd.pair_sessions(fx.sessions(spark, sf_dir))
    return p.select(subject_id_from_folder(F.col("session")).alias("session_id"), "signal_path", "annotation_path")


@register("signals_with_labels", sql(["sessions", "xml_docs"], """SELECT p.session_id, p.signal_path, x.arousal, x.valence,
       CASE WHEN x.arousal >= 5 AND x.valence < 5 THEN 2 WHEN x.arousal < 5 AND x.valence >= 5 THEN 0 ELSE 1 END AS label
FROM pairs p JOIN xr x ON CAST(x.session_id AS BIGINT) = CAST(p.session_id AS BIGINT)""", [("pairs", PAIRS_SQL), ("xr", XML_SQL)]))
def q_signals_with_labels(spark, sf_dir):
    """Sessions paired with their annotation ratings (inner: unlabelled
    sessions are left out) and the 3-level label at threshold 5."""
    x = rd.xml_ratings(fx.xml_docs(spark, sf_dir)).select(
        F.col("session_id").cast("long").alias("_sid"), "arousal", "valence", F.lit("MAHNOB").alias("dataset"))
    p = _pairs(spark, sf_dir)
    j = p.join(x, p["session_id"].cast("long") == x["_sid"])
    return anxiety_label(j).select("session_id", "signal_path", "arousal", "valence", "label")


@register("sessions_without_labels", sql(["sessions", "xml_docs"], """SELECT p.session_id, p.signal_path FROM pairs p
WHERE NOT EXISTS (SELECT 1 FROM xr x WHERE CAST(x.session_id AS BIGINT) = CAST(p.session_id AS BIGINT))""",
                                         [("pairs", PAIRS_SQL), ("xr", XML_SQL)]))
def q_sessions_without_labels(spark, sf_dir):
    """Report of the paired sessions the inner join drops (left anti join)."""
    x = rd.xml_ratings(fx.xml_docs(spark, sf_dir))
    p = _pairs(spark, sf_dir)
    return p.join(x, p["session_id"].cast("long") == x["session_id"].cast("long"), "left_anti") \
        .select("session_id", "signal_path")


def _subject_dataset(spark, sf_dir):
    path = scratch_path(spark, "subjects")
    fx.feat(spark, sf_dir).write.partitionBy("subject_id").parquet(path)
    return path


@register("union_subjects", sql(["feat"], """SELECT subject_id, count(*) AS n_rows, count(DISTINCT id) AS n_trials
FROM feat WHERE subject_id BETWEEN 0 AND 29 GROUP BY 1"""))
def q_union_subjects(spark, sf_dir):
    """Subjects 0..29 requested from a subject-partitioned dataset (23 exist):
    absent subjects are skipped, partition pruning reads only the requested ones."""
    df = rd.read_subjects(spark, _subject_dataset(spark, sf_dir), list(range(30)))
    return df.groupBy(F.col("subject_id").cast("bigint").alias("subject_id")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("id").alias("n_trials"))


@register("dataset_availability", sql(["feat"], """SELECT 'feat' AS dataset, count(DISTINCT subject_id) AS n_subjects,
       count(DISTINCT subject_id) > 0 AS available FROM feat"""))
def q_dataset_availability(spark, sf_dir):
    """File listing (metadata only) of a written dataset: subjects with files."""
    files = rd.list_files(spark, _subject_dataset(spark, sf_dir), "*.parquet")
    subj = F.regexp_extract("path", r"subject_id=(\d+)", 1)
    return files.agg(F.countDistinct(subj).alias("n_subjects")).select(
        F.lit("feat").alias("dataset"), "n_subjects", (F.col("n_subjects") > 0).alias("available"))


@register("file_admission", sql(["sessions"], """SELECT path, lower(regexp_extract(path, '(\\.[^./]*)$', 1)) AS ext,
       lower(regexp_extract(path, '(\\.[^./]*)$', 1)) IN ('.csv', '.edf', '.bdf', '.dat') AS admitted FROM sessions"""))
def q_file_admission(spark, sf_dir):
    ok, rej = rd.file_admission(fx.sessions(spark, sf_dir))
    return ok.unionByName(rej).select("path", "ext", "admitted")


@register("upload_explode", sql(["epochs64"], """SELECT 'epoch_' || CAST(epoch_id AS VARCHAR) || '.json' AS filename, channel,
       128 AS sampling_rate, count(*) AS n_samples, count(*) / 128.0 AS duration_sec,
       round(sum(value), 6) AS total FROM epochs64 GROUP BY 1, 2"""))
def q_upload_explode(spark, sf_dir):
    """Upload messages (JSON lines, one per epoch) read with an explicit schema
    and exploded to one row per channel."""
    arr = fx.epochs64_arrays(spark, sf_dir)
    msgs = arr.groupBy("epoch_id").agg(F.array_sort(F.collect_list(F.struct("channel", "values"))).alias("_s")) \
        .select(F.concat(F.lit("epoch_"), F.col("epoch_id").cast("string"), F.lit(".json")).alias("filename"),
                F.col("_s.channel").alias("channels"), F.lit(128).alias("sampling_rate"),
                F.lit(0.5).alias("duration_sec"), F.lit(64).cast("long").alias("num_samples"),
                F.col("_s.values").alias("signals"))
    path = scratch_path(spark, "uploads")
    msgs.write.json(path)
    ex = rd.explode_upload(spark.read.schema(rd.UPLOAD_SCHEMA).json(path))
    return ex.select("filename", "channel", "sampling_rate", "n_samples", "duration_sec",
                     F.round(F.aggregate("values", F.lit(0.0), lambda a, b: a + b), 6).alias("total"))


@register("metrics_lookup", sql(["pred"], """SELECT model, class, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(f1, 6) AS f1, CAST(support AS BIGINT) AS support, round(specificity, 6) AS specificity, 'fixture' AS dataset
FROM pc3 WHERE model = 2""", PC_CTES))
def q_metrics_lookup(spark, sf_dir):
    """Per-class metrics stored partitioned by (model, dataset); the lookup of
    one (model, dataset) prunes to one directory."""
    pc = rounded(per_class_metrics(fx.pred(spark, sf_dir), ["model"])).withColumn("dataset", F.lit("fixture"))
    path = scratch_path(spark, "metrics")
    wr.write_partitioned(pc, path, ["model", "dataset"])
    got = rd.read_partitioned(spark, path, model=2, dataset="fixture")
    return got.select(F.col("model").cast("int").alias("model"), "class", "precision", "recall", "f1", "support",
                      "specificity", "dataset")


@register("catalog_list", sql(["history"], """SELECT run_id, epoch AS latest_epoch, val_loss, n
FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY epoch DESC) AS rn FROM history) WHERE rn = 1"""))
def q_catalog_list(spark, sf_dir):
    """Latest catalogue entry per key (runs of ``history``)."""
    h = fx.history(spark, sf_dir)
    last = h.groupBy("run_id").agg(F.max_by(F.struct("epoch", "val_loss", "n"), "epoch").alias("_l"))
    return last.select("run_id", F.col("_l.epoch").alias("latest_epoch"), "_l.val_loss", "_l.n")
