"""Streaming and end-to-end prediction queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from neurotab import fixtures as fx
from neurotab.learn import models as md
from neurotab.learn.predict import clean_epochs, feature_vectors, predict_manual, predict_signals, prediction_records, with_inputs
from neurotab.plans.common import rounded
from neurotab.plans.oracle_views import sql
from neurotab.plans.registry import register
from neurotab.session import scratch_path
from neurotab.streaming import jobs


@register("tumbling_features", sql([], """SELECT user_id AS recording_id, event_type AS channel,
       time_bucket(INTERVAL '1 day', ts) AS window_start, time_bucket(INTERVAL '1 day', ts) + INTERVAL '1 day' AS window_end,
       count(*) AS n, round(avg(value), 6) AS mean, round(var_pop(value), 6) AS variance, round(stddev_pop(value), 6) AS std,
       round(max(value) - min(value), 6) AS peak_to_peak, round(sqrt(avg(value * value)), 6) AS rms,
       round(coalesce(count_if(crossed), 0) / count(*), 6) AS zero_crossing_rate,
       round(coalesce(CASE WHEN var_pop(value) > 1e-10 THEN sqrt(var_pop(d1) / var_pop(value)) END, 0.0), 6) AS hjorth_mobility,
       round(coalesce(CASE WHEN var_pop(d1) > 1e-10 AND var_pop(value) > 1e-10 AND sqrt(var_pop(d1) / var_pop(value)) > 1e-10
             THEN sqrt(var_pop(d2) / var_pop(d1)) / sqrt(var_pop(d1) / var_pop(value)) END, 0.0), 6) AS hjorth_complexity
FROM (SELECT *, d1 - lag(d1) OVER w AS d2 FROM (
  SELECT user_id, event_type, ts, value, value - lag(value) OVER w AS d1, sign(value) <> lag(sign(value)) OVER w AS crossed
  FROM events WINDOW w AS (PARTITION BY user_id, event_type, time_bucket(INTERVAL '1 day', ts) ORDER BY ts, value))
  WINDOW w AS (PARTITION BY user_id, event_type, time_bucket(INTERVAL '1 day', ts) ORDER BY ts, value))
GROUP BY 1, 2, 3, 4"""))
def q_tumbling_features(spark, sf_dir):
    """Batch form of the streaming window job: 1-day tumbling windows per
    (recording, channel) of ``events`` (the streaming job uses the same
    transformation with a watermark)."""
    ev = fx.table(spark, sf_dir, "events").select(
        F.col("user_id").alias("recording_id"), F.col("event_type").alias("channel"), "ts", "value")
    return rounded(jobs.tumbling_features(ev, window="1 day"))


NAMES = ["F3_sample_entropy", "F4_hjorth_mobility"]
KEYS = ["recording_id", "epoch_id"]
CLEANING = {"epoch_size": 64, "baseline": 24}


def _signals(spark, sf_dir):
    """epochs64 as recordings of one 64-sample epoch each."""
    return fx.epochs64(spark, sf_dir).withColumnRenamed("epoch_id", "recording_id")


def _labels(spark, sf_dir):
    """The label of a recording is that of its first channel's row."""
    emb = fx.table(spark, sf_dir, "embeddings")
    return emb.where(F.col("vec_id") % 2 == 0).select(
        F.floor(F.col("vec_id") / 2).cast("long").alias("recording_id"), (F.col("label") % 3).alias("label"))


def _trained(spark, sf_dir):
    """Cleaned epochs, their features (all of them), and the path of a stored
    discriminant fitted on four fifths of the recordings; ``recording_id % 5 = 0``
    is held out."""
    from neurotab.operators.features import epoch_features

    epochs = clean_epochs(_signals(spark, sf_dir), "recording_id", **CLEANING)
    feats = epoch_features(epochs, KEYS, "channel", fs=128)
    train = feature_vectors(feats.where("recording_id % 5 != 0"), KEYS, NAMES)
    train = train.join(_labels(spark, sf_dir), F.col("id.recording_id") == F.col("recording_id")).select("id", "label", "features")
    path = scratch_path(spark, "scorer")
    md.save_scorer(with_inputs(md.fit_discriminant(train), train, NAMES), spark, path)
    return epochs, feats, path


def _flat(records):
    """Records with the names of their top features as one text."""
    return rounded(records.select(*[c for c in records.columns if c != "top_features"], F.array_join("top_features.feature", ",").alias("top_features"),
                                  F.get("top_features.attribution", F.lit(0)).alias("top_attribution")))


def _discriminant_ctes(every: str, train: str) -> list[tuple[str, str]]:
    """Two-feature discriminant: (id, x1, x2) of ``every`` scored by the fit on
    (label, x1, x2) of ``train``, with the weights and means of each class."""
    return [
        ("dm", f"SELECT label, avg(x1) AS m1, avg(x2) AS m2, CAST(count(*) AS DOUBLE) AS nc FROM {train} GROUP BY 1"),
        ("ds", f"""SELECT sum((x.x1 - m.m1) * (x.x1 - m.m1)) / (count(*) - 3) AS c11, sum((x.x1 - m.m1) * (x.x2 - m.m2)) / (count(*) - 3) AS c12,
       sum((x.x2 - m.m2) * (x.x2 - m.m2)) / (count(*) - 3) AS c22, CAST(count(*) AS DOUBLE) AS n, avg(x.x1) AS a1, avg(x.x2) AS a2
FROM {train} x JOIN dm m ON m.label = x.label"""),
        ("dw", """SELECT m.label, (s.c22 * m.m1 - s.c12 * m.m2) / (s.c11 * s.c22 - s.c12 * s.c12) AS w1,
       (s.c11 * m.m2 - s.c12 * m.m1) / (s.c11 * s.c22 - s.c12 * s.c12) AS w2, m.m1, m.m2, m.nc, s.n, s.a1, s.a2
FROM dm m, ds s"""),
        ("dd", f"""SELECT x.id, w.label, w.w1 * x.x1 + w.w2 * x.x2 - 0.5 * (w.w1 * w.m1 + w.w2 * w.m2) + ln(w.nc / w.n) AS d,
       w.w1 * (x.x1 - w.a1) AS t1, w.w2 * (x.x2 - w.a2) AS t2 FROM {every} x, dw w"""),
        ("de", "SELECT *, exp(d - max(d) OVER (PARTITION BY id)) AS e FROM dd"),
        ("dp", "SELECT *, e / sum(e) OVER (PARTITION BY id) AS p FROM de"),
        ("dr", """SELECT id, max(CASE WHEN label = 0 THEN p END) AS p0, max(CASE WHEN label = 1 THEN p END) AS p1,
       max(CASE WHEN label = 2 THEN p END) AS p2, arg_max(t1, (p, -label)) AS t1, arg_max(t2, (p, -label)) AS t2 FROM dp GROUP BY 1"""),
    ]


def _scored_columns(first: str, second: str) -> str:
    return f"""CASE WHEN p0 >= p1 AND p0 >= p2 THEN 'Low' WHEN p1 >= p2 THEN 'Moderate' ELSE 'High' END AS level,
       round(greatest(p0, p1, p2), 6) AS confidence, round(p0, 6) AS p_low, round(p1, 6) AS p_moderate, round(p2, 6) AS p_high, 'lda' AS model_used,
       CASE WHEN abs(t1) >= abs(t2) THEN '{first},{second}' ELSE '{second},{first}' END AS top_features,
       round(CASE WHEN abs(t1) >= abs(t2) THEN t1 ELSE t2 END, 6) AS top_attribution"""


def _record_oracle() -> str:
    """Cleaning, features, discriminant and record of the held-out recordings in DuckDB."""
    from neurotab import config
    from neurotab.operators.preprocess import cleaning_filters
    from neurotab.plans.oracle_views import VIEWS
    from neurotab.plans.q_features import feature_ctes
    from neurotab.plans.q_signal import filtfilt_ctes

    band, notch = cleaning_filters(128.0)
    keys = ("epoch_id", "channel")
    given = [("raw64", VIEWS["epochs64"]), *filtfilt_ctes(band, "raw64", keys, "bp_"), *filtfilt_ctes(notch, "bp_out", keys, "nt_")]
    given += [
        ("car", "SELECT epoch_id, channel, sample_idx, value - avg(value) OVER (PARTITION BY epoch_id, sample_idx) AS value FROM nt_out"),
        ("base", """SELECT epoch_id, channel, sample_idx,
       value - coalesce(avg(CASE WHEN sample_idx < 24 THEN value END) OVER (PARTITION BY epoch_id, channel), 0) AS value FROM car"""),
        ("epochs64", """SELECT epoch_id, channel, sample_idx, CASE WHEN sd > 1e-10 THEN (value - mu) / sd ELSE value - mu END AS value
FROM (SELECT *, avg(value) OVER (PARTITION BY epoch_id, channel) AS mu, stddev_pop(value) OVER (PARTITION BY epoch_id, channel) AS sd FROM base)"""),
    ]
    pick = lambda n: f"coalesce(max(CASE WHEN feature = '{n}' THEN value END), 0.0)"
    powers = ", ".join(f"max(CASE WHEN band = '{b}' THEN power END) AS {b}" for b, *_ in config.BANDS)
    ctes = [
        *feature_ctes(),
        ("fx", f"SELECT epoch_id AS id, {pick(NAMES[0])} AS x1, {pick(NAMES[1])} AS x2 FROM features64 GROUP BY 1"),
        ("ft", "SELECT f.*, e.label % 3 AS label FROM fx f JOIN embeddings e ON e.vec_id = 2 * f.id WHERE f.id % 5 <> 0"),
        *_discriminant_ctes("fx", "ft"),
        ("bm", """SELECT epoch_id, band, round(avg(p), 4) AS power FROM (
  SELECT p.epoch_id, p.channel, b.band, coalesce(avg(CASE WHEN p.freq BETWEEN b.low AND b.high THEN p.power END), 0.0) AS p
  FROM psd64 p CROSS JOIN bands b GROUP BY 1, 2, 3) GROUP BY 1, 2"""),
        ("bw", f"SELECT epoch_id, {powers} FROM bm GROUP BY 1"),
        ("fa", "SELECT epoch_id, asymmetry FROM faa WHERE pair = 'frontal_alpha_asymmetry'"),
    ]
    body = f"""SELECT dr.id AS recording_id, CAST(0 AS BIGINT) AS epoch_id, {_scored_columns(*NAMES)},
       {", ".join(f"bw.{b}" for b, *_ in config.BANDS)}, round(bw.alpha / greatest(bw.beta, 1e-10), 6) AS alpha_beta_ratio,
       round(coalesce(fa.asymmetry, 0.0), 6) + 0.0 AS frontal_asymmetry
FROM dr JOIN bw ON bw.epoch_id = dr.id LEFT JOIN fa ON fa.epoch_id = dr.id WHERE dr.id % 5 = 0"""
    return sql(["psd64", "frontal_pairs", "bands"], body, ctes, given)


@register("predict_batch", _record_oracle())
def q_predict_batch(spark, sf_dir):
    """Raw signals -> cleaning -> all features -> stored discriminant -> record,
    for recordings that the fit has not seen."""
    epochs, feats, path = _trained(spark, sf_dir)
    held = F.col("recording_id") % 5 == 0
    return _flat(prediction_records(epochs.where(held), KEYS, md.load_scorer(spark, path), fs=128, feats=feats.where(held)))


@register("stream_score", _record_oracle())
def q_stream_score(spark, sf_dir):
    """Upload messages of the held-out recordings arrive as JSON files; each
    micro-batch goes through the whole chain from raw signals, with the scorer
    loaded from its files (availableNow trigger)."""
    from neurotab.operators.preprocess import to_long
    from neurotab.sources.readers import UPLOAD_SCHEMA, explode_upload

    _, _, path = _trained(spark, sf_dir)
    arr = fx.epochs64_arrays(spark, sf_dir).where(F.col("epoch_id") % 5 == 0)
    msgs = arr.groupBy("epoch_id").agg(F.array_sort(F.collect_list(F.struct("channel", "values"))).alias("_s")) \
        .select(F.col("epoch_id").cast("string").alias("filename"), F.col("_s.channel").alias("channels"),
                F.lit(128).alias("sampling_rate"), F.lit(0.5).alias("duration_sec"),
                F.lit(64).cast("long").alias("num_samples"), F.col("_s.values").alias("signals"))
    src, out, ckpt = (scratch_path(spark, n) for n in ("stream_in", "stream_out", "stream_ckpt"))
    msgs.write.json(src)

    def score_batch(batch):
        rows = explode_upload(batch).select(F.col("filename").cast("long").alias("recording_id"), "channel", "values")
        return predict_signals(to_long(rows, ["recording_id", "channel"]), "recording_id", md.load_scorer(batch.sparkSession, path), fs=128, **CLEANING)

    q = jobs.start_scoring(spark, src, UPLOAD_SCHEMA, ckpt, out, score_batch)
    q.awaitTermination()
    return _flat(spark.read.parquet(out).drop("batch_id"))


@register("predict_manual", sql([], f"""SELECT id AS request_id, {_scored_columns("f0", "f1")} FROM dr""", [
    ("mt", "SELECT label % 3 AS label, CAST(embedding[1] AS DOUBLE) AS x1, CAST(embedding[2] AS DOUBLE) AS x2 FROM embeddings"),
    ("mx", """SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x1, CASE WHEN vec_id % 3 = 0 THEN 0.0 ELSE CAST(embedding[2] AS DOUBLE) END AS x2
FROM embeddings"""), *_discriminant_ctes("mx", "mt")]))
def q_predict_manual(spark, sf_dir):
    """Feature maps typed in by hand (every third lacks a name, which counts 0),
    scored by the discriminant on two features."""
    data = fx.feat_wide(spark, sf_dir).select("id", "label", F.slice("features", 1, 2).alias("features"))
    scorer = with_inputs(md.fit_discriminant(data), data, ["f0", "f1"])
    both = F.create_map(F.lit("f0"), F.get("features", F.lit(0)), F.lit("f1"), F.get("features", F.lit(1)))
    one = F.create_map(F.lit("f0"), F.get("features", F.lit(0)))
    requests = data.select(F.col("id").alias("request_id"), F.when(F.col("id") % 3 == 0, one).otherwise(both).alias("features"))
    return _flat(predict_manual(requests, scorer))


def _live_oracle() -> str:
    from neurotab.operators.preprocess import cleaning_filters
    from neurotab.plans.oracle_views import VIEWS
    from neurotab.plans.q_signal import cascade_cte

    band, _ = cleaning_filters(128.0)
    given = [("samples_big", VIEWS["samples_big"]),
             ("src", "SELECT recording_id, channel, sample_idx AS j, count(*) OVER (PARTITION BY recording_id, channel) AS nn, value AS e FROM samples_big"),
             ("fwd", cascade_cte(band, "fwd", "src", ("recording_id", "channel")))]
    return sql([], """SELECT recording_id, channel, CAST(floor(j / 32) AS BIGINT) AS epoch_id, CAST(j % 32 AS INT) AS pos, round(y, 6) AS value
FROM fwd WHERE floor(j / 32) < floor(nn / 32)""", given=given)


@register("live_epochs", _live_oracle())
def q_live_epochs(spark, sf_dir):
    """Samples of samples_big arrive in four files, each with a part of every
    signal (and the parts out of order); a stream filters them causally, carries
    the filter's state and tells epochs of 32."""
    from neurotab.operators.preprocess import cleaning_filters
    from neurotab.streaming.live import start_live

    band, _ = cleaning_filters(128.0)
    samples = fx.samples_big(spark, sf_dir)
    src, out, ckpt = (scratch_path(spark, n) for n in ("live_in", "live_out", "live_ckpt"))
    part = F.pmod(F.floor(F.col("sample_idx") / 48) + F.floor(F.col("sample_idx") / 7), F.lit(4))
    samples.withColumn("part", part).repartition(4, "part").drop("part").write.parquet(src)
    q = start_live(spark, src, samples.schema, ckpt, out, ["recording_id", "channel"], band, 32, files_per_batch=1)
    q.awaitTermination()
    return rounded(spark.read.parquet(out).select("recording_id", "channel", "epoch_id", F.posexplode("values").alias("pos", "value")))
