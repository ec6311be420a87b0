"""Time-domain features on epochs64, labels and class statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from neurotab import fixtures as fx
from neurotab.operators import labels as lb
from neurotab.operators.time_features import TIME_FEATURES, scrub, time_features, to_feature_rows
from neurotab.plans.common import rounded
from neurotab.plans.oracle_views import sql
from neurotab.plans.registry import register

K = ["epoch_id", "channel"]

# one DuckDB text with every time feature, reused by the queries below
TIME_CTES = [
    ("d", """SELECT epoch_id, channel, sample_idx, value,
       value - lag(value) OVER w AS d1,
       CASE WHEN sign(value) <> lag(sign(value)) OVER w THEN 1 ELSE 0 END AS xing
FROM epochs64 WINDOW w AS (PARTITION BY epoch_id, channel ORDER BY sample_idx)"""),
    ("d2", """SELECT *, d1 - lag(d1) OVER (PARTITION BY epoch_id, channel ORDER BY sample_idx) AS d2,
       avg(value) OVER (PARTITION BY epoch_id, channel) AS mu FROM d"""),
    ("agg", """SELECT epoch_id, channel, avg(value) AS mean, var_pop(value) AS variance, stddev_pop(value) AS std,
       avg(power(value - mu, 3)) AS m3, avg(power(value - mu, 4)) AS m4,
       CAST(sum(xing) AS DOUBLE) / count(*) AS zero_crossing_rate, max(value) - min(value) AS peak_to_peak,
       sqrt(avg(value * value)) AS rms, var_pop(d1) AS vd1, var_pop(d2) AS vd2
FROM d2 GROUP BY 1, 2"""),
    ("tf", """SELECT epoch_id, channel, mean, variance, std,
       CASE WHEN variance > 0 THEN m3 / power(variance, 1.5) END AS skewness,
       CASE WHEN variance > 0 THEN m4 / (variance * variance) - 3 END AS kurtosis,
       zero_crossing_rate, peak_to_peak, variance AS hjorth_activity,
       CASE WHEN variance > 1e-10 THEN sqrt(vd1 / variance) ELSE 0 END AS hjorth_mobility,
       CASE WHEN vd1 > 1e-10 AND variance > 1e-10 AND sqrt(vd1 / variance) > 1e-10
            THEN sqrt(vd2 / vd1) / sqrt(vd1 / variance) ELSE 0 END AS hjorth_complexity,
       rms,
       CASE WHEN vd1 > 0 AND variance > 0 THEN sqrt(vd2 / vd1) / sqrt(vd1 / variance) END AS hjorth_fd
FROM agg"""),
]


def _tf(spark, sf_dir):
    return time_features(fx.epochs64(spark, sf_dir), K)


@register("time_moments", sql(["epochs64"], """SELECT epoch_id, channel, round(mean, 6) AS mean, round(variance, 6) AS variance,
       round(std, 6) AS std, round(coalesce(skewness, 0), 6) AS skewness, round(coalesce(kurtosis, 0), 6) AS kurtosis FROM tf""",
                                   TIME_CTES))
def q_time_moments(spark, sf_dir):
    t = _tf(spark, sf_dir)
    return rounded(t.select(*K, "mean", "variance", "std", scrub(F.col("skewness")).alias("skewness"),
                            scrub(F.col("kurtosis")).alias("kurtosis")))


@register("time_shape", sql(["epochs64"], """SELECT epoch_id, channel, round(peak_to_peak, 6) AS peak_to_peak, round(rms, 6) AS rms,
       round(zero_crossing_rate, 6) AS zero_crossing_rate FROM tf""", TIME_CTES))
def q_time_shape(spark, sf_dir):
    return rounded(_tf(spark, sf_dir).select(*K, "peak_to_peak", "rms", "zero_crossing_rate"))


@register("hjorth", sql(["epochs64"], """SELECT epoch_id, channel, round(hjorth_activity, 6) AS hjorth_activity,
       round(hjorth_mobility, 6) AS hjorth_mobility, round(hjorth_complexity, 6) AS hjorth_complexity,
       round(coalesce(hjorth_fd, 0), 6) AS hjorth_fd FROM tf""", TIME_CTES))
def q_hjorth(spark, sf_dir):
    t = _tf(spark, sf_dir)
    return rounded(t.select(*K, "hjorth_activity", "hjorth_mobility", "hjorth_complexity",
                            scrub(F.col("hjorth_fd")).alias("hjorth_fd")))


_UNPIVOT = " UNION ALL ".join(
    f"SELECT epoch_id, channel || '_{f}' AS feature, round(coalesce({f}, 0), 6) AS value FROM tf" for f in TIME_FEATURES)


@register("time_features", sql(["epochs64"], _UNPIVOT, TIME_CTES))
def q_time_features(spark, sf_dir):
    t = _tf(spark, sf_dir)
    long = to_feature_rows(t, ["epoch_id"], "channel", TIME_FEATURES)
    return long.select("epoch_id", "feature", F.round(scrub(F.col("value")), 6).alias("value"))


LABEL_BODY = """SELECT r.trial_id, r.subject_id, r.dataset, r.valence, r.arousal,
       CASE WHEN r.arousal >= t.t AND r.valence < t.t THEN 2 WHEN r.arousal < t.t AND r.valence >= t.t THEN 0 ELSE 1 END AS label
FROM ratings r JOIN (VALUES ('DEAP', 5.0), ('DREAMER', 2.5), ('MAHNOB', 5.0)) AS t(dataset, t) ON r.dataset = t.dataset"""


@register("anxiety_label", sql(["ratings"], LABEL_BODY))
def q_anxiety_label(spark, sf_dir):
    return lb.anxiety_label(fx.ratings(spark, sf_dir)).select(
        "trial_id", "subject_id", "dataset", "valence", "arousal", "label")


@register("class_counts", sql(["ratings"], """SELECT label, count(*) AS n, count(DISTINCT subject_id) AS n_subjects
FROM (""" + LABEL_BODY + ") GROUP BY 1"))
def q_class_counts(spark, sf_dir):
    return lb.class_counts(lb.anxiety_label(fx.ratings(spark, sf_dir)))


@register("subject_id_parse", sql(["sessions"], """SELECT path, CAST(replace(replace(split_part(split_part(path, '/', 3), '_', 1), 'Part', ''), 'P', '') AS INT) AS subject_id
FROM sessions"""))
def q_subject_id_parse(spark, sf_dir):
    s = fx.sessions(spark, sf_dir)
    folder = F.element_at(F.split("path", "/"), 3)
    return s.select("path", lb.subject_id_from_folder(folder).alias("subject_id"))


SCRUB_SRC = """SELECT id, feature, CASE WHEN feature = 0 AND id % 7 = 0 THEN 'NaN'::DOUBLE
                          WHEN feature = 1 AND id % 11 = 0 THEN 'inf'::DOUBLE
                          WHEN feature = 2 AND id % 13 = 0 THEN '-inf'::DOUBLE
                          WHEN feature = 3 AND id % 17 = 0 THEN NULL ELSE value END AS value FROM feat"""


@register("nonfinite_scrub", sql(["feat"], """SELECT id, feature, round(CASE WHEN isnan(value) OR isinf(value) OR value IS NULL THEN 0.0 ELSE value END, 6) AS value
FROM src""", [("src", SCRUB_SRC)]))
def q_nonfinite_scrub(spark, sf_dir):
    f = fx.feat(spark, sf_dir)
    v = F.when((F.col("feature") == 0) & (F.col("id") % 7 == 0), F.lit(float("nan"))) \
        .when((F.col("feature") == 1) & (F.col("id") % 11 == 0), F.lit(float("inf"))) \
        .when((F.col("feature") == 2) & (F.col("id") % 13 == 0), F.lit(float("-inf"))) \
        .when((F.col("feature") == 3) & (F.col("id") % 17 == 0), F.lit(None).cast("double")) \
        .otherwise(F.col("value"))
    return rounded(f.select("id", "feature", scrub(v).alias("value")))
