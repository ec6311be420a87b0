"""Feature merge, assembly, selection and scaling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from neurotab import config
from neurotab import fixtures as fx
from neurotab.operators import selection as se
from neurotab.operators import spectral as sp
from neurotab.operators.assemble import manual_vector, merge_features, ordered_positions
from neurotab.operators.features import epoch_features
from neurotab.operators.nonlinear import permutation_entropy
from neurotab.operators.time_features import TIME_FEATURES, time_features, to_feature_rows
from neurotab.plans import q_nonlinear, q_spectral, q_time
from neurotab.plans.common import rounded
from neurotab.plans.oracle_views import sql
from neurotab.plans.registry import register

K = ["epoch_id", "channel"]


@register("variance_threshold", sql(["feat"], """SELECT feature, round(var_pop(value), 6) AS variance, var_pop(value) > 0.01 AS keep
FROM feat GROUP BY 1"""))
def q_variance_threshold(spark, sf_dir):
    return rounded(se.variance_threshold(fx.feat(spark, sf_dir)))


ANOVA_CTE = ("anova", """SELECT feature, (sum(n * (m - g) * (m - g)) / (max(k) - 1)) / (sum(n * v) / (max(nn) - max(k))) AS f_score
FROM (SELECT feature, label, n, m, v, sum(n * m) OVER (PARTITION BY feature) / sum(n) OVER (PARTITION BY feature) AS g,
             sum(n) OVER (PARTITION BY feature) AS nn, count(*) OVER (PARTITION BY feature) AS k
      FROM (SELECT feature, label, count(*) AS n, avg(value) AS m, var_pop(value) AS v FROM src GROUP BY 1, 2))
GROUP BY 1""")


@register("anova_f", sql(["feat"], "SELECT feature, round(f_score, 6) AS f_score FROM anova",
                         [("src", "SELECT * FROM feat"), ANOVA_CTE]))
def q_anova_f(spark, sf_dir):
    return rounded(se.anova_f(fx.feat(spark, sf_dir)))


KBEST = """SELECT feature, round(f_score, 6) AS f_score, CAST(rk AS INT) AS rank, rk <= least(20, count(*) OVER ()) AS keep
FROM (SELECT *, row_number() OVER (ORDER BY CASE WHEN f_score IS NULL OR isnan(f_score) THEN 1 ELSE 0 END, f_score DESC, feature DESC) AS rk
      FROM anova)"""


@register("select_k_best", sql(["feat"], KBEST, [("src", "SELECT * FROM feat"), ANOVA_CTE]))
def q_select_k_best(spark, sf_dir):
    # fixture scaling: 64 features, so k = 20 in place of 200 (of ~600-1350)
    out = se.select_k_best(se.anova_f(fx.feat(spark, sf_dir)), k=20)
    return rounded(out.withColumn("rank", F.col("rank").cast("int")))


@register("select_apply", sql(["feat"], """SELECT f.id, f.feature, f.value FROM feat f
WHERE f.feature IN (SELECT feature FROM kb WHERE keep)""", [("src", "SELECT * FROM feat"), ANOVA_CTE, ("kb", KBEST)]))
def q_select_apply(spark, sf_dir):
    long = fx.feat(spark, sf_dir)
    return se.apply_selection(long, se.select_k_best(se.anova_f(long), k=20)).select("id", "feature", "value")


@register("select_fit_apply", sql(["feat"], """SELECT f.id, f.feature, f.value FROM feat f
WHERE f.feature IN (SELECT feature FROM kb WHERE keep)""", [
    ("vt", "SELECT feature FROM feat GROUP BY 1 HAVING var_pop(value) > 0.01"),
    ("src", "SELECT * FROM feat WHERE feature IN (SELECT feature FROM vt)"), ANOVA_CTE, ("kb", KBEST)]))
def q_select_fit_apply(spark, sf_dir):
    """Variance threshold then k-best, fitted on the labelled rows and applied.
    Fixture scaling: k = 20 of 64 features."""
    long = fx.feat(spark, sf_dir)
    fitted = se.fit_selector(long, k=20)
    return se.apply_selection(long, fitted).select("id", "feature", "value")


@register("standard_scale", sql(["feat"], """SELECT id, feature,
       round((value - avg(value) OVER (PARTITION BY feature))
             / CASE WHEN stddev_pop(value) OVER (PARTITION BY feature) = 0 THEN 1 ELSE stddev_pop(value) OVER (PARTITION BY feature) END, 6) AS value
FROM feat"""))
def q_standard_scale(spark, sf_dir):
    long = fx.feat(spark, sf_dir)
    return rounded(se.standard_scale_apply(long, se.standard_scale_fit(long)).select("id", "feature", "value"))


_TIME_ROWS = " UNION ALL ".join(
    f"SELECT epoch_id, channel || '_{f}' AS feature, {f} AS value, 0 AS stage FROM tf" for f in TIME_FEATURES)
MERGE_BODY = """SELECT epoch_id, feature, round(CASE WHEN v IS NULL OR isnan(v) OR isinf(v) THEN 0.0 ELSE v END, 6) AS value
FROM (SELECT epoch_id, feature, arg_max(value, stage) AS v FROM allrows GROUP BY 1, 2)"""
MERGE_CTES = q_time.TIME_CTES + [
    ("se", q_spectral.ENTROPY_SQL), ("sen", q_spectral.ENTROPY_NORM_SQL), ("pe", q_nonlinear.PERM_BODY),
    ("allrows", _TIME_ROWS + """
UNION ALL SELECT epoch_id, channel || '_spectral_entropy', spectral_entropy, 1 FROM se
UNION ALL SELECT epoch_id, channel || '_spectral_entropy', spectral_entropy_norm, 2 FROM sen
UNION ALL SELECT epoch_id, channel || '_permutation_entropy', permutation_entropy, 2 FROM pe"""),
]


@register("feature_merge", sql(["epochs64", "psd64"], MERGE_BODY, MERGE_CTES))
def q_feature_merge(spark, sf_dir):
    """Time (stage 0), spectral entropy (stage 1) and normalised spectral entropy +
    permutation entropy (stage 2): the later stage wins the shared name."""
    long = fx.epochs64(spark, sf_dir)
    psd = q_spectral.psd64(spark, sf_dir)
    t = to_feature_rows(time_features(long, K), ["epoch_id"], "channel", TIME_FEATURES, 0)
    s = sp.spectral_summary(psd, K)
    s1 = to_feature_rows(s.select(*K, F.round("spectral_entropy", 6).alias("spectral_entropy")),
                         ["epoch_id"], "channel", ["spectral_entropy"], 1)
    s2 = to_feature_rows(s.select(*K, F.round("spectral_entropy_norm", 6).alias("spectral_entropy")),
                         ["epoch_id"], "channel", ["spectral_entropy"], 2)
    pe = to_feature_rows(permutation_entropy(long, K).select(*K, F.round("permutation_entropy", 6)
                                                             .alias("permutation_entropy")),
                         ["epoch_id"], "channel", ["permutation_entropy"], 2)
    return rounded(merge_features([t, s1, s2, pe], ["epoch_id"]))


@register("assemble_vector", sql(["epochs64"], """SELECT epoch_id, CAST(row_number() OVER (PARTITION BY epoch_id ORDER BY feature) - 1 AS INT) AS position,
       feature, round(coalesce(value, 0), 6) AS value
FROM (""" + _TIME_ROWS.replace(", 0 AS stage", "") + ")", q_time.TIME_CTES))
def q_assemble_vector(spark, sf_dir):
    long = fx.epochs64(spark, sf_dir)
    t = to_feature_rows(time_features(long, K), ["epoch_id"], "channel", TIME_FEATURES, 0)
    from neurotab.operators.time_features import scrub
    t = t.withColumn("value", scrub(F.col("value")))
    return rounded(ordered_positions(t, ["epoch_id"]))


@register("manual_vector", sql(["feat"], """SELECT f.id, CAST(p.range AS INT) AS position, coalesce(x.value, 0.0) AS value
FROM (SELECT DISTINCT id FROM feat) f CROSS JOIN range(0, 64) p
LEFT JOIN feat x ON x.id = f.id AND x.feature = p.range AND x.feature % 8 < 5"""))
def q_manual_vector(spark, sf_dir):
    """Requests carry a name->value map with five of every eight names; the
    vector takes the fixed sorted name list and fills absent names with 0."""
    long = fx.feat(spark, sf_dir).where(F.col("feature") % 8 < 5)
    req = long.groupBy("id").agg(F.map_from_entries(F.collect_list(
        F.struct(F.format_string("f%02d", "feature"), F.col("value")))).alias("features"))
    names = [f"f{i:02d}" for i in range(64)]
    v = manual_vector(req, names)
    return v.select("id", F.posexplode("vector").alias("position", "value"))


def feature_ctes() -> list[tuple[str, str]]:
    """CTEs of every feature of every epochs64 epoch in DuckDB, from the
    per-operator texts; the last is ``features64`` (epoch_id, feature, value)."""
    from neurotab.plans import q_nonlinear as qn
    bands_abs = " UNION ALL ".join(
        f"SELECT epoch_id, channel || '_{b}_abs_power', sum(CASE WHEN freq BETWEEN {lo} AND {hi} THEN power ELSE 0 END), 1 FROM psd64 GROUP BY 1, channel"
        for b, lo, hi in config.BANDS)
    bands_rel = " UNION ALL ".join(
        f"SELECT epoch_id, channel || '_{b}_rel_power', sum(CASE WHEN freq BETWEEN {lo} AND {hi} THEN power ELSE 0 END) / greatest(sum(power), 1e-20), 1 FROM psd64 GROUP BY 1, channel"
        for b, lo, hi in config.BANDS)
    rows = [
        _TIME_ROWS,
        bands_abs, bands_rel,
        "SELECT epoch_id, channel || '_alpha_beta_ratio', alpha_beta_ratio, 1 FROM ratios",
        "SELECT epoch_id, channel || '_theta_alpha_ratio', theta_alpha_ratio, 1 FROM ratios",
        "SELECT epoch_id, channel || '_spectral_entropy', spectral_entropy, 1 FROM se",
        "SELECT epoch_id, channel || '_mean_frequency', mean_frequency, 1 FROM cen",
        "SELECT epoch_id, channel || '_median_frequency', median_frequency, 1 FROM med",
        "SELECT epoch_id, channel || '_dwt_energy_' || band, dwt_energy, 1 FROM dwtee",
        "SELECT epoch_id, channel || '_dwt_entropy_' || band, dwt_entropy, 1 FROM dwtee",
        "SELECT epoch_id, pair, asymmetry, 1 FROM faa",
        "SELECT epoch_id, channel || '_permutation_entropy', permutation_entropy, 2 FROM pe",
        "SELECT epoch_id, channel || '_higuchi_fd', higuchi_fd, 2 FROM hig",
        "SELECT epoch_id, channel || '_dfa', dfa, 2 FROM dfa",
        "SELECT epoch_id, channel || '_spectral_entropy', spectral_entropy_norm, 2 FROM sen",
        "SELECT epoch_id, channel || '_hjorth_fd', hjorth_fd, 2 FROM tf",
        "SELECT epoch_id, channel || '_sample_entropy', sample_entropy, 2 FROM sampen",
        "SELECT epoch_id, channel || '_approx_entropy', approx_entropy, 2 FROM apen",
    ]
    unrounded = lambda body: body.replace("round(", "(").replace(", 6) AS", ") AS")
    ctes = q_time.TIME_CTES + qn.DWT_CTES + qn.TPL_CTES + qn.DFA_CTES + [
        ("ratios", unrounded(q_spectral.RATIO_SQL)),
        ("se", unrounded(q_spectral.ENTROPY_SQL)), ("sen", unrounded(q_spectral.ENTROPY_NORM_SQL)),
        ("cen", unrounded(q_spectral.CENTROID_SQL)), ("med", q_spectral.MEDIAN_SQL),
        ("dwtee", """SELECT c.epoch_id, c.channel, c.band, sum(c.coef * c.coef) AS dwt_energy,
       -sum(CASE WHEN abs(c.coef) > 0 THEN abs(c.coef) / s.s * log2(abs(c.coef) / s.s) END) AS dwt_entropy
FROM coef c JOIN (SELECT epoch_id, channel, band, sum(abs(coef)) AS s FROM coef GROUP BY 1, 2, 3) s
  ON c.epoch_id = s.epoch_id AND c.channel = s.channel AND c.band = s.band GROUP BY 1, 2, 3"""),
        ("alpha", "SELECT epoch_id, channel, sum(CASE WHEN freq BETWEEN 8 AND 13 THEN power ELSE 0 END) AS a FROM psd64 GROUP BY 1, 2"),
        ("pp", """SELECT l.epoch_id, 'frontal_asymmetry_' || fp.left_ch || '_' || fp.right_ch AS pair, fp.pair_ord,
       ln(greatest(r.a, 1e-20)) - ln(greatest(l.a, 1e-20)) AS asymmetry
FROM alpha l JOIN frontal_pairs fp ON l.channel = fp.left_ch JOIN alpha r ON r.epoch_id = l.epoch_id AND r.channel = fp.right_ch"""),
        ("faa", """SELECT epoch_id, pair, asymmetry FROM pp
UNION ALL SELECT epoch_id, 'frontal_alpha_asymmetry', arg_min(asymmetry, pair_ord) FROM pp GROUP BY 1"""),
        ("pe", unrounded(qn.PERM_BODY)), ("hig", unrounded(qn.HIGUCHI_BODY)), ("dfa", unrounded(qn.DFA_BODY)),
        ("sampen", unrounded(qn.SAMPEN_BODY)), ("apen", unrounded(qn.APEN_BODY)),
        ("allrows", " UNION ALL ".join(rows)),
        ("features64", """SELECT epoch_id, feature, CASE WHEN v IS NULL OR isnan(v) OR isinf(v) THEN 0.0 ELSE v END AS value
FROM (SELECT epoch_id, feature, arg_max(value, stage) AS v FROM allrows GROUP BY 1, 2)"""),
    ]
    return ctes


def _feature_matrix_oracle() -> str:
    return sql(["epochs64", "psd64", "frontal_pairs"], "SELECT epoch_id, feature, round(value, 6) AS value FROM features64", feature_ctes())


@register("feature_matrix", _feature_matrix_oracle())
def q_feature_matrix(spark, sf_dir):
    """Every feature of every epochs64 epoch (time, spectral, wavelet, asymmetry,
    nonlinear incl. kernel entropies), merged by stage and scrubbed."""
    return rounded(epoch_features(fx.epochs64(spark, sf_dir), ["epoch_id"], "channel", fs=128))
