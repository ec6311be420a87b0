"""Probability shaping, ensembles, attributions and report views."""

from __future__ import annotations

from pyspark.sql import functions as F

from neurotab import config
from neurotab import fixtures as fx
from neurotab.operators import ensemble as en
from neurotab.operators import explain as ex
from neurotab.operators import views as vw
from neurotab.operators.evaluation import per_class_metrics
from neurotab.operators.ordering import sequence_index
from neurotab.plans import q_spectral
from neurotab.plans.common import rounded
from neurotab.plans.q_evaluation import PC_CTES
from neurotab.plans.oracle_views import sql
from neurotab.plans.registry import register

PROBS = ["p0", "p1", "p2"]


@register("softmax_argmax", sql(["pred"], """SELECT id, model, round(p0, 6) AS p0, round(p1, 6) AS p1, round(p2, 6) AS p2,
       CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS prediction,
       round(greatest(p0, p1, p2), 6) AS confidence
FROM (SELECT id, model, exp(s0 - mx) / (exp(s0 - mx) + exp(s1 - mx) + exp(s2 - mx)) AS p0,
             exp(s1 - mx) / (exp(s0 - mx) + exp(s1 - mx) + exp(s2 - mx)) AS p1,
             exp(s2 - mx) / (exp(s0 - mx) + exp(s1 - mx) + exp(s2 - mx)) AS p2
      FROM (SELECT *, greatest(s0, s1, s2) AS mx FROM pred))"""))
def q_softmax_argmax(spark, sf_dir):
    p = fx.pred(spark, sf_dir).select("id", "model", en.softmax(F.array("s0", "s1", "s2")).alias("_p"))
    return rounded(p.select("id", "model", *[F.col("_p")[i].alias(f"p{i}") for i in range(3)],
                            en.argmax(F.col("_p")).alias("prediction"), F.array_max("_p").alias("confidence")))


@register("one_hot", sql(["pred"], """SELECT id, model, CAST(y_pred = 0 AS INT) AS h0, CAST(y_pred = 1 AS INT) AS h1,
       CAST(y_pred = 2 AS INT) AS h2 FROM pred"""))
def q_one_hot(spark, sf_dir):
    p = fx.pred(spark, sf_dir).select("id", "model", en.one_hot(F.col("y_pred"), 3).alias("_h"))
    return p.select("id", "model", *[F.col("_h")[i].alias(f"h{i}") for i in range(3)])


@register("soft_vote", sql(["pred"], """SELECT id, round(p0, 6) AS p0, round(p1, 6) AS p1, round(p2, 6) AS p2, n_models,
       CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS prediction,
       round(greatest(p0, p1, p2), 6) AS confidence
FROM (SELECT id, avg(p0) AS p0, avg(p1) AS p1, avg(p2) AS p2, count(model) AS n_models FROM pred GROUP BY 1)"""))
def q_soft_vote(spark, sf_dir):
    return rounded(en.soft_vote(fx.pred(spark, sf_dir), "id", PROBS))


_STACK_COLS = ", ".join(f"round(max(CASE WHEN model = {m} THEN {c} END), 6) AS m{m}_{c}" for m in range(5) for c in PROBS)


@register("stack_probabilities", sql(["pred"], f"SELECT id, {_STACK_COLS} FROM pred GROUP BY 1"))
def q_stack_probabilities(spark, sf_dir):
    return rounded(en.stack_probabilities(fx.pred(spark, sf_dir), "id", PROBS, [0, 1, 2, 3, 4]))


# class-centroid linear scorer fitted on the training folds (fold != 0):
# weight[class, f] = class mean of f - overall mean of f; the validation fold
# (fold = 0) is explained against the training mean.
TRAIN_SQL = ("trn", "SELECT f.* FROM feat f JOIN folds o ON o.id = f.id WHERE o.fold <> 0")
VALID_SQL = ("val", "SELECT f.* FROM feat f JOIN folds o ON o.id = f.id WHERE o.fold = 0")
WEIGHTS_SQL = ("w", """SELECT c.feature, c.label AS class, c.m - a.m AS weight
FROM (SELECT feature, label, avg(value) AS m FROM trn GROUP BY 1, 2) c
JOIN (SELECT feature, avg(value) AS m FROM trn GROUP BY 1) a ON a.feature = c.feature""")
ATTR_SQL = ("attr", """SELECT f.id, w.class, f.feature, w.weight * (f.value - a.m) AS attribution
FROM val f JOIN (SELECT feature, avg(value) AS m FROM trn GROUP BY 1) a ON a.feature = f.feature
JOIN w ON w.feature = f.feature""")
SUMMARY_SQL = ("summ", """SELECT feature, avg(ma) AS mean_abs,
       CASE WHEN arg_max(m, (abs(m), -class)) > 0 THEN 'positive' ELSE 'negative' END AS direction
FROM (SELECT feature, class, avg(abs(attribution)) AS ma, avg(attribution) AS m FROM attr GROUP BY 1, 2) GROUP BY 1""")
ATTR_CTES = [TRAIN_SQL, VALID_SQL, WEIGHTS_SQL, ATTR_SQL]


def _weights(long):
    c = long.groupBy("feature", "label").agg(F.avg("value").alias("_m"))
    a = long.groupBy("feature").agg(F.avg("value").alias("_a"))
    return c.join(a, "feature").select("feature", F.col("label").alias("class"), (F.col("_m") - F.col("_a")).alias("weight"))


def _attr(spark, sf_dir):
    from neurotab.operators.folds import stratified_folds
    folds = stratified_folds(fx.labelled_ids(spark, sf_dir)).select("id", "fold")
    long = fx.feat(spark, sf_dir).join(folds, "id")
    train, valid = long.where("fold != 0"), long.where("fold = 0")
    return ex.linear_attribution(valid, _weights(train), background=train)


@register("linear_attribution", sql(["feat", "folds"], "SELECT id, class, feature, round(attribution, 6) AS attribution FROM attr",
                                    ATTR_CTES))
def q_linear_attribution(spark, sf_dir):
    return rounded(_attr(spark, sf_dir))


@register("attribution_summary", sql(["feat", "folds"], "SELECT feature, round(mean_abs, 6) AS mean_abs, direction FROM summ",
                                     ATTR_CTES + [SUMMARY_SQL]))
def q_attribution_summary(spark, sf_dir):
    return rounded(ex.attribution_summary(_attr(spark, sf_dir)))


@register("attribution_topk", sql(["feat", "folds"], """SELECT feature, round(mean_abs, 6) AS mean_abs, direction, CAST(rk AS INT) AS rank
FROM (SELECT *, row_number() OVER (ORDER BY mean_abs DESC, feature DESC) AS rk FROM summ) WHERE rk <= 20""",
                                  ATTR_CTES + [SUMMARY_SQL]))
def q_attribution_topk(spark, sf_dir):
    top = ex.top_features(ex.attribution_summary(_attr(spark, sf_dir)), 20)
    return rounded(top.withColumn("rank", F.col("rank").cast("int")))


# feature names built from the recording's channels and the pipeline's feature suffixes
SUFFIXES = ["alpha_abs_power", "beta_rel_power", "theta_alpha_ratio", "dwt_energy_D3", "dwt_entropy_A4", "mean",
            "hjorth_mobility", "spectral_entropy", "gamma_abs_power", "delta_rel_power"]
_SUFFIX_VALUES = ", ".join(f"('{s}')" for s in SUFFIXES)


def _names(spark, sf_dir):
    ch = fx.epochs64(spark, sf_dir).select("channel").distinct()
    named = ch.select("channel", F.explode(F.array(*[F.lit(x) for x in SUFFIXES])).alias("suffix")) \
        .select(F.concat_ws("_", "channel", "suffix").alias("name"))
    pairs = fx.frontal_pairs(spark).select(F.concat_ws("_", F.lit("frontal_asymmetry"), "left_ch", "right_ch").alias("name"))
    return named.unionByName(pairs)


_CH_CASE = "CASE " + " ".join(f"WHEN contains(name, '{c}') THEN '{c}'" for c in config.CHANNELS) + " ELSE 'N/A' END"
_BAND_CASE = "CASE " + " ".join(f"WHEN contains(lower(name), '{b}') THEN '{b.capitalize()}'" for b, _, _ in config.BANDS) + " ELSE 'N/A' END"


@register("feature_name_parse", sql(["epochs64", "frontal_pairs"], f"""SELECT name, {_CH_CASE} AS channel,
       CASE WHEN contains(lower(name), 'dwt') THEN CASE WHEN contains(name, '_') THEN split_part(name, '_', -1) ELSE 'DWT' END
            ELSE {_BAND_CASE} END AS band
FROM names""", [("names", f"""SELECT c.channel || '_' || s.suffix AS name FROM (SELECT DISTINCT channel FROM epochs64) c
CROSS JOIN (VALUES {_SUFFIX_VALUES}) AS s(suffix)
UNION ALL SELECT 'frontal_asymmetry_' || left_ch || '_' || right_ch FROM frontal_pairs""")]))
def q_feature_name_parse(spark, sf_dir):
    n = _names(spark, sf_dir)
    return n.select("name", ex.channel_of(F.col("name")).alias("channel"), ex.band_of(F.col("name")).alias("band"))


# display names for the 8 fixture features (a name per feature position)
DISPLAY = ["F3_Alpha_power", "F4_Beta_power", "Fp1_Theta_power", "Fp2_Gamma_power", "AF3_Alpha_ratio",
           "AF4_sample_entropy", "F3_hjorth_mobility", "F4_dfa"]
_DISPLAY_VALUES = ", ".join(f"({i}, '{n}')" for i, n in enumerate(DISPLAY))


@register("feature_table_view", sql(["feat", "folds"], """SELECT CAST(rk AS INT) AS id, name AS feature, split_part(name, '_', -1) AS channel,
       CASE WHEN contains(name, 'Alpha') THEN 'Alpha' WHEN contains(name, 'Beta') THEN 'Beta'
            WHEN contains(name, 'Theta') THEN 'Theta' WHEN contains(name, 'Gamma') THEN 'Gamma' ELSE 'Complex' END AS band,
       round(coalesce(nullif(mean_abs, 0), nullif(mean_abs, 0), 0), 4) AS shap,
       CASE WHEN mean_abs * 1000 > 10 THEN 'up' ELSE 'down' END AS dir
FROM (SELECT s.*, d.name, row_number() OVER (ORDER BY s.mean_abs DESC, s.feature DESC) AS rk
      FROM summ s JOIN (VALUES """ + _DISPLAY_VALUES + """) AS d(feature, name) ON d.feature = s.feature)
WHERE rk <= 5""", ATTR_CTES + [SUMMARY_SQL]))
def q_feature_table_view(spark, sf_dir):
    """Top-5 attribution table as displayed: rank 1..5, channel = last '_'
    token, display band, importance with fallback, direction by value > 10
    (value = mean |attribution| x 1000)."""
    summ = ex.attribution_summary(_attr(spark, sf_dir))
    names = spark.createDataFrame(list(enumerate(DISPLAY)), "feature int, name string")
    top = ex.top_features(summ.join(F.broadcast(names), "feature"), 5)
    return top.select(F.col("rank").cast("int").alias("id"), F.col("name").alias("feature"),
                      F.element_at(F.split("name", "_"), -1).alias("channel"), vw.ui_band(F.col("name")).alias("band"),
                      F.round(vw.importance_value(F.col("mean_abs"), F.col("mean_abs")), 4).alias("shap"),
                      F.when(F.col("mean_abs") * 1000 > 10, "up").otherwise("down").alias("dir"))


@register("level_status", sql(["pred", "levels"], """SELECT v.id, upper(l.level) AS level,
       CASE WHEN l.level = 'High' THEN 'Action Required' WHEN l.level = 'Moderate' THEN 'Monitor' ELSE 'Normative' END AS status,
       round(v.conf * 100, 1) AS confidence_pct
FROM (SELECT id, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS label, greatest(p0, p1, p2) AS conf
      FROM (SELECT id, avg(p0) AS p0, avg(p1) AS p1, avg(p2) AS p2 FROM pred GROUP BY 1)) v
JOIN levels l ON l.label = v.label"""))
def q_level_status(spark, sf_dir):
    v = en.soft_vote(fx.pred(spark, sf_dir), "id", PROBS)
    lv = F.broadcast(fx.levels(spark))
    j = v.join(lv, v["prediction"] == lv["label"])
    return j.select("id", F.upper("level").alias("level"), vw.level_status(F.col("level")).alias("status"),
                    F.round(F.col("confidence") * 100, 1).alias("confidence_pct"))


@register("gauge_position", sql(["psd64", "frontal_pairs"], """SELECT epoch_id, round(greatest(0.0, least(100.0, (asymmetry + 0.5) * 100)), 6) AS gauge
FROM (SELECT epoch_id, asymmetry FROM faa WHERE pair = 'frontal_alpha_asymmetry')""",
                                 [("alpha", "SELECT epoch_id, channel, sum(CASE WHEN freq BETWEEN 8 AND 13 THEN power ELSE 0 END) AS a FROM psd64 GROUP BY 1, 2"),
                                  ("faa", """SELECT l.epoch_id, 'frontal_alpha_asymmetry' AS pair,
       arg_min(ln(greatest(r.a, 1e-20)) - ln(greatest(l.a, 1e-20)), fp.pair_ord) AS asymmetry
FROM alpha l JOIN frontal_pairs fp ON l.channel = fp.left_ch JOIN alpha r ON r.epoch_id = l.epoch_id AND r.channel = fp.right_ch
GROUP BY 1""")]))
def q_gauge_position(spark, sf_dir):
    from neurotab.operators.spectral import frontal_asymmetry
    faa = frontal_asymmetry(q_spectral.psd64(spark, sf_dir), ["epoch_id"], "channel") \
        .where(F.col("pair") == "frontal_alpha_asymmetry")
    return rounded(faa.select("epoch_id", vw.gauge_position(F.col("asymmetry")).alias("gauge")))


@register("table_sort", sql(["pred"], """SELECT CAST(row_number() OVER (ORDER BY f1 DESC, model, class) - 1 AS BIGINT) AS position,
       model, class, f1 FROM (SELECT model, class, round(f1, 6) AS f1 FROM pc3)""",
                            PC_CTES))
def q_table_sort(spark, sf_dir):
    """Metrics table sorted by F1 descending, stable on the original row order
    (model, class); position by the balanced global numbering."""
    pc = rounded(per_class_metrics(fx.pred(spark, sf_dir), ["model"]).select("model", "class", "f1"))
    out = sequence_index(pc.withColumn("_all", F.lit(0)), ["_all"], [F.col("f1").desc(), "model", "class"],
                         name="position")
    return out.select("position", "model", "class", "f1")


@register("subsample", sql(["feat"], """SELECT DISTINCT id FROM feat
ORDER BY md5('42-' || CAST(id AS VARCHAR)), id LIMIT 100"""))
def q_subsample(spark, sf_dir):
    """n = 100 rows without replacement by a seeded hash order (a sampling operator)."""
    ids = fx.feat(spark, sf_dir).select("id").distinct()
    return ids.orderBy(F.md5(F.concat_ws("-", F.lit(42), F.col("id").cast("string"))), "id").limit(100)


@register("scalar_functions", sql(["pred"], """SELECT id, model,
       round(sqrt(abs(s0)), 6) AS f_sqrt, round(ln(p0), 6) AS f_ln, CAST(sign(s1) AS DOUBLE) AS f_sign,
       round(greatest(least(s2, 0.1), -0.1), 6) AS f_clamp,
       'm' || lpad(CAST(model AS VARCHAR), 3, '0') || '_' || lower('ID') AS f_name,
       split_part('a_b_c', '_', 2) AS f_split, upper(substr('alpha', 1, 1)) || substr('alpha', 2) AS f_cap,
       replace('Part12', 'Part', '') AS f_replace,
       list_position(list_value(s0, s1, s2), greatest(s0, s1, s2)) - 1 AS f_argmax,
       round(list_sum(list_value(p0, p1, p2)), 6) AS f_sum,
       round(coalesce(map_extract(map([ 'a' ], [ s0 ]), 'b')[1], 0.0), 6) AS f_map_default
FROM pred"""))
def q_scalar_functions(spark, sf_dir):
    p = fx.pred(spark, sf_dir)
    arr = F.array("s0", "s1", "s2")
    return p.select(
        "id", "model", F.round(F.sqrt(F.abs("s0")), 6).alias("f_sqrt"), F.round(F.log("p0"), 6).alias("f_ln"),
        F.signum("s1").alias("f_sign"), F.round(F.greatest(F.least("s2", F.lit(0.1)), F.lit(-0.1)), 6).alias("f_clamp"),
        F.concat(F.lit("m"), F.lpad(F.col("model").cast("string"), 3, "0"), F.lit("_"), F.lower(F.lit("ID"))).alias("f_name"),
        F.split(F.lit("a_b_c"), "_")[1].alias("f_split"), F.initcap(F.lit("alpha")).alias("f_cap"),
        F.regexp_replace(F.lit("Part12"), "Part", "").alias("f_replace"),
        (F.array_position(arr, F.array_max(arr)) - 1).cast("int").alias("f_argmax"),
        F.round(F.aggregate(F.array("p0", "p1", "p2"), F.lit(0.0), lambda a, b: a + b), 6).alias("f_sum"),
        F.round(F.coalesce(F.try_element_at(F.create_map(F.lit("a"), F.col("s0")), F.lit("b")), F.lit(0.0)), 6)
        .alias("f_map_default"))
