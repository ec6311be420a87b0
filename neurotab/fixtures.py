"""Signal-shaped views over the driver's tables (see FIXTURES.md).

Each view is a plain DataFrame derived from the given parquet tables, so its
size grows with the scale factor.  Numbering that the fixture text writes as
``row_number() OVER (PARTITION BY ...)`` goes through the balanced
``sequence_index`` so that a dominant key never lands in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from neurotab import config
from neurotab.operators.ordering import sequence_index


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long signal: (recording_id, channel, sample_idx, value) from ``events``."""
    ev = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("recording_id"), F.col("event_type").alias("channel"), "ts", "event_id", "value")
    return sequence_index(ev, ["recording_id", "channel"], ["ts", "event_id"], name="sample_idx") \
        .select("recording_id", "channel", "sample_idx", "value")


def samples_big(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longer signal from ``lineitem`` (epoch size 32 in tests and benchmarks)."""
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("recording_id"), F.col("l_returnflag").alias("channel"),
        "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    out = sequence_index(li, ["recording_id", "channel"],
                         ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"],
                         name="sample_idx")
    return out.select("recording_id", "channel", "sample_idx", (F.col("l_extendedprice") / 1000).alias("value"))


def epochs64_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Array layout: (epoch_id, channel, values array<double>), 64 samples at 128 Hz."""
    emb = table(spark, sf_dir, "embeddings")
    return emb.select(
        F.floor(F.col("vec_id") / 2).cast("long").alias("epoch_id"),
        F.when(F.col("vec_id") % 2 == 0, F.lit("F3")).otherwise(F.lit("F4")).alias("channel"),
        F.col("embedding").cast("array<double>").alias("values"))


def epochs64(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long layout of ``epochs64_arrays``: (epoch_id, channel, sample_idx, value)."""
    arr = epochs64_arrays(spark, sf_dir)
    return arr.select("epoch_id", "channel", F.posexplode("values").alias("sample_idx", "value")) \
        .withColumn("sample_idx", F.col("sample_idx").cast("long"))


def feat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long feature table: (id, subject_id, label, feature, value), 64 features, 3 classes."""
    emb = table(spark, sf_dir, "embeddings")
    return emb.select(
        F.col("vec_id").alias("id"), (F.col("vec_id") % 23).alias("subject_id"), (F.col("label") % 3).alias("label"),
        F.posexplode("embedding").alias("feature", "x"),
    ).select("id", "subject_id", "label", F.col("feature").cast("int").alias("feature"),
             F.col("x").cast("double").alias("value"))


def feat_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, subject_id, label, features array<double>) — the same 64 features as one array."""
    emb = table(spark, sf_dir, "embeddings")
    return emb.select(F.col("vec_id").alias("id"), (F.col("vec_id") % 23).alias("subject_id"),
                      (F.col("label") % 3).alias("label"),
                      F.col("embedding").cast("array<double>").alias("features"))


def pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five models' scores on the same rows: id, model, y_true, s0..s2, y_pred, p0..p2.
    The 64 dimensions are dealt to the 15 (model, class) scores in turn and added up."""
    emb = table(spark, sf_dir, "embeddings")
    models = F.explode(F.array(*[F.lit(m) for m in range(5)])).alias("model")
    base = emb.select(F.col("vec_id").alias("id"), (F.col("label") % 3).alias("y_true"), "embedding", models)
    dim = lambda j: F.coalesce(F.get("embedding", 3 * F.col("model") + j).cast("double"), F.lit(0.0))
    s = [dim(i) + dim(i + 15) + dim(i + 30) + dim(i + 45) + dim(i + 60) for i in range(3)]
    base = base.select("id", "model", "y_true", s[0].alias("s0"), s[1].alias("s1"), s[2].alias("s2"))
    e = [F.exp(F.col(f"s{i}")) for i in range(3)]
    tot = e[0] + e[1] + e[2]
    return base.select(
        "id", "model", "y_true", "s0", "s1", "s2",
        F.when((F.col("s0") >= F.col("s1")) & (F.col("s0") >= F.col("s2")), 0)
         .when(F.col("s1") >= F.col("s2"), 1).otherwise(2).alias("y_pred"),
        (e[0] / tot).alias("p0"), (e[1] / tot).alias("p1"), (e[2] / tot).alias("p2"))


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    scale = F.when(F.col("c_custkey") % 3 == 1, 5).otherwise(9)
    return c.select(
        F.col("c_custkey").alias("trial_id"), (F.col("c_custkey") % 23).alias("subject_id"),
        F.when(F.col("c_custkey") % 3 == 0, "DEAP").when(F.col("c_custkey") % 3 == 1, "DREAMER")
         .otherwise("MAHNOB").alias("dataset"),
        (1 + (F.col("c_custkey") * 7) % scale).cast("double").alias("valence"),
        (1 + F.col("c_nationkey") % scale).cast("double").alias("arousal"))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    ep = ((F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate")).cast("long")
    return o.groupBy(F.col("o_orderpriority").alias("run_id"), ep.alias("epoch")).agg(
        F.round(F.avg("o_totalprice") / 100000, 6).alias("val_loss"), F.count(F.lit(1)).alias("n"))


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("job_id"), "o_orderdate", "o_orderkey", F.col("o_totalprice").alias("loss"))
    numbered = sequence_index(o, ["job_id"], ["o_orderdate", "o_orderkey"], name="epoch")
    totals = o.groupBy("job_id").agg(F.count(F.lit(1)).alias("total_epochs"))
    return numbered.join(totals, "job_id").select(
        "job_id", (F.col("epoch") + 1).cast("long").alias("epoch"), "total_epochs", "loss")


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    ks = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k")
    s = s.select("s_suppkey", "s_nationkey", ks).where(~((F.col("k") == 1) & (F.col("s_suppkey") % 5 == 0)))
    ext = F.when(F.col("k") == 0, ".bdf").when(F.col("k") == 1, ".XML").otherwise(".txt")
    return s.select(F.concat(F.lit("/data/Part"), F.col("s_suppkey").cast("string"), F.lit("_s"),
                             F.col("s_nationkey").cast("string"), F.lit("/rec"), ext).alias("path"), "k")


def xml_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    vl = F.when(F.col("c_custkey") % 7 == 0, F.lit("")).otherwise(
        F.concat(F.lit("<feltVlnc>"), (1 + F.col("c_custkey") % 9).cast("string"), F.lit("</feltVlnc>")))
    return c.select(F.col("c_custkey").alias("session_id"),
                    F.concat(F.lit("<session><feltArsl>"), (1 + F.col("c_nationkey") % 9).cast("string"),
                             F.lit("</feltArsl>"), vl, F.lit("</session>")).alias("xml"))


def xml_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with an attribute, a nested tag, a comment, entities, CDATA,
    fallback names, a broken end, no number, in turn by customer."""
    c = table(spark, sf_dir, "customer")
    a, v = (1 + F.col("c_nationkey") % 9).cast("string"), (1 + F.col("c_custkey") % 9).cast("string")
    both = F.concat(F.lit("<feltArsl>"), a, F.lit("</feltArsl><feltVlnc>"), v, F.lit("</feltVlnc>"))
    case = F.col("c_custkey") % 9
    body = F.when(case == 0, F.concat(F.lit("<s><d><feltArsl unit='a,b'>"), a, F.lit("</feltArsl></d><feltVlnc>"), v, F.lit("</feltVlnc></s>"))) \
        .when(case == 1, F.concat(F.lit("<s>"), both, F.lit("<!-- <feltArsl>99</feltArsl> --></s>"))) \
        .when(case == 2, F.concat(F.lit("<s><feltArsl>&#x31;</feltArsl><feltVlnc><![CDATA["), v, F.lit("]]></feltVlnc></s>"))) \
        .when(case == 3, F.concat(F.lit("<s><selfAROUSAL>"), a, F.lit("</selfAROUSAL><b><Valence_1>"), v, F.lit("</Valence_1></b></s>"))) \
        .when(case == 4, F.concat(F.lit("<s>"), both, F.lit("<open></s>"))) \
        .when(case == 5, F.concat(F.lit("<s><feltArsl>none</feltArsl>"), both, F.lit("</s>"))) \
        .when(case == 6, F.concat(F.lit("<s>"), both, F.lit("</s> trailing"))) \
        .when(case == 7, F.concat(F.lit("<s><feltArsl>9</feltArsl>"), both, F.lit("</s>"))) \
        .otherwise(F.concat(F.lit("<s>"), both, F.lit("<t>&unknown;</t></s>")))
    return c.select(F.col("c_custkey").alias("session_id"), body.alias("xml"))


def labelled_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = table(spark, sf_dir, "embeddings")
    return emb.select(F.col("vec_id").alias("id"), (F.col("label") % 3).alias("label"))


# ---- fixed dimension tables (bounded, safe to broadcast) ----

def bands(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(b, float(lo), float(hi), i) for i, (b, lo, hi) in enumerate(config.BANDS)],
                                 "band string, low double, high double, band_ord int")


def frontal_pairs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(l, r, i) for i, (l, r) in enumerate(config.FRONTAL_PAIRS)],
                                 "left_ch string, right_ch string, pair_ord int")


def levels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(config.LEVELS, "label int, level string")


def channels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, i) for i, c in enumerate(config.CHANNELS)], "channel string, ch_ord int")
