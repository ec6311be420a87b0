"""Spark operator tests: analytic expectations, skew-safety equivalences, brute force."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from neurotab.operators import evaluation as ev
from neurotab.operators import preprocess as pp
from neurotab.operators import spectral as sp
from neurotab.operators.balance import smote
from neurotab.operators.folds import stratified_folds
from neurotab.operators.knn import knn_join
from neurotab.operators.ordering import running_sum, sequence_index
from neurotab.operators.time_features import scrub, time_features
from neurotab.operators.training import early_stop_epoch


def _long(spark, signals):
    rows = [(rec, ch, i, float(v)) for (rec, ch), xs in signals.items() for i, v in enumerate(xs)]
    return spark.createDataFrame(rows, "recording_id long, channel string, sample_idx long, value double")


def test_zero_crossing_counts_zero_as_its_own_sign(spark):
    df = _long(spark, {(1, "a"): [1, 0, -1, 0, 1]})
    r = time_features(df, ["recording_id", "channel"]).first()
    assert r["zero_crossing_rate"] == pytest.approx(4 / 5)


def test_constant_signal(spark):
    df = _long(spark, {(1, "a"): [3.0] * 64})
    r = time_features(df, ["recording_id", "channel"]).select(
        "hjorth_activity", "hjorth_mobility", "hjorth_complexity", scrub(F.col("skewness")).alias("s")).first()
    assert (r[0], r[1], r[2], r[3]) == (0.0, 0.0, 0.0, 0.0)
    z = pp.zscore(df, ["recording_id", "channel"]).agg(F.max(F.abs("value"))).first()[0]
    assert z == 0.0


def test_sine_power_in_alpha_and_twin_asymmetry_zero(spark):
    t = np.arange(512) / 128.0
    x = np.sin(2 * np.pi * 10 * t)
    arr = spark.createDataFrame([(0, "F3", x.tolist()), (0, "F4", x.tolist())], "epoch_id long, channel string, values array<double>")
    psd = sp.welch_psd(arr, ["epoch_id", "channel"])
    bp = {r["band"]: r["rel_power"] for r in sp.band_power(psd, ["epoch_id", "channel"]).where("channel = 'F3'").collect()}
    assert bp["alpha"] > 0.99
    mf = sp.spectral_summary(psd, ["epoch_id", "channel"]).first()["mean_frequency"]
    assert mf == pytest.approx(10, abs=0.5)
    md = sp.median_frequency(psd, ["epoch_id", "channel"]).first()["median_frequency"]
    assert md == pytest.approx(10, abs=0.5)
    faa = sp.frontal_asymmetry(psd, ["epoch_id"]).where("pair = 'frontal_alpha_asymmetry'").first()["asymmetry"]
    assert faa == pytest.approx(0.0, abs=1e-12)


def test_short_signal_gives_one_padded_epoch(spark):
    df = _long(spark, {(1, "a"): list(range(1, 101))})
    ep = pp.epoching(df, ["recording_id", "channel"], size=512).toPandas()
    assert len(ep) == 512 and ep["epoch_id"].nunique() == 1
    assert ep.sort_values("pos")["value"].iloc[100:].eq(0).all()


def test_mix_offset_removed_by_baseline(spark):
    t = np.arange(1024) / 128.0
    x = 20 * np.sin(2 * np.pi * 2 * t) + 15 * np.sin(2 * np.pi * 10 * t) + 5 * np.sin(2 * np.pi * 20 * t) + 40
    df = _long(spark, {(1, "a"): x})
    out = pp.baseline_correct(df, ["recording_id", "channel"], baseline=384).agg(F.avg("value")).first()[0]
    assert abs(out) < 1.0


def _skewed(spark, n=4000):
    rng = np.random.default_rng(7)
    keys = np.where(rng.random(n) < 0.6, 0, rng.integers(1, 20, n))   # key 0 holds ~60 % of rows
    pdf = pd.DataFrame({"k": keys, "t": rng.permutation(n), "v": rng.integers(0, 5, n)})
    return spark.createDataFrame(pdf)


def test_sequence_index_matches_row_number_under_skew(spark):
    df = _skewed(spark)
    got = sequence_index(df, ["k"], ["t"], name="seq", n_slices=16)
    ref = df.withColumn("ref", F.row_number().over(Window.partitionBy("k").orderBy("t")) - 1)
    bad = got.join(ref, ["k", "t"]).where(F.col("seq") != F.col("ref")).count()
    assert bad == 0 and got.count() == df.count()


def test_running_sum_matches_window(spark):
    df = _skewed(spark)
    got = running_sum(df, ["k"], ["t"], ["v"], n_slices=16)
    w = Window.partitionBy("k").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    ref = df.withColumn("ref", F.sum("v").over(w))
    assert got.join(ref, ["k", "t"]).where(F.col("v_cum") != F.col("ref")).count() == 0


def test_moving_average_block_halo_matches_window(spark):
    rng = np.random.default_rng(3)
    df = _long(spark, {(1, "a"): rng.normal(size=300), (2, "b"): rng.normal(size=50)})
    got = pp.moving_average(df, ["recording_id", "channel"], k=5, block=16)
    w = Window.partitionBy("recording_id", "channel").orderBy("sample_idx").rowsBetween(-4, 0)
    ref = df.withColumn("ref", F.avg("value").over(w))
    j = got.join(ref, ["recording_id", "channel", "sample_idx"])
    assert j.count() == 350
    assert j.agg(F.max(F.abs(F.col("moving_avg") - F.col("ref")))).first()[0] < 1e-12


def test_knn_join_exact_against_brute_force(spark):
    rng = np.random.default_rng(11)
    n = 600
    x = rng.normal(size=(n, 4))
    x[:300, 0] = 0.0                      # many ties on the ranked coordinate
    cls = np.where(rng.random(n) < 0.7, 0, 1)
    pdf = pd.DataFrame({"id": np.arange(n), "label": cls, "features": list(x)})
    df = spark.createDataFrame(pdf, "id long, label long, features array<double>")
    for block in (16, 4096):
        got = knn_join(df, df, 5, partition=["label"], exclude_self=True, block=block, query_group=50).toPandas()
        assert len(got) == 5 * n
        for q in [0, 1, 17, 299, 300, 599]:
            same = np.nonzero((cls == cls[q]) & (np.arange(n) != q))[0]
            d = np.sqrt(((x[same] - x[q]) ** 2).sum(axis=1))
            order = sorted(zip(d, same))[:5]
            mine = got[got.q_id == q].sort_values("rank")
            assert list(mine.p_id) == [int(i) for _, i in order]


def test_smote_points_lie_on_segments_and_balance(spark):
    rng = np.random.default_rng(5)
    n = 90
    labels = np.array([0] * 50 + [1] * 25 + [2] * 15)
    pdf = pd.DataFrame({"id": np.arange(n), "label": labels, "features": list(rng.normal(size=(n, 3)))})
    df = spark.createDataFrame(pdf, "id long, label int, features array<double>")
    out = smote(df).toPandas()
    assert out.groupby("label").size().tolist() == [50, 50, 50]
    syn = out[out.is_synthetic]
    feats = {i: f for i, f in zip(pdf.id, pdf.features)}
    for _, r in syn.head(20).iterrows():
        base = feats[r.src_id]
        same = [feats[i] for i in pdf.id[(pdf.label == r.label) & (pdf.id != r.src_id)]]
        # the synthetic point is base + u (nb - base) for one same-class neighbour, 0 <= u < 1
        ok = False
        for nb in same:
            d = np.asarray(nb) - base
            u = np.dot(np.asarray(r.features) - base, d) / np.dot(d, d)
            if 0 <= u < 1 and np.allclose(base + u * d, r.features, atol=1e-9):
                ok = True
                break
        assert ok


def test_stratified_folds_balanced(spark):
    ids = spark.range(0, 1000).select(F.col("id"), (F.col("id") % 7 % 3).cast("int").alias("label"))
    f = stratified_folds(ids).groupBy("label", "fold").count().toPandas()
    for _, g in f.groupby("label"):
        assert g["count"].max() - g["count"].min() <= 1


def test_early_stopping_rule(spark):
    losses = [1.0, 0.9, 0.95] + [0.9] * 20
    h = spark.createDataFrame([("r", e, v) for e, v in enumerate(losses)], "run_id string, epoch long, val_loss double")
    r = early_stop_epoch(h, patience=15).first()
    assert r["stopped"] and r["stop_epoch"] == 16


def test_confusion_and_auc_small_example(spark):
    rows = [(0, 0, 0, 0.9, 0.05, 0.05), (1, 1, 1, 0.1, 0.8, 0.1), (2, 2, 1, 0.2, 0.5, 0.3), (3, 2, 2, 0.1, 0.2, 0.7)]
    df = spark.createDataFrame([(0, *r) for r in rows], "model int, id long, y_true int, y_pred int, p0 double, p1 double, p2 double")
    cm = {(r.y_true, r.y_pred): r.n for r in ev.confusion_matrix(df, ["model"]).collect()}
    assert cm[(2, 1)] == 1 and cm[(0, 0)] == 1 and sum(cm.values()) == 4
    auc = {r["class"]: r.roc_auc for r in ev.roc_auc(ev.one_vs_rest(df, ["model"], ["p0", "p1", "p2"]), ["model"]).collect()}
    assert auc[0] == 1.0 and auc[2] == 1.0
