"""Prediction records: cleaning, top features, stored scorers, hand-typed maps."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from neurotab.learn import models as md
from neurotab.learn import predict as pr
from neurotab.learn.boosting import Plan

RNG = np.random.default_rng(9)
NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def data(spark):
    x = RNG.normal(size=(300, 3))
    label = (x[:, 0] > 0).astype(int) + (x[:, 0] + x[:, 1] > 1)
    return spark.createDataFrame([(i, int(y), v.tolist()) for i, (y, v) in enumerate(zip(label, x))], "id long, label int, features array<double>").cache()


@pytest.mark.parametrize("fit", [md.fit_discriminant, md.fit_logreg])
def test_top_features_of_linear_models(spark, data, fit, tmp_path):
    """Attributions are what the score moves by when one feature goes to its mean."""
    scorer = pr.with_inputs(fit(data), data, NAMES)
    md.save_scorer(scorer, spark, str(tmp_path / "s"))
    scorer = md.load_scorer(spark, str(tmp_path / "s"))
    mean = np.array([r["features"] for r in data.collect()]).mean(0)
    assert scorer.params["names"] == NAMES and scorer.params["means"] == pytest.approx(mean)
    rows = [(0, [0.5, -1.0, 0.2]), (1, mean.tolist())]
    for j in range(3):
        moved = [0.5, -1.0, 0.2]
        moved[j] = float(mean[j])
        rows.append((2 + j, moved))
    vectors = spark.createDataFrame(rows, "id long, features array<double>")
    got = {r["id"]: r for r in pr.scored_records(vectors, scorer).collect()}
    probability = {i: {"Low": r["p_low"], "Moderate": r["p_moderate"], "High": r["p_high"]} for i, r in got.items()}
    top = got[0]["top_features"]
    assert [abs(t["attribution"]) for t in top] == sorted((abs(t["attribution"]) for t in top), reverse=True) and len(top) == 3
    # the score of a class is its log probability up to what all classes share
    own = got[0]["level"]
    weights = np.array(pr.linear_weights(scorer))
    for t in top:
        j = NAMES.index(t["feature"])
        k = ["Low", "Moderate", "High"].index(own)
        assert t["attribution"] == pytest.approx(weights[k, j] * (rows[0][1][j] - mean[j]))
        other = (k + 1) % 3
        name = ["Low", "Moderate", "High"][other]
        odds = lambda i: np.log(probability[i][own] / probability[i][name])  # noqa: E731, B023
        assert odds(0) - odds(2 + j) == pytest.approx((weights[k, j] - weights[other, j]) * (rows[0][1][j] - mean[j]), abs=1e-6)
    assert all(t["attribution"] == pytest.approx(0, abs=1e-12) for t in got[1]["top_features"])
    assert [len(r["top_features"]) for r in pr.scored_records(vectors, scorer, k=1).collect()] == [1] * 5


def test_other_models_have_no_linear_attribution(data):
    forest = pr.with_inputs(md.fit_forests(data, {"gbt": Plan(3, 2, 0.3)})[0], data, NAMES)
    rows = pr.scored_records(data.limit(5), forest).collect()
    assert all(r["top_features"] is None and abs(r["p_low"] + r["p_moderate"] + r["p_high"] - 1) < 1e-9 for r in rows)


def test_maps_typed_by_hand(spark, data):
    scorer = pr.with_inputs(md.fit_discriminant(data), data, NAMES)
    requests = spark.createDataFrame([(1, {"a": 2.0, "b": 0.5, "c": 0.0}), (2, {"a": 2.0, "b": 0.5, "unknown": 9.0}), (3, {}), (4, None)],
                                     "request_id long, features map<string,double>")
    got = {r["request_id"]: r for r in pr.predict_manual(requests, scorer).collect()}
    assert got[1][1:] == got[2][1:] and got[3][1:] == got[4][1:] and got[1]["level"] == "High"


def test_signals_longer_than_an_epoch(spark):
    """One record an epoch, from raw signals of two recordings."""
    t = np.arange(300) / 128
    rows = [(r, c, i, float(v)) for r in (1, 2) for c, f in (("F3", 10), ("F4", 6 + r), ("Cz", 20))
            for i, v in enumerate(np.sin(2 * np.pi * f * t) + 0.1 * RNG.normal(size=300))]
    long = spark.createDataFrame(rows, "rec long, channel string, sample_idx long, value double")
    epochs = pr.clean_epochs(long, "rec", epoch_size=128, baseline=16)
    from neurotab.operators.features import epoch_features
    feats = epoch_features(epochs, ["rec", "epoch_id"], fs=128)
    names = ["F3_zero_crossing_rate", "F4_mean_frequency", "not_there"]
    vectors = pr.feature_vectors(feats, ["rec", "epoch_id"], names).withColumn("label", (F.col("id.rec") - 1).cast("int"))
    scorer = pr.with_inputs(md.fit_discriminant(vectors), vectors, names)
    got = pr.predict_signals(long, "rec", scorer, fs=128, epoch_size=128, baseline=16).orderBy("rec", "epoch_id").collect()
    assert [(r["rec"], r["epoch_id"]) for r in got] == [(1, 0), (1, 1), (2, 0), (2, 1)]
    assert all(r["level"] in ("Low", "Moderate") and r["alpha"] > r["gamma"] and len(r["top_features"]) == 3 for r in got)
