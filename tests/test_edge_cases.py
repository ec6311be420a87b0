"""Cases that the fixtures do not reach: each gave a wrong or missing result once."""

import pytest
from pyspark.sql import functions as F

from neurotab.operators import evaluation as ev
from neurotab.operators import labels, preprocess, selection, spectral, training
from neurotab.sources import readers


def test_labels_know_the_datasets(spark):
    df = spark.createDataFrame([("DEAP", 1.0, 9.0), ("DREAMER", 1.0, 3.0), ("MAHNOB", 9.0, 1.0), ("DEAP", None, 9.0)], "dataset string, valence double, arousal double")
    assert [r["label"] for r in labels.anxiety_label(df).collect()] == [2, 2, 0, None]
    with pytest.raises(Exception, match="unknown dataset"):
        labels.anxiety_label(spark.createDataFrame([("other", 1.0, 9.0)], df.schema)).collect()
    assert labels.anxiety_label(spark.createDataFrame([("other", 1.0, 9.0)], df.schema), thresholds={"other": 5}).first()["label"] == 2


def test_csv_columns_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("time,F3,F4\n0,1,2\n1,x,4\n")
    (tmp_path / "b.csv").write_text("F4,timestamp,F3\n20,0,10\n")
    got = readers.read_wide_csv(spark, str(tmp_path), ["F3", "F4"])
    assert sorted((r["time"], r["channel"], r["value"] or -1) for r in got.collect()) == [
        (0, "F3", 1), (0, "F3", 10), (0, "F4", 2), (0, "F4", 20), (1, "F3", -1), (1, "F4", 4)]
    assert {r["channel"]: r["n_bad"] for r in readers.bad_cells(got).collect()} == {"F3": 1, "F4": 0}


def test_sessions_by_full_folder(spark):
    paths = [f"/d/Part{p}/s1/x.{e}" for p in (1, 2) for e in ("bdf", "xml")] + ["/d/.hid/x.bdf", "/d/.hid/x.xml", "/d/Part3/s1/x.bdf"]
    got = readers.pair_sessions(spark.createDataFrame([(p,) for p in paths], "path string"))
    assert sorted((r["session"], r["signal_path"], r["annotation_path"]) for r in got.collect()) == [
        ("s1", f"/d/Part{p}/s1/x.bdf", f"/d/Part{p}/s1/x.xml") for p in (1, 2)]


def test_one_class(spark):
    rows = spark.createDataFrame([("m", i, 1, 0.1 * i) for i in range(5)], "model string, id int, y_true int, p double")
    ovr = rows.select("model", F.lit(1).alias("class"), "id", F.col("p").alias("score"), F.lit(1).alias("positive"))
    assert all(r["roc_auc"] is None for r in ev.roc_auc(ovr, ["model"]).collect())
    assert ev.average_precision(ovr, ["model"]).first()["average_precision"] == 1.0
    long = spark.createDataFrame([(0, 1, 1.0), (0, 1, 2.0)], "feature int, label int, value double")
    assert selection.anova_f(long).first()["f_score"] is None


def test_zero_probabilities_count(spark):
    df = spark.createDataFrame([("r", 0, 0, 0.0, 1.0), ("r", 1, 1, 0.1, 0.9)], "run string, y_true int, y_pred int, p0 double, p1 double")
    assert training.loss_accuracy(df, ["run"], ["p0", "p1"]).first()["loss"] > 10
    assert training.smoothed_log_loss(df, ["run"], ["p0", "p1"]).first()["smoothed_loss"] > 1


def test_moving_average_longer_than_a_block(spark):
    df = spark.createDataFrame([(1, i, float(i)) for i in range(1, 11)], "rec int, sample_idx int, value double")
    got = preprocess.moving_average(df, ["rec"], k=6, block=2).orderBy("sample_idx").collect()
    assert got[-1]["moving_avg"] == 7.5


def test_spectra_without_pairs_or_bins(spark):
    psd = spark.createDataFrame([(1, "Cz", 10.0, 2.0), (2, "F3", 10.0, 1.0), (2, "F4", 10.0, 1.0)], "epoch_id int, channel string, freq double, power double")
    got = {(r["epoch_id"], r["pair"]): r["asymmetry"] for r in spectral.frontal_asymmetry(psd, ["epoch_id"]).collect()}
    assert got == {(1, "frontal_alpha_asymmetry"): 0.0, (2, "frontal_alpha_asymmetry"): 0.0, (2, "frontal_asymmetry_F3_F4"): 0.0}
    means = {(r["epoch_id"], r["band"]): r["band_power"] for r in spectral.band_power_mean(psd, ["epoch_id"]).collect()}
    assert len(means) == 10 and means[1, "alpha"] == 2.0 and means[1, "delta"] == 0.0


def test_cleaning_keeps_all_channels(spark):
    rows = [(1, f"c{c:02d}", i, (100.0 if c == 3 else 1.0) * ((i * (c + 1)) % 7)) for c in range(22) for i in range(32)]
    df = spark.createDataFrame(rows, "recording_id int, channel string, sample_idx long, value double")
    assert preprocess.artifact_flags(df, ["recording_id"]).where("flagged").count() == 1
    out = preprocess.clean(df, ["recording_id"], filters=False, baseline=4, epoch_size=16)
    assert out.select("channel").distinct().count() == 22


def test_every_subject_is_left_out_once(spark):
    from neurotab.learn import models, validation

    rows = [(i, i % 4, i % 3, [float(i % 3), float(i % 5)]) for i in range(48)]
    data = spark.createDataFrame(rows, "id long, subject_id long, label int, features array<double>")
    got = validation.loso_validate(data, models.fit_discriminant)
    assert got.select("fold").distinct().count() == 4


def test_training_without_a_class(spark):
    from neurotab.learn import models

    train = spark.createDataFrame([(i, 2 * (i % 2), [5.0 * (i % 2) + 0.1 * (i % 7), float(i % 5)]) for i in range(20)], "id long, label int, features array<double>")
    got = models.fit_discriminant(train).score(train).collect()
    assert all(r["p1"] == 0.0 and abs(r["p0"] + r["p2"] - 1) < 1e-9 and r["prediction"] == 2 * (r["id"] % 2) for r in got)


def test_datasets_and_trials(spark):
    assert readers.dataset("DREAMER")["threshold"] == 2.5
    with pytest.raises(ValueError):
        readers.dataset("other")
    rows = [(1, 0, [[1.0, 2.0, 3.0], [4.0, 5.0, 6.0]]), (1, 1, [[1.0, 2.0], [3.0]]), (1, 2, None), (1, 3, []), (2, 0, [[1.0], [2.0], [3.0]])]
    df = spark.createDataFrame(rows, "subject_id int, trial_id int, eeg array<array<double>>")
    got = readers.nested_trials(df).collect()
    assert {(r["subject_id"], r["trial_id"]) for r in got} == {(1, 0), (2, 0)} and len(got) == 9
    left = readers.before_broken_trials(df, F.col("eeg").isNull())
    assert {(r["subject_id"], r["trial_id"]) for r in left.collect()} == {(1, 0), (1, 1), (2, 0)}
