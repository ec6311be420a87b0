"""Boosting, support vectors, stacking and leave-one-subject-out, fitted for real."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from neurotab import fixtures as fx
from neurotab.learn import boosting as bo
from neurotab.learn import models as md
from neurotab.learn import svm
from neurotab.learn import validation as va
from neurotab.learn.sufficient import left_out_predictions

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def feat(spark):
    return fx.feat_wide(spark, SMALL).select("id", "subject_id", "label", "features", (F.col("id") % 5).cast("int").alias("fold")).cache()


@pytest.fixture(scope="module")
def rings(spark):
    """Three classes by distance from the origin: no linear model separates them."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 4))
    r = np.hypot(x[:, 0], x[:, 1])
    label = (r > 0.9).astype(int) + (r > 1.5)
    rows = [(i, int(y), v.tolist(), i % 3) for i, (y, v) in enumerate(zip(label, x))]
    return spark.createDataFrame(rows, "id long, label int, features array<double>, fold int").cache()


def accuracy(scored, data):
    return scored.join(data.select("id", "label"), "id").agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]


PLANS = [bo.Plan(4, 3, 0.3), bo.Plan(3, 2, 0.5, rows=0.7, leave_out=1), bo.Plan(5, 3, 0.3, features="sqrt", leave_out=0)]


def test_both_ways_grow_the_same_trees(rings):
    cuts, trees, held = bo.boost(rings, PLANS, "fold")
    same_cuts, level_trees, level_held = bo.boost(rings, PLANS, "fold", in_task_cells=0)
    key = lambda df: sorted((r["plan"], r["round"], r["cls"], r["feature"], r["cut"], r["child"], [round(v, 12) for v in r["value"]]) for r in df.collect())
    assert cuts == same_cuts and key(trees) == key(level_trees)
    assert len(key(trees)) == 3 * (4 + 3 + 5)
    margins = lambda df: {(r["plan"], r["id"]): r["margins"] for r in df.collect()}
    a, b = margins(held), margins(level_held)
    assert set(a) == set(b) == {(1, i) for i in range(1, 900, 3)} | {(2, i) for i in range(0, 900, 3)}
    assert all(a[k] == pytest.approx(b[k], abs=1e-12) for k in a)
    # stored trees give new rows the margins that the fit had for its left-out ones
    again = bo.forest_margins(rings.where("fold = 1"), cuts, trees.where("plan = 1")).collect()
    assert all(r["margins"] == pytest.approx(a[1, r["id"]], abs=1e-12) for r in again)


def test_one_tree_by_hand(spark):
    """A single split of one feature: gain, cut and leaf values of the first round."""
    rows = [(i, int(i >= 6), [float(i), 0.0, None]) for i in range(10)]
    data = spark.createDataFrame(rows, "id long, label int, features array<double>")
    cuts, trees, _ = bo.boost(data, [bo.Plan(1, 1, 1.0)], classes=2)
    t = trees.where("cls = 1").first()
    assert (t["feature"][0], cuts[0][t["cut"][0]], t["child"]) == (0, 5.0, [1, 0, 0]) and cuts[1:] == [[0.0], []]
    # six rows with g = 0.5 and four with -0.5, h = 0.5 each, penalty 1
    assert t["value"][1:] == pytest.approx([-3.0 / (3.0 + 1), 2.0 / (2.0 + 1)])


def test_boosting_as_good_as_the_library(rings):
    train, valid = rings.where("fold != 0"), rings.where("fold = 0")
    ours = accuracy(md.fit_boosted(train, iters=20, depth=4, step=0.2).score(valid), valid)
    theirs = accuracy(md.fit_gbt_ovr(train, iters=10, depth=4, step=0.2).score(valid), valid)
    assert ours >= theirs - 0.01 and ours > 0.85


def test_ensemble_and_search(rings):
    train, valid = rings.where("fold != 0"), rings.where("fold = 0")
    ensemble = md.fit_boosting_ensemble(train, iters=15, depth=[3, 4, 5], step=0.2)
    assert [m.name for m in ensemble.members] == ["gbt_a", "gbt_b", "gbt_c"]
    alone = accuracy(ensemble.score(valid), valid)
    trials = rings.sparkSession.createDataFrame([(0, 3, 4, 5, 0.2, 15), (1, 2, 2, 2, 0.05, 2)], "trial int, depth_a int, depth_b int, depth_c int, learning_rate double, n_trees int")
    found = {r["trial"]: r["mean_accuracy"] for r in va.tune_boosting(rings, trials).collect()}
    assert found[0] > found[1] and found[0] == pytest.approx(alone, abs=0.06)
    assert va.best_trial(va.tune_boosting(rings, trials)).first()["trial"] == 0


def test_newton_reaches_the_optimum(rings):
    scaler = md.fit_scaler(rings)
    w, b = svm.projection(4, 0.25, 30)
    weights = svm.newton(rings, scaler, w, b, 2.0, 3, [None, 2], "fold")
    rows = rings.orderBy("id").collect()
    z = svm.projected(np.array([r["features"] for r in rows]), scaler, w, b)
    fold, label = np.array([r["fold"] for r in rows]), np.array([r["label"] for r in rows])
    for k, left in enumerate([None, 2]):
        for c in range(3):
            use = fold != left if left is not None else np.ones(len(z), bool)
            y, v = np.where(label == c, 1.0, -1.0)[use], weights[k, c]
            slack = np.maximum(0, 1 - y * (z[use] @ v))
            gradient = np.r_[v[:-1], 0] - 4.0 * z[use].T @ (slack * y)
            assert np.abs(gradient).max() < 1e-5


def test_fourier_features_stand_for_the_kernel(rings):
    """The machine separates what no linear one can, and its features give the
    kernel's values."""
    train, valid = rings.where("fold != 0"), rings.where("fold = 0")
    assert accuracy(md.fit_svm_rff(train).score(valid), valid) > 0.85 > accuracy(md.fit_logreg(train).score(valid), valid) + 0.1
    x = np.array([r["features"] for r in valid.limit(40).collect()])
    w, b = svm.projection(4, 0.25, 4000)
    z = svm.projected(x, ([0.0] * 4, [1.0] * 4), w, b)[:, :-1]
    kernel = np.exp(-0.25 * ((x[:, None] - x) ** 2).sum(2))
    assert np.abs(z @ z.T - kernel).max() < 0.1


FAST = {"svm": md.fit_svm_rff, "lda": md.fit_discriminant, "gbt": md.fit_boosted, "knn": md.fit_knn}


def test_out_of_fold_and_stacking(spark, rings, monkeypatch, tmp_path):
    monkeypatch.setitem(md.OUT_OF_FOLD, md.fit_boosted, lambda d, c, f: md.boosted_out_of_fold(d, c, f, iters=8, depth=3, step=0.3))
    oof = va.oof_predictions(rings, FAST)
    assert oof.count() == 4 * 900 and oof.columns == ["id", "model", "prediction", "p0", "p1", "p2", "fold"]
    bad = oof.where("abs(p0 + p1 + p2 - 1) > 1e-9 or prediction != case when p0 >= p1 and p0 >= p2 then 0 when p1 >= p2 then 1 else 2 end")
    assert bad.count() == 0
    # a left-out row's score does not depend on its own label
    flipped = rings.withColumn("label", F.when(F.col("id") == 0, 2 - F.col("label")).otherwise(F.col("label")))
    for name in ("gbt", "svm"):
        score = lambda d: md.out_of_fold_scores(FAST[name], d, "fold", [0, 1, 2], name).where("id = 0").first()
        assert score(rings) == score(flipped)
    # stored in one process, read back by kind alone
    small = {"lda": md.fit_discriminant, "gbt": lambda d: md.fit_boosted(d, iters=5, depth=3, step=0.3)}
    stacking = va.fit_stacking(rings, small, k=2)
    md.save_scorer(stacking, spark, str(tmp_path / "s"))
    code = ("from neurotab.session import build_session\nfrom neurotab.learn.models import load_scorer\n"
            "import sys\ns = build_session(master='local[2]')\n"
            "d = s.createDataFrame([(0, [0.1, 0.2, 0.0, 0.0])], 'id long, features array<double>')\n"
            f"print('ROW', *load_scorer(s, {str(tmp_path / 's')!r}).score(d).first())")
    import subprocess
    import sys
    said = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=240, cwd=str(__import__("pathlib").Path(__file__).parents[1]))
    row = next(x for x in said.stdout.splitlines() if x.startswith("ROW")).split()
    here = stacking.score(spark.createDataFrame([(0, [0.1, 0.2, 0.0, 0.0])], "id long, features array<double>")).first()
    assert row[1:3] == ["0", "stacking"] and [float(v) for v in row[4:]] == pytest.approx([here["p0"], here["p1"], here["p2"]])


def test_left_out_subjects(spark, feat):
    """The subtracted statistics give the fit of the remaining rows."""
    got = {r["id"]: r for r in left_out_predictions(feat).collect()}
    rows = feat.collect()
    x, y, s = np.array([r["features"] for r in rows]), np.array([r["label"] for r in rows]), np.array([r["subject_id"] for r in rows])
    assert len(got) == len(rows)
    for subject in np.unique(s)[:6]:
        keep = s != subject
        mu = np.array([x[keep & (y == c)].mean(0) for c in range(3)])
        within = x[keep] - mu[y[keep]]
        inv = np.linalg.pinv(within.T @ within / (keep.sum() - 3))
        prior = np.array([(y[keep] == c).mean() for c in range(3)])
        d = x[~keep] @ inv @ mu.T - 0.5 * (mu @ inv * mu).sum(1) + np.log(prior)
        p = np.exp(d - d.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        for r, want in zip(np.array(rows, object)[~keep], p):
            assert [got[r[0]][f"p{c}"] for c in range(3)] == pytest.approx(want, abs=1e-9)


def test_left_out_cases(spark):
    rows = [(1, "a", 0, [0.0, 1.0]), (2, "a", 0, [0.5, None]), (3, None, 1, [3.0, 1.0]), (4, None, 1, [4.0, 2.0]), (5, "b", 0, [0.2, 0.0]), (6, "b", 2, [9.0, 9.0])]
    data = spark.createDataFrame(rows, "id long, subject_id string, label int, features array<double>")
    got = {r["id"]: r for r in left_out_predictions(data).collect()}
    assert set(got) == set(range(1, 7)) and got[5]["p2"] == 0 and got[3]["p1"] == 0
    alone = left_out_predictions(data.where("subject_id = 'a'")).collect()
    assert [(r["prediction"], r["p0"]) for r in alone] == [(None, None)] * 2
