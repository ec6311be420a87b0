"""Random forests of all folds grown whole in tasks, against plain NumPy and Spark's own."""

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from neurotab.learn import boosting as bo
from neurotab.learn import forest as fo
from neurotab.learn import models as md
from neurotab.learn import validation as va


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 5))
    label = (np.hypot(x[:, 0], x[:, 1]) > 0.9).astype(int) + (np.hypot(x[:, 0], x[:, 1]) > 1.5)
    return spark.createDataFrame([(i, int(c), v.tolist(), i % 3) for i, (c, v) in enumerate(zip(label, x))], "id long, label int, features array<double>, fold int").cache()


def accuracy(scored, data):
    return scored.join(data.select("id", "label"), "id").agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]


def gini(counts):
    return 1 - ((counts / counts.sum()) ** 2).sum()


def test_a_tree_by_plain_search():
    """Every node's split is the best over the drawn features, leaves are pure,
    without gain or at the depth, and sibling leaves do not agree."""
    rng = np.random.default_rng(0)
    cells = rng.integers(0, 6, (300, 9)).astype(np.uint8)
    label, weight = (cells[:, 0] > 2) + (cells[:, 1] + rng.integers(0, 3, 300) > 4).astype(int), rng.poisson(1, 300)
    tree, draws = fo.grow_tree(cells, label, weight, fo.Bagging(1, 4, 7), 0, 3), np.random.default_rng([7, 0])
    own, level = {0: np.nonzero(weight)[0]}, [0]
    counts = lambda rows: np.bincount(label[rows], weight[rows], 3)
    child = {}
    for _ in range(4):
        level = [k for k in level if (counts(own[k]) > 0).sum() > 1]
        used = np.sort(draws.random((len(level), 9)).argsort(1)[:, :3], 1)
        below = []
        for k, features in zip(level, used):
            rows, best = own[k], (1e-12, None)
            for j in features:
                for cut in range(5):
                    right = cells[rows, j] > cut
                    if 0 < right.sum() < len(rows):
                        sides = [counts(rows[~right]), counts(rows[right])]
                        gain = gini(counts(rows)) - sum(s.sum() * gini(s) for s in sides) / weight[rows].sum()
                        best = max(best, (gain, (j, cut)), key=lambda v: v[0] - 1e-12 * (v is not best))
            if best[1]:
                right = cells[rows, best[1][0]] > best[1][1]
                first = child[k] = len(own)
                own |= {first: rows[~right], first + 1: rows[right]}
                assert (tree.feature[k], tree.cut[k]) == best[1]
                below += [first, first + 1]
        level = below
    assert len(tree.child) == len(own) > 9
    for k, rows in own.items():
        assert tree.shares[k] == pytest.approx(counts(rows) / weight[rows].sum())
        if tree.child[k]:
            c = child[k]
            assert tree.child[k] == c and (tree.child[c] or tree.child[c + 1] or tree.shares[c].argmax() != tree.shares[c + 1].argmax())


def test_as_good_as_sparks_forest(blobs):
    """Unlike trees, like forests: drawn rows and features differ, the probabilities agree closely."""
    train, valid = blobs.where("fold != 0"), blobs.where("fold = 0")
    ours = md.fit_random_forest(train, trees=200, depth=6)
    assert ours.kind == "bagged" and ours.stage.count() == 200  # Spark's forest took a job a level and fit
    rf = RandomForestClassifier(featuresCol="fv", labelCol="label", numTrees=200, maxDepth=6, seed=42).fit(train.withColumn("fv", array_to_vector("features")))
    want = {r["id"]: list(r["p"]) for r in rf.transform(valid.withColumn("fv", array_to_vector("features"))).select("id", vector_to_array("probability").alias("p")).collect()}
    got = {r["id"]: [r["p0"], r["p1"], r["p2"]] for r in ours.score(valid).collect()}
    assert set(got) == set(want) and len(got) == 200
    gap = np.abs(np.array([got[i] for i in want]) - np.array(list(want.values())))
    assert gap.mean() < 0.03 and gap.max() < 0.2
    assert accuracy(ours.score(valid), valid) > 0.8


def test_forest_does_not_depend_on_partitions(blobs):
    a, b = (sorted(md.fit_random_forest(d, trees=12, depth=5).score(blobs).collect()) for d in (blobs.coalesce(1), blobs.repartition(7)))
    assert a == b


def test_all_folds_together(blobs, monkeypatch):
    """Left-out rows get what the forest of the other folds gives them, one row
    each even if ids repeat; their own labels do not matter."""
    monkeypatch.setitem(md.OUT_OF_FOLD, md.fit_random_forest, lambda d, c, f: md.forest_out_of_fold(d, c, f, trees=25, depth=5))
    oof = va.oof_predictions(blobs, {"rf": md.fit_random_forest})
    assert oof.columns == ["id", "model", "prediction", "p0", "p1", "p2", "fold"] and oof.count() == 600
    monkeypatch.undo()
    cuts, classes, _, held = fo.grow_forests(blobs, [fo.Bagging(25, 5, leave_out=f) for f in range(3)], "fold")
    _, _, trees, _ = fo.grow_forests(blobs, [fo.Bagging(25, 5, leave_out=1)], "fold")
    again = {r["id"]: r["shares"] for r in fo.forest_shares(blobs.where("fold = 1"), cuts, classes, trees).collect()}
    first = {r["id"]: r["shares"] for r in held.where("plan = 1").collect()}
    assert len(again) == 200 and all(first[i] == pytest.approx(p, abs=1e-9) for i, p in again.items())
    got = {r["id"]: (r["p0"], r["p1"], r["p2"], r["fold"]) for r in oof.collect()}
    assert all(got[i][:3] == pytest.approx(first[i], abs=1e-9) and got[i][3] == 1 for i in first)
    flipped = blobs.withColumn("label", F.when(F.col("fold") == 1, 2 - F.col("label")).otherwise(F.col("label")))
    _, _, _, other = fo.grow_forests(flipped, [fo.Bagging(25, 5, leave_out=1)], "fold", keep_trees=False)
    assert {r["id"]: r["shares"] for r in other.collect()} == first
    twice = blobs.withColumn("id", F.when(F.col("id") < 10, F.lit(None)).otherwise(F.col("id") % 300))
    assert fo.grow_forests(twice, [fo.Bagging(3, 3, leave_out=f) for f in range(3)], "fold", keep_trees=False)[3].count() == 600


def test_odd_rows(spark, blobs):
    odd = blobs.withColumn("features", F.when(F.col("id") == 5, F.array(F.lit(None).cast("double"), *[F.lit(0.5)] * 4)).otherwise(F.col("features")))
    zero = blobs.withColumn("features", F.when(F.col("id") == 5, F.array(F.lit(0.0), *[F.lit(0.5)] * 4)).otherwise(F.col("features")))
    cuts = lambda d: fo.grow_forests(d, [fo.Bagging(2, 3)])[0]
    assert cuts(odd) == cuts(zero)  # as Spark's vectors have it
    bad = blobs.withColumn("features", F.when(F.col("id") == 5, F.array(*[F.lit(float("nan"))] * 5)).otherwise(F.col("features")))
    with pytest.raises(Exception, match="NaN"):
        md.fit_random_forest(bad, trees=2, depth=2)
    with pytest.raises(ValueError):
        md.fit_random_forest(blobs.where("id < 0"), trees=2, depth=2)
    two = md.fit_random_forest(blobs.where("label < 2"), trees=5, depth=3).score(blobs)
    assert two.where("p2 != 0").count() == 0


def test_a_large_table_is_left_to_spark(blobs, monkeypatch):
    monkeypatch.setattr(bo, "IN_TASK_CELLS", 100)
    assert md.fit_random_forest(blobs, trees=3, depth=2).kind == "probability"
    assert md.forest_out_of_fold(blobs, "fold", [0, 1, 2]) is None
