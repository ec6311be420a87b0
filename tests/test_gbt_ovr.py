"""One class against the rest: Spark's boosted trees on this library's histograms."""

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier, OneVsRest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from neurotab.learn import boosting as bo
from neurotab.learn import models as md


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(2)
    x = np.c_[rng.integers(0, 20, (400, 2)), rng.normal(8, 5, 400)]  # fewer values than bins, and more
    label = (x[:, 0] + rng.normal(size=400) > 9).astype(int) + (x[:, 1] * x[:, 2] > 150)
    return spark.createDataFrame([(i, int(c), v.tolist()) for i, (c, v) in enumerate(zip(label, x))], "id long, label int, features array<double>").cache()


def test_margins_are_those_of_spark(spark, blobs):
    ours = md.fit_gbt_ovr(blobs, iters=4, depth=2, step=0.3)
    assert ours.kind == "boosted_bins"  # no job a level, round and class
    got = {r["id"]: r["margins"] for r in bo.forest_margins(blobs, ours.params["cuts"], ours.stage, 3).collect()}
    gbt = GBTClassifier(maxIter=4, maxDepth=2, stepSize=0.3, seed=42)
    model = OneVsRest(classifier=gbt, featuresCol="fv", labelCol="label").fit(blobs.withColumn("fv", array_to_vector("features")))
    want = model.transform(blobs.withColumn("fv", array_to_vector("features"))).select("id", vector_to_array("rawPrediction").alias("r")).collect()
    assert len(want) == 400
    for r in want:
        assert got[r["id"]] == pytest.approx(r["r"], abs=1e-4)


def test_both_ways_and_a_class_without_rows(spark, blobs):
    plans = [bo.Plan(3, 3, 0.3, against=c) for c in range(4)]  # class 3 has no row
    cuts, trees, _ = bo.boost(blobs, plans, classes=1)
    _, level_trees, _ = bo.boost(blobs, plans, classes=1, in_task_cells=0)
    key = lambda df: sorted((r["plan"], r["round"], r["feature"], r["cut"], r["child"], [round(v, 12) for v in r["value"][1:]]) for r in df.collect())
    assert key(trees) == key(level_trees)
    for grown in (trees, level_trees):
        first = grown.where("plan = 3").orderBy("round").first()
        assert first["child"] == [0] and first["value"] == [-1.0]
    scored = md.fit_gbt_ovr(blobs.where("label != 2"), iters=3, depth=2).score(blobs)
    assert scored.where("p2 > p0 and p2 > p1").count() == 0 and scored.where(F.abs(F.col("p0") + F.col("p1") + F.col("p2") - 1) > 1e-9).count() == 0
