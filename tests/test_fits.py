"""Fits by whole passes against Spark's own, and against what they must be able to tell apart."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import SparseVector, Vectors, VectorUDT
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexispark.operators import classify, fits

SCHEMA = T.StructType([T.StructField("v", VectorUDT()), T.StructField("y", T.StringType()), T.StructField("k", T.LongType())])


def some(spark, rows=300, width=40, classes=4, seed=2):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(rows):
        c = int(rng.integers(classes))
        places = sorted({int(x) for x in rng.integers(0, width, 5)} | {c, classes + c})
        out.append((SparseVector(width, places, (1.0 + rng.integers(0, 3, len(places))).tolist()), f"c{c if rng.random() < 0.9 else rng.integers(classes)}", i))
    return spark.createDataFrame(out + [(SparseVector(width, [], []), "c0", rows), (Vectors.dense([1.0] * width), "c1", rows + 1), (SparseVector(width, [1], [1.0]), None, rows + 2)], SCHEMA).repartition(5)


def test_all_regressions_at_once_are_the_single_ones(spark):
    d = some(spark)
    labels, weights, bias = fits.logistic_of_all(d, "v", "y", ridge=0.01, rounds=200, tolerance=1e-11)
    assert labels == ["c0", "c1", "c2", "c3"]
    for k, name in enumerate(labels):
        one = LogisticRegression(regParam=0.01, maxIter=500, tol=1e-10, standardization=False, featuresCol="v", labelCol="t").fit(d.where("y is not null").withColumn("t", (F.col("y") == name).cast("double")))
        assert np.abs(one.coefficients.toArray() - weights[k]).max() < 1e-3 and abs(one.intercept - bias[k]) < 1e-3


@pytest.mark.parametrize("fit", [lambda d, **o: fits.logistic_of_all(d, "v", "y", rounds=20, **o), lambda d, **o: fits.network_of_words(d, "v", "y", units=8, rounds=5, **o)])
def test_a_weight_stands_for_equal_rows(spark, fit):
    few = some(spark, rows=60).withColumn("n", F.col("k") % 4 + 1)
    (names, *many), (same, *once) = fit(few.withColumn("n", F.explode(F.sequence(F.lit(1), "n")))), fit(few, weight="n")
    flat = lambda found: np.concatenate([np.ravel(x) for part in found for x in (part if isinstance(part, list) else [part])])
    assert names == same and np.abs(flat(many) - flat(once)).max() < 1e-3


def jobs(spark, run):
    spark.sparkContext.setJobGroup("fit", "fit")
    before = set(spark.sparkContext.statusTracker().getJobIdsForGroup("fit"))
    run()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(set(spark.sparkContext.statusTracker().getJobIdsForGroup("fit")) - before)


def test_jobs_grow_neither_with_classes_nor_with_partitions(spark):
    few, many = some(spark, classes=2), some(spark, rows=400, width=60, classes=20).repartition(30)
    run = lambda d: lambda: fits.logistic_of_all(d, "v", "y", rounds=8, tolerance=0.0)
    # steps that were halved take a pass more
    assert jobs(spark, run(many)) <= jobs(spark, run(few)) + 10
    boosted = lambda d: lambda: classify.boosted_linear(rounds=3)(d, "v", "y")
    assert jobs(spark, boosted(many)) == jobs(spark, boosted(few))


def test_network_learns_what_no_linear_model_can(spark, tmp_path):
    """Exclusive or of two words, among words that say nothing."""
    rng = np.random.default_rng(1)
    rows = []
    for i in range(400):
        a, b = rng.integers(2, size=2)
        places = sorted({int(x) for x in rng.integers(2, 30, 2)} | ({0} if a else set()) | ({1} if b else set()))
        rows.append((SparseVector(30, places, [1.0] * len(places)), "odd" if a != b else "even", i))
    d = spark.createDataFrame(rows, SCHEMA).repartition(3)
    model = classify.network_of_words(units=32, rounds=150, rate=0.05)(d, "v", "y")
    out = model.predict(d, "v").collect()
    assert np.mean([r.prediction == r.y for r in out]) > 0.95 and all(0.5 <= r.prob <= 1 for r in out)
    model.save(str(tmp_path / "n"))
    again = classify.Network.load(spark, str(tmp_path / "n")).predict(d, "v").collect()
    assert {r.k: (r.prediction, round(r.prob, 5)) for r in again} == {r.k: (r.prediction, round(r.prob, 5)) for r in out}
    one, two = classify.network_weights(model)
    assert one.shape == (31, 32) and two.shape == (33, 2)
    labels, layers = fits.network_of_words(d, "v", "y", units=3, rounds=1)
    assert labels == ["even", "odd"] and [x.shape for x in layers] == [(30, 3), (3,), (3, 2), (2,)]


@pytest.mark.parametrize("train", [classify.logistic_of_all(), classify.network_of_words(units=16, rounds=60, rate=0.03), classify.boosted_linear(), classify.discriminant()])
def test_odd_rows_and_saved_models(spark, tmp_path, train):
    d = some(spark)
    model = train(d, "v", "y")
    out = model.predict(d, "v").collect()
    assert len(out) == 303 and np.mean([r.prediction == r.y for r in out if r.y]) > 0.75
    model.save(str(tmp_path / "m"))
    again = type(model).load(spark, str(tmp_path / "m")).predict(d, "v").collect()
    assert {r.k: r.prediction for r in again} == {r.k: r.prediction for r in out}
    with pytest.raises(ValueError):
        train(d.where("false"), "v", "y") if not isinstance(model, classify.LinearScores) else fits.packed(d.where("false"), "v", "y")
