"""Boosting of many fits at once: Spark's own results, in a few jobs."""

import math

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from millrace.plans import boosting, ml


@pytest.fixture(scope="module")
def prepared(spark):
    rows = [(i, float(i * 37 % 101) if i % 3 else 0.0, f"c{i * 7 % 11}", math.sin(i * 0.7) * 10, i * 13 % 29 + (20.0 if i * 7 % 11 > 5 else 0.0) + abs(i * 37 % 101 - 50)) for i in range(1500)]
    df = spark.createDataFrame(rows, "key long, a double, c string, z double, label double").withColumn("held", F.col("key") % 5 == 0)
    stages = [StringIndexer(inputCol="c", outputCol="i", handleInvalid="keep"), OneHotEncoder(inputCols=["i"], outputCols=["o"], handleInvalid="keep"), VectorAssembler(inputCols=["a", "z", "o"], outputCol="features")]
    return Pipeline(stages=stages).fit(df).transform(df).repartition(5, "held").persist()  # parts without rows, and without any to learn from


@pytest.mark.parametrize("block_rows", [10_000, 400])
def test_boosting_is_that_of_spark(prepared, monkeypatch, block_rows):
    monkeypatch.setattr(boosting, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(boosting, "RECENT", 3)
    few, many = GBTRegressor(maxIter=8, maxDepth=3), GBTRegressor(maxIter=8, maxDepth=3, maxBins=64)  # nodes of many rows: of few, splits are alike
    fits = boosting.boost({"all": prepared, "odd": prepared.withColumn("held", F.col("key") % 2 == 0)}, {"few": few, "many": many}, {"all": 1500, "odd": 1500})
    for (name, table), estimator, held in ((("few", "all"), few, F.col("key") % 5 == 0), (("many", "odd"), many, F.col("key") % 2 == 0)):
        ours, theirs = boosting.spark_model(fits[name, table]), estimator.fit(prepared.filter(~held))
        both = ours.transform(prepared).select("key", F.col("prediction").alias("p")).join(theirs.transform(prepared), "key")
        assert both.agg(F.max(F.abs(F.col("p") - F.col("prediction")))).first()[0] < 1e-9
        assert ours.treeWeights == theirs.treeWeights and ours.numFeatures == theirs.numFeatures and ours.totalNumNodes == theirs.totalNumNodes
        assert abs(ours.featureImportances.toArray() - theirs.featureImportances.toArray()).max() < 1e-9
        scored = theirs.transform(prepared.filter(held))
        assert all(abs(fits[name, table].metrics[m] - RegressionEvaluator(metricName=m).evaluate(scored)) < 1e-9 for m in ("r2", "rmse", "mae"))
    boosting.forget(fits.values())


def test_many_values_are_put_together_by_rows():
    values, counts = boosting._grouped(*map(boosting.np.array, (list(range(50_000)), [1.0] * 49_999 + [50_000.0])))
    assert len(values) <= boosting.MOST_VALUES and counts.sum() == 99_999 and values[-1] == 49_999
    cuts = boosting._cuts(values, counts, 3)
    assert all(abs(c - at) < 100 for c, at in zip(cuts, (25_000, 49_999), strict=False))


def test_boosting_takes_few_jobs(spark):
    """A job for each level of each tree of each fit made the time: six fits of 20 trees were 600 jobs and more."""
    df = spark.range(300).select("id", (F.col("id") * 7 % 50).cast("double").alias("x"), (F.col("id") * 11 % 97).cast("double").alias("z"), (F.abs(F.col("id") * 7 % 50 - 25) * 10.0 + F.col("id") * 5 % 13).alias("y"))
    spark.sparkContext.setJobGroup("boosting", "few jobs")
    try:
        trained = ml.train(df, "y", "id", trees=20, folds=2, only=["gradient_boosting", "histogram_boosting"])
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("boosting"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < jobs < 200
    assert [len(c.cross_validation) for c in trained.leaderboard] == [2, 2, 0] and trained.leaderboard[0].metrics["r2"] > 0.8
    # The model that is kept is the one that was measured, and new rows go through it.
    work = trained.model.transform(ml.split(df.withColumn("label", F.col("y")), "id").filter("is_test"))
    assert abs(RegressionEvaluator(metricName="r2").evaluate(work) - trained.leaderboard[0].metrics["r2"]) < 1e-9


def test_numbers_are_measured_as_spark_does(spark):
    scored = spark.createDataFrame([(1e6 + i % 7, 1e6 + i % 5) for i in range(50)], "label double, prediction double")
    got = ml.evaluate(scored, "regression")
    assert all(abs(v - RegressionEvaluator(metricName=m).evaluate(scored)) < 1e-9 for m, v in got.items()) and set(got) == {"r2", "rmse", "mae"}
    assert ml.evaluate(scored, "regression", "r2") == {"r2": got["r2"]}


def test_plans_of_fits_do_not_hold_the_ranking_of_rows(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(ml, "cross_validate", lambda placed, *_: float(plans.append(placed._jdf.queryExecution().optimizedPlan().toString()) or 0))
    df = spark.range(200).select("id", (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 90 * 1.5).alias("y"))
    ml.train(df, "y", "id", folds=2, only=["ridge"])
    assert len(plans) == 2 and not [x for x in plans if "Window" in x]
