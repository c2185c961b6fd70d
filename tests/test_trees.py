"""Trees grown from sums by cell are MLlib's trees."""

import pytest
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from kerbside.operators import models, trees
from kerbside.plans.learning import CATEGORICAL, INPUTS, NUMERIC, counted_design, prepared
from kerbside.staging import written

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    return written(prepared(spark, SF).select("row_id", "fold", *INPUTS, "y"), "t")


def from_rows(rows, candidates):
    """What MLlib makes of the rows themselves."""
    return models.grid(rows, "fold", 5, "row_id", "y", lambda: models.design(NUMERIC, CATEGORICAL), candidates)


def from_cells(rows, candidates):
    return models.grid(rows, "fold", 5, "row_id", "y", counted_design, candidates, inputs=INPUTS)


def predictions(df):
    return {(r.candidate, r.row_id, r.fold, r.y): r.p for r in df.collect()}


def no_fit(*_):
    raise AssertionError("MLlib was asked to fit rows")


def whole_tree(depth, least, bins=64):
    return lambda: RandomForestRegressor(featuresCol="features", labelCol="y", predictionCol="p", numTrees=1, bootstrap=False, subsamplingRate=1.0, featureSubsetStrategy="all", maxDepth=depth, minInstancesPerNode=least, maxBins=bins, seed=7)


def test_trees_without_sampling_are_those_of_mllib(spark, rows, monkeypatch):
    candidates = {"deep": whole_tree(8, 5), "coarse": whole_tree(4, 20, 16)}
    want = predictions(from_rows(rows, candidates))
    monkeypatch.setattr(RandomForestRegressor, "fit", no_fit)
    found = predictions(from_cells(rows, candidates))
    assert found == pytest.approx(want, rel=1e-9) and len(want) > 2 * 5900


def test_forests_do_not_depend_on_partitions_and_err_as_mllib(spark, rows, monkeypatch):
    candidates = {"forest": lambda: models.random_forest("y", 24, 6, 5, "0.5", 0.6)}
    target = rows.withColumn("y", F.coalesce("mileage", F.lit(0)) * 1.0 + 2000 * F.col("age"))
    error = lambda df: df.agg(F.avg(F.abs(F.col("p") - F.col("y")))).first()[0]
    want = error(from_rows(target, candidates))
    monkeypatch.setattr(RandomForestRegressor, "fit", no_fit)
    found = from_cells(target.repartition(7), candidates)
    assert predictions(found) == pytest.approx(predictions(from_cells(target.coalesce(1), candidates)), rel=1e-9)
    assert error(found) == pytest.approx(want, rel=0.1)


def test_samples_are_poisson_numbers_of_their_rate(spark):
    import numpy as np

    digest = spark.range(200_000).select(F.xxhash64("id").alias("h")).toPandas().h.to_numpy().view(np.uint64)
    asked = trees.spec(models.random_forest("y", rows=0.6))
    a, b = (trees.times(digest, asked, t) for t in (0, 1))
    assert a.mean() == pytest.approx(0.6, abs=0.01) and a.var() == pytest.approx(0.6, abs=0.01) and (a == 0).mean() == pytest.approx(np.exp(-0.6), abs=0.005)
    assert abs(np.corrcoef(a, b)[0, 1]) < 0.01


def test_many_cells_are_left_to_mllib(spark, rows, monkeypatch):
    candidates = {"coarse": whole_tree(3, 20)}
    want = predictions(from_cells(rows, candidates))
    monkeypatch.setattr(trees, "MOST_CELLS", 10)
    assert predictions(from_cells(rows, candidates)) == pytest.approx(want, rel=1e-9)
    monkeypatch.setattr(RandomForestRegressor, "fit", no_fit)
    with pytest.raises(AssertionError, match="MLlib"):
        from_cells(rows, candidates)


def test_boosted_trees_without_sampling_are_those_of_mllib(spark, rows, monkeypatch):
    candidates = {loss: (lambda loss=loss, rounds=rounds: models.boosting("y", loss, rounds, 0.3, 3, 20, 1.0, "all")) for loss, rounds in (("squared", 4), ("absolute", 5))}
    want = predictions(from_rows(rows, candidates))
    monkeypatch.setattr(GBTRegressor, "fit", no_fit)
    found = predictions(from_cells(rows, candidates))
    assert found == pytest.approx(want, rel=1e-9) and len(want) > 2 * 5900


def test_boosted_trees_do_not_depend_on_partitions_and_err_as_mllib(spark, rows, monkeypatch):
    candidates = {loss: (lambda loss=loss: models.boosting("y", loss, 6, 0.3, 3, 20, 0.65, "0.8")) for loss in ("squared", "absolute")}
    target = rows.withColumn("y", F.coalesce("mileage", F.lit(0)) * 1.0 + 2000 * F.col("age"))
    error = lambda df: {r.candidate: r.e for r in df.groupBy("candidate").agg(F.avg(F.abs(F.col("p") - F.col("y"))).alias("e")).collect()}
    want = error(from_rows(target, candidates))
    monkeypatch.setattr(GBTRegressor, "fit", no_fit)
    found = from_cells(target.repartition(7), candidates)
    assert predictions(found) == pytest.approx(predictions(from_cells(target.coalesce(1), candidates)), rel=1e-9)
    assert error(found) == pytest.approx(want, rel=0.3)  # of one seed and six rounds: MLlib's own seeds and folds lie between 1,202 and 2,090
