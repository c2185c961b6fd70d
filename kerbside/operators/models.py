"""Fold-local preparation, baselines, MLlib models, and their evaluation and selection."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, GeneralizedLinearRegression, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbside.functions import scalars as S
from kerbside.operators import trees
from kerbside.operators.preparation import Preparation
from kerbside.operators.quantiles import quantiles_without
from kerbside.operators.rules import Rule, first_failure
from kerbside.schema import FeatureContract
from kerbside.staging import broadcast_if_small, written


def engineer(df: DataFrame, contract: FeatureContract, year: str = "year", mileage: str = "mileage") -> DataFrame:
    """MOD-1: ``df`` with model year, age, mileage per year and a missing flag."""
    y, m = F.col(year), F.col(mileage)
    return df.withColumns({"model_year": y, "age": S.age_years(y, contract.reference_year), "mileage_per_year": S.mileage_per_year(m, y, contract.reference_year), "mileage_missing": m.isNull().cast("int")})


def serving(df: DataFrame, fold: str, folds: int) -> DataFrame:
    """Rows once for each fold whose model they train, as ``for_fold``."""
    return df.withColumn("for_fold", F.explode(F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda f: f != F.col(fold))))


def fit_medians(df: DataFrame, columns: list[str], fold: str, folds: int) -> DataFrame:
    """MOD-2: exact medians of numeric columns for every training fold, one job."""
    long = df.select(fold, F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")).select(fold, "x.*")
    found = quantiles_without(long, F.col("v"), [0.5], ["c"], fold, folds)
    return found.groupBy(F.col("without").alias("for_fold")).agg(*[F.max(F.when(F.col("c") == c, F.get("q", F.lit(0)))).alias(c) for c in columns])


def fit_scale(df: DataFrame, columns: list[str], fold: str, folds: int) -> DataFrame:
    """MOD-3: population deviations for every training fold; 1 where there is none."""
    dev = lambda c: F.coalesce(F.nullif(F.stddev_pop(F.col(c).cast("double")), F.lit(0.0)), F.lit(1.0))
    return serving(df, fold, folds).groupBy("for_fold").agg(*[dev(c).alias(c) for c in columns])


def fit_vocabulary(df: DataFrame, columns: list[str], fold: str, folds: int, min_frequency: int = 25, max_categories: int = 512) -> DataFrame:
    """MOD-4: ``for_fold, column, value, n, level`` for every training fold; rare values share the level ``__infrequent__``."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")), F.lit("__missing__")).alias("value")) for c in columns])).alias("x")
    counts = serving(df.select(fold, pairs), fold, folds).groupBy("for_fold", "x.column", "x.value").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("for_fold", "column").orderBy(F.desc("n"), "value")
    ranked = counts.withColumn("__r", F.row_number().over(order)).withColumn("__d", F.count(F.lit(1)).over(Window.partitionBy("for_fold", "column")))
    keep = (F.col("n") >= min_frequency) & ((F.col("__d") <= max_categories) | (F.col("__r") < max_categories))
    return ranked.select("for_fold", "column", "value", "n", F.when(keep, F.col("value")).otherwise("__infrequent__").alias("level"))


def fold_medians(df: DataFrame, fold: str, folds: int, y: str, by: str | None = None, arm: str | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Medians over the training rows of every fold: ``__arm, __for, __every`` of all rows and ``__arm, __for, __by, __own`` of each label of ``by``; one call for both."""
    label = F.struct(F.lit(False).alias("all"), F.col(by).cast("string").alias("by")) if by else None
    whole = F.struct(F.lit(True).alias("all"), F.lit(None).cast("string").alias("by"))
    rows = df.select(F.col(fold).alias("__fold"), (F.col(arm) if arm else F.lit("")).alias("__arm"), F.col(y).alias("__y"), F.explode(F.array(whole, label) if by else F.array(whole)).alias("__l")).select("__fold", "__arm", "__y", "__l.*")
    found = quantiles_without(rows, F.col("__y"), [0.5], ["__arm", "all", "by"], "__fold", folds)
    found = written(found.select("__arm", F.col("without").alias("__for"), "all", "by", F.get("q", F.lit(0)).alias("median")), "fold-medians")
    every = found.where("all").select("__arm", "__for", F.col("median").alias("__every"))
    return every, found.where("not all").select("__arm", "__for", F.col("by").alias("__by"), F.col("median").alias("__own")) if by else None


def median_baseline(df: DataFrame, fold: str, folds: int, y: str, by: str | None = None) -> DataFrame:
    """MOD-6: ``df`` with ``p``: the median of the training folds, of its label if ``by`` is given (else, and for new labels, of all)."""
    every, own = fold_medians(df, fold, folds, y, by)
    out = df.join(F.broadcast(every.drop("__arm")), F.col(fold) == F.col("__for"), "left").drop("__for")  # a row for each fold
    if by is None:
        return out.withColumnRenamed("__every", "p")
    joined = out.join(broadcast_if_small(own.drop("__arm")), (F.col(fold) == F.col("__for")) & F.col(by).cast("string").eqNullSafe(F.col("__by")), "left").drop("__for", "__by")
    return joined.withColumn("p", F.coalesce("__own", "__every")).drop("__own", "__every")


def design(numeric: list[str], categorical: list[str], min_frequency: int = 25, max_categories: int = 512, times: str | None = None) -> list:
    """MOD-5: pipeline stages for a sparse design matrix ``features``, learned from the training rows alone, each of which may stand for ``times`` rows."""
    return [Preparation(numeric=numeric, categorical=categorical, minFrequency=min_frequency, maxCategories=max_categories, timesCol=times)]


def summed(df: DataFrame, by: list[str], y: str, times: str = "n") -> DataFrame:
    """Rows that agree in ``by`` (null is a value) as one, with their number ``times`` and their mean ``y``; written.

    Least squares, and a gamma model with log link, have the same solution on these as on the rows, if ``by`` has all their inputs and a row
    counts ``times``. Where inputs repeat there are far fewer; where they do not, this is one shuffle.
    """
    return written(df.groupBy(*by).agg(F.count(F.lit(1)).alias(times), F.avg(F.col(y).cast("double")).alias(y)), "summed")


def linear(y: str, weight: str | None = None) -> LinearRegression:
    """MOD-7; with ``weight`` a row counts that many times."""
    more = {"weightCol": weight} if weight else {}
    return LinearRegression(featuresCol="features", labelCol=y, predictionCol="p", regParam=1e-6, solver="auto", **more)


#: MOD-8: trees, depth, least rows of a leaf, share of features, share of rows. Depth bounds the trees, as leaf counts cannot.
FORESTS = {"f1": (24, 9, 5, "0.5", 0.6), "f2": (32, 10, 15, "0.7", 0.8), "f3": (40, 11, 15, "0.7", 0.8), "f4": (40, 10, 30, "1.0", 0.8), "f5": (32, 11, 30, "0.5", 1.0), "f6": (24, 10, 5, "1.0", 0.6)}
#: MOD-9: loss, rounds, step, depth, least rows of a leaf, share of rows, share of features. MLlib has no Huber loss; absolute loss is the robust one it has.
BOOSTED = {
    "g1": ("squared", 12, 0.3, 2, 20, 0.8, "0.8"), "g2": ("squared", 18, 0.2, 2, 20, 0.65, "0.8"), "g3": ("squared", 24, 0.15, 3, 50, 0.65, "0.5"),
    "g4": ("absolute", 18, 0.2, 2, 20, 0.65, "0.8"), "g5": ("absolute", 24, 0.15, 2, 50, 0.8, "0.5"), "g6": ("absolute", 12, 0.3, 3, 50, 0.65, "0.5"),
}


def random_forest(y: str, trees: int = 24, depth: int = 9, min_rows: int = 5, features: str = "0.5", rows: float = 0.6) -> RandomForestRegressor:
    """MOD-8."""
    return RandomForestRegressor(featuresCol="features", labelCol=y, predictionCol="p", numTrees=trees, maxDepth=depth, minInstancesPerNode=min_rows, featureSubsetStrategy=features, subsamplingRate=rows, seed=7, maxBins=64)


def boosting(y: str, loss: str = "absolute", rounds: int = 18, step: float = 0.2, depth: int = 2, min_rows: int = 20, rows: float = 0.65, features: str = "0.8") -> GBTRegressor:
    """MOD-9."""
    return GBTRegressor(featuresCol="features", labelCol=y, predictionCol="p", lossType=loss, maxIter=rounds, stepSize=step, maxDepth=depth, minInstancesPerNode=min_rows, subsamplingRate=rows, featureSubsetStrategy=features, seed=7, maxBins=64)


def residual_scale(y: str, weight: str | None = None) -> GeneralizedLinearRegression:
    """MOD-10: a gamma model with log link for the size of residuals; with ``weight`` a row counts that many times."""
    more = {"weightCol": weight} if weight else {}
    return GeneralizedLinearRegression(featuresCol="features", labelCol=y, predictionCol="scale", family="gamma", link="log", regParam=1.0, maxIter=25, **more)


#: MOD-10: predictions are measured against this price before the logarithm; scales stay within these bounds.
REFERENCE_PRICE, SCALE_BOUNDS = 10_000.0, (500.0, 250_000.0)


def staged_scale(df: DataFrame, fold: str, folds: int, y: str, stages: Callable[[], list], scale_stages: Callable[[str], list], inputs: list[str], times: str = "n", p: str = "p") -> DataFrame:
    """MOD-10: ``df`` once for each outer fold and role (``for_fold``, ``role``) with ``p`` and ``scale``, so that no row meets a stage that has seen it.

    For outer fold f the value is fitted on all folds but f, f+1 and f+2 (counted around); the scale of residuals, a
    model of ``scale_stages`` that also sees ``log_value``, on the residuals of fold f+2; rows of fold f+1 have the role
    ``calibrate`` and those of f ``validate``. Scales are kept within ``SCALE_BOUNDS``. Both models are fitted on rows :func:`summed` by ``inputs``, so stages must count a row ``times``.
    """
    if folds < 4:
        raise ValueError("a value, a scale, a radius and a validation need four folds")
    rows = written(df, "staged")
    known = summed(rows, [fold, *inputs], y, times)

    def one(f: int) -> DataFrame:
        value = Pipeline(stages=stages()).fit(known.where(~F.col(fold).isin(*[(f + k) % folds for k in range(3)])))
        valued = value.transform(rows.where(F.col(fold).isin(*[(f + k) % folds for k in range(3)]))).withColumn(p, F.greatest(F.col(p), F.lit(0.0)))
        valued = valued.withColumn("log_value", F.log1p(F.col(p) / REFERENCE_PRICE)).withColumn("size", F.greatest(F.abs(F.col(y) - F.col(p)), F.lit(1.0)))
        valued = written(valued.select(*rows.columns, p, "log_value", "size"), "staged-values")
        scale = Pipeline(stages=scale_stages("size")).fit(summed(valued.where(F.col(fold) == (f + 2) % folds), [*inputs, "log_value"], "size", times))
        scaled = scale.transform(valued.where(F.col(fold) != (f + 2) % folds)).withColumn("scale", S.clip(F.col("scale"), *SCALE_BOUNDS))
        role = F.when(F.col(fold) == f, "validate").otherwise("calibrate").alias("role")
        return scaled.select(*rows.columns, p, "scale", F.lit(f).alias("for_fold"), role)

    with ThreadPoolExecutor(min(folds, 4)) as pool:
        return written(reduce(DataFrame.unionByName, list(pool.map(one, range(folds)))), "staged-scales")


def grid(df: DataFrame, fold: str, folds: int, key: str, y: str, prepare: Callable[[], list], candidates: dict[str, Callable[[], object]], out: str = "p", inputs: list[str] | None = None, times: str = "n") -> DataFrame:
    """MOD-8/9/11: ``candidate, key, fold, y, p`` of every candidate on the same folds: features are fitted once a fold, models one after the other.

    With ``inputs`` features are fitted on rows :func:`summed` by them, so ``prepare`` must count a row ``times``; models always see the rows themselves,
    but forests and boosted trees see what they need of them by cell of equal inputs (:mod:`trees`), unless those are too many.
    """
    if inputs:
        df = df.select(*dict.fromkeys([key, fold, y, *inputs]))
    rows = written(df, "grid")
    known = summed(rows, [fold, *inputs], y, times) if inputs else rows
    asked = {name: trees.spec(make()) for name, make in candidates.items()} if inputs else {}
    asked = {name: a for name, a in asked.items() if a}
    planted = _planted(rows, known, fold, folds, key, y, prepare, asked, out, inputs, times) if asked else None
    if planted is not None:
        candidates = {name: make for name, make in candidates.items() if name not in asked}
        if not candidates:
            return planted

    def one(f: int) -> list[DataFrame]:
        train, test = rows.where(F.col(fold) != f), rows.where(F.col(fold) == f)
        features = Pipeline(stages=prepare()).fit(known.where(F.col(fold) != f))
        seen = written(features.transform(train).select("features", y), "grid-train")
        asked = written(features.transform(test).select(key, fold, y, "features"), "grid-test")
        return [make().fit(seen).transform(asked).select(F.lit(name).alias("candidate"), key, fold, y, out) for name, make in candidates.items()]

    with ThreadPoolExecutor(min(folds, 5)) as pool:
        return reduce(DataFrame.unionByName, [d for found in pool.map(one, range(folds)) for d in found] + ([] if planted is None else [planted]))


def _planted(rows: DataFrame, known: DataFrame, fold: str, folds: int, key: str, y: str, prepare: Callable[[], list], asked: dict[str, trees.Spec], out: str, inputs: list[str], times: str) -> DataFrame | None:
    """The part of :func:`grid` for tree models, grown from sums by cell; none if there are too many cells or features of them for that, or rows without a fold from 0."""
    cells = trees.numbered(known, inputs)
    if cells is None:
        return None

    def features(f: int) -> np.ndarray | None:
        made = Pipeline(stages=prepare()).fit(known.where(F.col(fold) != f)).transform(cells).select("cell", "features")
        first = made.first()
        if first["features"].size * size > trees.MOST_FEATURES:
            return None
        found = made.select("cell", vector_to_array("features").alias("x")).toArrow()
        x = found.column("x").combine_chunks().flatten().to_numpy().reshape(size, -1)
        return x[found.column("cell").to_numpy().argsort()]

    size = cells.count()
    found = trees.same(known.select(fold, times, *inputs), cells, inputs).select("cell", F.col(fold).cast("int").alias("fold"), times).toArrow()
    if not size or found.column("fold").null_count or not set(found.column("fold").unique().to_pylist()) <= set(range(folds)):
        return None
    counts = np.zeros((size, folds))
    counts[found.column("cell").to_numpy(), found.column("fold").to_numpy()] = found.column(times).to_numpy()
    with ThreadPoolExecutor(min(folds, 5)) as pool:
        made = list(pool.map(features, range(folds)))
    if any(x is None for x in made):
        return None
    binned = lambda f, bins: trees.Binned(made[f], counts.sum(1) - counts[:, f], bins)
    coded = trees.by_code(trees.same(rows, cells, inputs), fold, folds, key, y)
    parts = []
    for plant, boosted in ((trees.forests, False), (trees.boosted, True)):
        names = [name for name, a in asked.items() if bool(a.loss) == boosted]
        if names:
            predicted = cells.join(plant(coded, [asked[name] for name in names], binned, size, folds), "cell").drop("cell")
            parts.append(trees.scored(trees.same(rows, predicted, inputs), names, fold, [key, fold, y], out))
    return reduce(DataFrame.unionByName, parts)


def out_of_fold(df: DataFrame, fold: str, folds: int, key: str, y: str, stages: Callable[[], list], out: str = "p", weigh: Callable[[DataFrame, int], DataFrame] | None = None, inputs: list[str] | None = None, times: str = "n") -> DataFrame:
    """MOD-11: ``key, fold, y, p``: every row scored by a model that was fitted without its fold. Folds run side by side.

    ``weigh`` gives the training rows of a fold their weights, as a column that the stages use. With ``inputs`` models are
    fitted on rows :func:`summed` by them, once for all folds, so stages must count a row ``times``.
    """
    rows = written(df, "oof")
    known = summed(rows, [fold, *inputs], y, times) if inputs else rows

    def one(f: int) -> DataFrame:
        train = known.where(F.col(fold) != f)
        model = Pipeline(stages=stages()).fit(weigh(train, f) if weigh else train)
        return model.transform(rows.where(F.col(fold) == f)).select(key, fold, y, out)

    with ThreadPoolExecutor(min(folds, 4)) as pool:
        return reduce(DataFrame.unionByName, list(pool.map(one, range(folds))))


def holdout(train: DataFrame, test: DataFrame, key: str, y: str, stages: list, out: str = "p") -> DataFrame:
    """MOD-12: one fit on all training rows, one scoring of the test rows."""
    return Pipeline(stages=stages).fit(train).transform(test).select(key, y, out)


def shortlist(results: DataFrame, k: int = 2) -> DataFrame:
    """MOD-13: the ``k`` best candidates of each family by error and id, of candidates that were all scored on the same rows."""
    order = Window.partitionBy("family").orderBy("mae", "candidate")
    same = F.count_distinct("n").alias("shapes")
    ranked = results.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(F.broadcast(results.agg(same))).where("shapes = 1").drop("shapes")


def promote(results: DataFrame, incumbent: str, min_gain: float, min_gain_abs: float, max_regression: float = 0.05, near: float = 0.01, budgets: dict[str, float] | None = None) -> DataFrame:
    """MOD-14: each challenger's gates, and ``promoted``: of those that pass within ``near`` of the best, the smallest, fastest, first.

    ``results`` has ``candidate, mae, rmse, worst_slice_mae, size_mb, latency_ms``; ``budgets`` are upper bounds of
    its resource columns (a null or larger value fails as ``budget:<column>``), looked at last.
    """
    ref = results.where(F.col("candidate") == incumbent).agg(*[F.first(c).alias(f"__{c}") for c in ("mae", "rmse", "worst_slice_mae")])
    gain = F.col("__mae") - F.col("mae")
    rules: list[Rule] = [("gain", (gain < min_gain * F.col("__mae")) | (gain < min_gain_abs)), ("rmse", F.col("rmse") > F.col("__rmse") * (1 + max_regression)), ("slice", F.col("worst_slice_mae") > F.col("__worst_slice_mae") * (1 + max_regression))]
    rules += [(f"budget:{c}", F.col(c).isNull() | (F.col(c) > most)) for c, most in (budgets or {}).items()]
    judged = results.where(F.col("candidate") != incumbent).join(F.broadcast(ref)).withColumn("failed", first_failure(rules))
    best = judged.where("failed is null").agg(F.min("mae").alias("__least"))
    near_best = judged.where("failed is null").join(F.broadcast(best)).where(F.col("mae") <= F.col("__least") * (1 + near)).agg(F.min_by("candidate", F.struct("size_mb", "latency_ms", "candidate")).alias("__winner"))
    return judged.join(F.broadcast(near_best)).select("candidate", "mae", "failed", F.coalesce(F.col("candidate") == F.col("__winner"), F.lit(False)).alias("promoted"))


def unseen_categories(df: DataFrame, vocabulary: DataFrame, columns: list[str]) -> Column | DataFrame:
    """MOD-21: ``df`` with ``unseen``: some category is not in ``vocabulary`` (``column, value``), whatever its case."""
    out = df
    for c in columns:
        known = vocabulary.where(F.col("column") == c).select(F.lower("value").alias(f"__{c}")).distinct()
        out = out.join(known, F.lower(F.col(c)) == F.col(f"__{c}"), "left")
    hit = reduce(lambda a, b: a | b, [F.col(c).isNotNull() & F.col(f"__{c}").isNull() for c in columns])
    return out.withColumn("unseen", hit).drop(*[f"__{c}" for c in columns])


def request_rules(coverages: tuple[float, ...] = (0.8, 0.9, 0.95)) -> list[Rule]:
    """MOD-22: the input contract of a valuation request."""
    c = F.col
    return [("year_invalid", c("year").isNull() | ~c("year").between(1900, 2023)), ("make_missing", S.is_missing(c("make"))), ("mileage_invalid", ~c("mileage").between(0, 500_000)), ("coverage_invalid", ~c("coverage").isin(*coverages))]


def training_events(df: DataFrame, features: list[str], target: str, run: str) -> DataFrame:
    """MOD-23: ``event_key, content_key, features (map without nulls), target``."""
    pairs = [x for c in features for x in (F.lit(c), F.col(c).cast("string"))]
    made = F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull())
    content = S.content_hash(*[F.col(c) for c in features], F.col(target))
    return df.withColumn("features", made).withColumn("content_key", content).withColumn("event_key", F.sha2(F.concat_ws(":", F.lit(run), "content_key"), 256)).select("event_key", "content_key", "features", F.col(target).alias("target"))
