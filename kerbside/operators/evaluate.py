"""Evaluation of point predictions: ``y`` is the truth and ``p`` the prediction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbside.operators.profile import distribution, long_slices
from kerbside.operators.quantiles import quantiles, running_sums, with_quantiles

def _metrics(y: str, p: str) -> list[Column]:
    error, n = F.col(p) - F.col(y), F.count(F.lit(1))
    total = n * F.var_pop(F.col(y))
    return [n.alias("n"), F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"), F.when((n >= 2) & (total > 0), 1 - F.sum(error * error) / total).alias("r2")]


def regression_metrics(df: DataFrame, y: str = "y", p: str = "p", by: list[str] | None = None) -> DataFrame:
    """EVL-1: n, MAE, RMSE and R2 (null below two rows or without variance)."""
    return df.groupBy(*(by or [])).agg(*_metrics(y, p))


def slice_metrics(df: DataFrame, by: str, y: str = "y", p: str = "p") -> DataFrame:
    """EVL-2: overall and for each value of ``by``, in one pass over grouping sets; ``overall`` marks the total."""
    return df.select(by, y, p).groupingSets([[], [F.col(by)]], F.col(by)).agg(F.grouping(by).cast("int").alias("overall"), *_metrics(y, p)).select(F.col(by).alias("label"), "overall", "n", "mae", "rmse", "r2")


def point_metrics(df: DataFrame, by: list[str] | None = None, y: str = "y", p: str = "p") -> DataFrame:
    """EVL-3: quantiles of the absolute error, mean and median signed error, and how often (counts and rates) predictions are under, over and exact."""
    e, n = F.col(p) - F.col(y), F.count(F.lit(1))
    sides = (("under", e < 0), ("over", e > 0), ("exact", e == 0))
    base = df.groupBy(*(by or [])).agg(n.alias("n"), F.avg(e).alias("mean_error"), *[F.count_if(c).alias(name) for name, c in sides], *[(F.count_if(c) / n).alias(f"{name}_rate") for name, c in sides])
    return with_quantiles(base, df, {"median_ae": (F.abs(e), 0.5), "p75_ae": (F.abs(e), 0.75), "p90_ae": (F.abs(e), 0.9), "p95_ae": (F.abs(e), 0.95), "median_error": (e, 0.5)}, by)


def slice_diagnostics(df: DataFrame, dimensions: list[str], min_support: int = 200, y: str = "y", p: str = "p") -> DataFrame:
    """EVL-4: metrics of every label of every dimension that has enough rows."""
    return long_slices(df, dimensions, y, p).groupBy("dimension", "label").agg(*_metrics(y, p)).where(F.col("n") >= min_support)


def arm_metrics(df: DataFrame, arm: str, source: str, fold: str, y: str = "y", p: str = "p") -> DataFrame:
    """EVL-5: paired arms by fold and source, with subtotals; a subtotal's column is null and its ``level`` says so."""
    sets = [[F.col(arm)], [F.col(arm), F.col(fold)], [F.col(arm), F.col(source)]]
    return df.select(arm, source, fold, y, p).groupingSets(sets, F.col(arm), F.col(source), F.col(fold)).agg(F.grouping_id(arm, source, fold).cast("int").alias("level"), *_metrics(y, p))


def quantile_labels(df: DataFrame, value: str, name: str = "quartile", probs: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """EVL-6: ``df`` with the quantile band (1 to len+1) of ``value`` in the pooled data; null stays null. Edges are one row."""
    edges = quantiles(df, {"__e": F.col(value)}, list(probs)).agg(F.first("__e").alias("__e"))
    x = F.col(value)
    return df.join(F.broadcast(edges)).withColumn(name, F.when(x.isNotNull(), 1 + F.size(F.filter("__e", lambda e: e < x)))).drop("__e")


def combine_metrics(folds: DataFrame, pooled_variance: Column) -> DataFrame:
    """EVL-7: pooled metrics from ``n, mae, rmse`` of folds and the pooled variance, without rows. R2 without variance is 1 or 0."""
    n, square = F.sum("n"), F.sum(F.col("rmse") * F.col("rmse") * F.col("n"))
    var = F.max(pooled_variance)
    return folds.agg(n.alias("n"), (F.sum(F.col("mae") * F.col("n")) / n).alias("mae"), F.sqrt(square / n).alias("rmse"), F.when(var > 0, 1 - square / (n * var)).when(square == 0, 1.0).otherwise(0.0).alias("r2"))


def fold_stability(folds: DataFrame, metric: str) -> DataFrame:
    """EVL-8: mean, population deviation, extremes and coefficient of variation over folds."""
    m = F.col(metric)
    return folds.agg(F.avg(m).alias("mean"), F.stddev_pop(m).alias("std"), F.min(m).alias("min"), F.max(m).alias("max"), (F.stddev_pop(m) / F.avg(m)).alias("cv"))


def residual_stats(df: DataFrame, dimensions: list[str], k: int = 20, min_support: int = 400, y: str = "y", p: str = "p") -> DataFrame:
    """EVL-9: spread of the absolute residual, and of its ratio to the value, of the ``k`` largest labels of each dimension that have enough rows."""
    r = F.abs(F.col(p) - F.col(y))
    ratio = F.when(F.col(y) != 0, r / F.col(y))
    on = ["dimension", "label"]
    long = long_slices(df, dimensions, y, p)
    stats = long.groupBy(*on).agg(F.count(F.lit(1)).alias("n"), F.avg(r).alias("mean"), F.var_pop(r).alias("variance"), F.avg(ratio).alias("mean_ratio"))
    largest = F.row_number().over(Window.partitionBy("dimension").orderBy(F.desc("n"), "label"))
    top = stats.where(F.col("n") >= min_support).withColumn("__r", largest).where(F.col("__r") <= k).drop("__r")
    columns = {f"q{q}": (r, q / 100) for q in (50, 80, 90, 95)} | {"median_ratio": (ratio, 0.5), "p90_ratio": (ratio, 0.9)}
    return with_quantiles(top, long, columns, on).select(*on, "n", "mean", "variance", "q50", "q80", "q90", "q95", "mean_ratio", "median_ratio", "p90_ratio")


def average_ranks(df: DataFrame, value: str) -> DataFrame:
    """``value`` and ``rank`` of each distinct value: 1-based, ties averaged. Ranks are running sums of counts over ranges that Spark cuts to one size, not one sorted task."""
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    upto = running_sums(counts, [], [F.col(value)], {"__upto": F.col("n")}, "ranks")
    return upto.select(value, (F.col("__upto") - (F.col("n") - 1) / 2.0).alias("rank"))


def error_relationship(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """EVL-10: Pearson correlation of log value and log error, and Spearman's with average ranks."""
    pairs = df.select(F.col(y).alias("v"), F.abs(F.col(p) - F.col(y)).alias("e"))
    ranked = pairs.join(average_ranks(pairs, "v").withColumnRenamed("rank", "rv"), "v").join(average_ranks(pairs, "e").withColumnRenamed("rank", "re"), "e")
    return ranked.agg(F.count(F.lit(1)).alias("n"), F.corr(F.log1p("v"), F.log1p("e")).alias("pearson_log"), F.corr("rv", "re").alias("spearman"))


def quartile_errors(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """EVL-10: rows and mean absolute error of each quartile of the value, and the ratio of the highest mean to the lowest."""
    labelled = quantile_labels(df.select(F.col(y).alias("v"), F.abs(F.col(p) - F.col(y)).alias("e")), "v").where("quartile is not null")
    means = labelled.groupBy("quartile").agg(F.count(F.lit(1)).alias("n"), F.avg("e").alias("mean_error"))
    return means.join(F.broadcast(means.agg((F.max("mean_error") / F.min("mean_error")).alias("highest_to_lowest"))))


def strict_quartiles(df: DataFrame, value: str) -> list[float]:
    """EVL-11: the quartile cutpoints; an error unless they differ."""
    row = distribution(df, value, None, [0.25, 0.5, 0.75]).first()
    cuts = [row["p25"], row["p50"], row["p75"]]
    if None in cuts or len(set(cuts)) < 3:
        raise ValueError(f"quartiles are not distinct: {cuts}")
    return cuts


def rank_segments(segments: DataFrame, metric: str, k: int = 5) -> DataFrame:
    """EVL-12: the best and worst ``k`` labels, ties by label."""
    best, worst = (F.row_number().over(Window.partitionBy("dimension").orderBy(o, "label")) for o in (F.asc(metric), F.desc(metric)))
    ranked = segments.select("dimension", "label", metric, best.alias("best"), worst.alias("worst"))
    return ranked.where((F.col("best") <= k) | (F.col("worst") <= k))


def compare_reports(now: DataFrame, prior: DataFrame) -> DataFrame:
    """EVL-13: difference and ratio of each metric of two long reports (``dimension, label, metric, value``).

    Any metrics will do: differences of coverages and ratios of widths are read from the same rows as errors.
    """
    on = ["dimension", "label", "metric"]
    both = now.withColumnRenamed("value", "now").join(prior.withColumnRenamed("value", "prior"), on)
    return both.withColumn("difference", F.col("now") - F.col("prior")).withColumn("ratio", F.when(F.col("prior") != 0, F.col("now") / F.col("prior")))


def confidence_diagnostics(df: DataFrame, label: str, order: list[str], error: Column) -> DataFrame:
    """EVL-14: rows and mean error of each confidence label, and whether errors rise from label to label."""
    place = F.array_position(F.array(*[F.lit(x) for x in order]), F.col(label))
    means = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.avg(error).alias("mean_error")).withColumn("place", place.cast("int"))
    return means.withColumn("ordered", F.coalesce(F.col("mean_error") >= F.lag("mean_error").over(Window.orderBy("place")), F.lit(True)))


def min_slice(metrics: DataFrame, metric: str, min_support: int) -> DataFrame:
    """EVL-16: the smallest value of a metric over supported slices of each dimension."""
    return metrics.where(F.col("n") >= min_support).groupBy("dimension").agg(F.min(metric).alias(f"min_{metric}"), F.count(F.lit(1)).alias("slices"))


def reproduction(a: DataFrame, b: DataFrame, rtol: float, atol: float) -> DataFrame:
    """EVL-17: metrics of two reports that are not equal within tolerance, or that one lacks."""
    both = a.withColumnRenamed("value", "left").join(b.withColumnRenamed("value", "right"), ["dimension", "label", "metric"], "full_outer")
    same = F.abs(F.col("left") - F.col("right")) <= atol + rtol * F.abs(F.col("right"))
    return both.withColumn("delta", F.abs(F.col("left") - F.col("right"))).where(~F.coalesce(same, F.lit(False)))


def report_long(metrics: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """SNK-4: a long report ``dimension, label, metric, value`` of finite values, from wide metrics."""
    pairs = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])
    return metrics.select(*keys, F.explode(pairs).alias("x")).select(*keys, "x.*").where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf")))
