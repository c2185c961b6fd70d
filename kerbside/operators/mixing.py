"""Source mixing of training rows: balanced and aligned weights, paired arms, decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbside.operators.models import fold_medians
from kerbside.operators.quantiles import weighted_quantiles, weighted_quantiles_by_cell, with_quantiles
from kerbside.staging import broadcast_if_small, written


def _rows(times: str | None) -> Column:
    """How many rows there are, each counted ``times``."""
    return F.sum(times) if times else F.count(F.lit(1))


def source_weights(df: DataFrame, source: str, by: list[str] | None = None, times: str | None = None) -> DataFrame:
    """MOD-17: ``df`` with ``weight``: every source has the same total within ``by``, and weights average 1.

    Counts are few rows joined back; no window over the data. With ``times`` a row stands for that many.
    """
    by = by or []
    counts = df.groupBy(*by, source).agg(_rows(times).alias("__n"))
    whole = Window.partitionBy(*by)
    weights = counts.select(*[F.col(c).alias(f"__{c}") for c in [*by, source]], (F.sum("__n").over(whole) / F.count(F.lit(1)).over(whole) / F.col("__n")).alias("weight"))
    on = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in [*by, source]]
    return df.join(weights, on).drop(*[f"__{c}" for c in [*by, source]])


#: Sources that a mix may have: factors are a row for each label and source.
MOST_SOURCES = 1000


def alignment_factors(df: DataFrame, source: str, dimension: str, exponent: float, low: float, high: float, prior: float = 200.0, by: list[str] | None = None, times: str | None = None) -> DataFrame:
    """MOD-18: ``by..., source, label, n, factor``: (mean share / own share) to a power shrunk by n / (n + prior), clipped, within ``by``.

    Every source has every label of any source; one it lacks counts as zero rows and gets the upper bound. A null
    source is a source, and there may be ``MOST_SOURCES`` of them. ``prior`` 0 does not shrink. With ``times`` a row stands for that many.
    """
    by = by or []
    label = F.coalesce(F.col(dimension).cast("string"), F.lit("missing"))
    counts = written(df.groupBy(*by, source, label.alias("label")).agg(_rows(times).alias("n")), "alignment-counts")
    sources = counts.groupBy(*[F.col(c).alias(f"__{c}") for c in [*by, source]]).agg(F.sum("n").alias("__all"))
    most = sources.groupBy(*[f"__{c}" for c in by]).count().agg(F.max("count")).first()[0] or 0
    if most > MOST_SOURCES:
        raise ValueError(f"{most} sources; a mix may have {MOST_SOURCES}")
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]
    labels = counts.select(*by, "label").distinct()
    grid = labels.join(broadcast_if_small(written(sources, "alignment-sources")), same) if by else labels.join(F.broadcast(sources))  # at most MOST_SOURCES rows each
    grid = grid.select(*by, F.col(f"__{source}").alias(source), "label", "__all")
    held = counts.select(*[F.col(c).alias(f"__{c}") for c in [*by, source, "label"]], "n")
    full = grid.join(held, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in [*by, source, "label"]], "left").fillna(0, ["n"])
    share = full.withColumn("share", F.col("n") / F.col("__all"))
    mean = F.avg("share").over(Window.partitionBy(*by, "label"))
    power = F.lit(exponent) * F.col("n") / (F.col("n") + prior)
    factor = F.when(F.col("share") > 0, F.pow(mean / F.col("share"), power)).otherwise(high)
    return share.select(*by, source, "label", "n", F.least(F.greatest(factor, F.lit(low)), F.lit(high)).alias("factor"))


def alignment_weights(df: DataFrame, source: str, dimensions: dict[str, tuple[float, float, float]], combined: tuple[float, float] = (0.8, 1.25), final: tuple[float, float] = (0.5, 2.0), by: list[str] | None = None, start: str | None = None, prior: float = 200.0, times: str | None = None) -> DataFrame:
    """MOD-18: ``df`` with ``weight``: the product of its labels' factors, clipped, times ``start`` (a column, or 1), scaled so that each source has the total of ``start`` again, within ``by``.

    A weight outside of ``final`` is an error (as the data are read): clipped factors and balanced sources cannot lead there unless a source is far too small.
    With ``times`` a row stands for that many. Factors and scales are few rows: they go to the rows, and rows are not dealt out by their source or label.
    """
    by = by or []
    rows, factor = df, F.lit(1.0)
    for k, (d, (e, lo, hi)) in enumerate(dimensions.items()):
        f = alignment_factors(df, source, d, e, lo, hi, prior, by, times).select(*[F.col(c).alias(f"__{c}{k}") for c in [*by, source]], F.col("label").alias(f"__label{k}"), F.col("factor").alias(f"__factor{k}"))
        rows = rows.join(broadcast_if_small(written(f, "alignment-factors")), [*[F.col(c).eqNullSafe(F.col(f"__{c}{k}")) for c in [*by, source]], F.coalesce(F.col(d).cast("string"), F.lit("missing")) == F.col(f"__label{k}")])
        factor = factor * F.col(f"__factor{k}")
    first, each = F.col(start) if start else F.lit(1.0), F.col(times) if times else F.lit(1)
    clipped = rows.select(*df.columns, (F.least(F.greatest(factor, F.lit(combined[0])), F.lit(combined[1])) * first).alias("__w"))
    totals = clipped.groupBy(*[F.col(c).alias(f"__{c}") for c in [*by, source]]).agg((F.sum(first * each) / F.sum(F.col("__w") * each)).alias("__scale"))
    weight = F.col("__w") * F.col("__scale")
    checked = F.when(weight.between(final[0] - 1e-9, final[1] + 1e-9), weight).otherwise(F.raise_error(F.concat(F.lit("a weight is out of bounds: "), weight.cast("string"))).cast("double"))
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in [*by, source]]
    return clipped.join(broadcast_if_small(written(totals, "alignment-scales")), same).withColumn("weight", checked).select(*[c for c in df.columns if c != "weight"], "weight")


def weighted_predictions(df: DataFrame, weighted: DataFrame, fold: str, by: str, y: str) -> DataFrame:
    """MOD-20: ``df`` once for each ``arm`` with ``p``: the weighted median of ``y`` by label (else of all) over the arm's training rows for the row's fold.

    ``weighted`` has a row for each ``arm``, ``for_fold`` and training row, with ``by``, ``y`` and ``weight``, so treatments differ by
    weights, not by rows.
    """
    rows = written(weighted.select("arm", "for_fold", F.col(by).alias("__by"), F.col(y).alias("__y"), "weight"), "weighted-rows")
    median = lambda keys, name: weighted_quantiles(rows, F.col("__y"), keys, ["0.5"], F.col("weight"), stored=True).select(*[F.col(c).alias(f"__{c}") for c in keys], F.get("values", F.lit(0)).alias(name))
    own, every = median(["arm", "for_fold", "__by"], "__own"), median(["arm", "for_fold"], "__every")
    arms = rows.select(F.col("arm").alias("__a")).distinct().groupBy().agg(F.collect_set("__a").alias("__arms"))  # a few names
    out = df.join(F.broadcast(arms)).withColumn("arm", F.explode("__arms")).drop("__arms")
    mine = (F.col("arm") == F.col("__arm")) & (F.col(fold) == F.col("__for_fold"))
    found = out.join(broadcast_if_small(written(own, "weighted-medians")), mine & F.col(by).eqNullSafe(F.col("____by")), "left").drop("__arm", "__for_fold", "____by")
    return found.join(F.broadcast(every), mine, "left").withColumn("p", F.coalesce("__own", "__every")).drop("__own", "__every", "__arm", "__for_fold")  # a row for each arm and fold


def weighted_predictions_by_cell(df: DataFrame, weights: DataFrame, cell: list[str], fold: str, by: str, y: str, stored: bool = False) -> DataFrame:
    """MOD-20: :func:`weighted_predictions` where a row's weight depends on its ``cell`` (columns, ``by`` among them) alone: ``weights`` has a row for each ``arm``, ``for_fold`` and cell.

    Training rows are counted by cell and expanded neither to arms nor to folds.
    """
    label = F.col(by).cast("string")
    to = F.explode(F.array(F.struct(F.lit(True).alias("all"), F.lit(None).cast("string").alias("label")), F.struct(F.lit(False).alias("all"), label.alias("label")))).alias("__to")
    served = weights.select("arm", "for_fold", *cell, "weight", to).select("arm", "for_fold", *cell, "weight", F.col("__to.all").alias("__all"), F.col("__to.label").alias("__label"))
    found = weighted_quantiles_by_cell(df, F.col(y), cell, served, ["arm", "for_fold", "__all", "__label"], ["0.5"], stored)
    found = written(found.select(F.col("arm").alias("__arm"), F.col("for_fold").alias("__for"), "__all", "__label", F.get("values", F.lit(0)).alias("__m")), "weighted-medians")
    every = found.where("__all").groupBy(F.col("__for").alias("__every_for")).agg(F.collect_list(F.struct(F.col("__arm").alias("arm"), F.col("__m").alias("m"))).alias("__every"))
    own = found.where("not __all").groupBy("__for", "__label").agg(F.map_from_entries(F.collect_list(F.struct("__arm", "__m"))).alias("__own"))
    placed = df.join(F.broadcast(every), F.col(fold) == F.col("__every_for")).join(broadcast_if_small(written(own, "weighted-medians-by-label")), (F.col(fold) == F.col("__for")) & label.eqNullSafe(F.col("__label")), "left")  # a row for each fold
    return placed.select(*df.columns, "__own", F.explode("__every").alias("__e")).select(*df.columns, F.col("__e.arm").alias("arm"), F.coalesce(F.try_element_at("__own", F.col("__e.arm")), F.col("__e.m")).alias("p"))


def weight_diagnostics(df: DataFrame, by: list[str], times: str | None = None) -> DataFrame:
    """MOD-19: extremes, mean, median, total and effective sample size (sum squared over sum of squares) of weights, and its share of the rows. With ``times`` a row stands for that many."""
    w, n, each = F.col("weight"), _rows(times), F.col(times) if times else F.lit(1)
    total = F.sum(w * each)
    effective = total * total / F.sum(w * w * each)
    base = df.groupBy(*by).agg(n.alias("n"), F.min(w).alias("min"), F.max(w).alias("max"), (total / n).alias("mean"), total.alias("total"), effective.alias("effective"), (effective / n).alias("effective_share"))
    return with_quantiles(base, df, {"median": (w, 0.5)}, by, times)


def extreme_factors(factors: DataFrame, source: str, k: int = 3) -> DataFrame:
    """MOD-19: of ``source, label, factor`` the ``k`` lowest and highest of every source, with their ranks; ties by label."""
    low, high = (F.row_number().over(Window.partitionBy(source).orderBy(o, "label")) for o in (F.asc("factor"), F.desc("factor")))
    return factors.select(source, "label", "factor", low.alias("lowest"), high.alias("highest")).where((F.col("lowest") <= k) | (F.col("highest") <= k))


def paired_arms(df: DataFrame, fold: str, folds: int, arms: dict[str, Column], by: str, y: str) -> DataFrame:
    """MOD-15: predictions of every arm for every row: the median of ``by`` in the arm's training rows of the other folds.

    Rows are expanded to their arms only; counts, not rows, are added up for the folds that they serve. A label without training rows falls back to the arm's median of all.
    """
    names = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in arms.items()]), lambda x: x.isNotNull())
    train = df.select(F.explode(names).alias("__a"), fold, by, y)
    every, own = fold_medians(train, fold, folds, y, by, "__a")
    rows = df.withColumn("arm", F.explode(F.array(*[F.lit(n) for n in arms])))
    mine = (F.col("arm") == F.col("__arm")) & (F.col(fold) == F.col("__for"))
    found = rows.join(broadcast_if_small(own), mine & F.col(by).cast("string").eqNullSafe(F.col("__by")), "left").drop("__arm", "__for", "__by")
    return found.join(F.broadcast(every), mine, "left").withColumn("p", F.coalesce("__own", "__every")).drop("__own", "__every", "__arm", "__for")  # a row for each arm and fold


def mixing_decision(metrics: DataFrame, base: str, max_regression: float = 0.05, min_gain: float = 0.01) -> DataFrame:
    """MOD-16: of ``arm, source, mae`` each arm's pooled gain, its worst regression by source, whether it passes, and which wins.

    ``metrics`` has a row with a null source for the pooled value. The winner has the smallest pooled error
    among the arms that pass; the base arm always does.
    """
    ref = metrics.where(F.col("arm") == base).select(F.col("source").alias("__s"), F.col("mae").alias("__m"))
    change = metrics.join(ref, F.col("source").eqNullSafe(F.col("__s"))).withColumn("change", F.col("mae") / F.col("__m") - 1)
    arms = change.groupBy("arm").agg(F.max(F.when(F.col("source").isNull(), F.col("mae"))).alias("pooled"), (-F.max(F.when(F.col("source").isNull(), F.col("change")))).alias("gain"), F.max(F.when(F.col("source").isNotNull(), F.col("change"))).alias("worst"))
    passed = (F.col("arm") == base) | (F.col("gain") >= min_gain) & (F.col("worst") <= max_regression)
    judged = arms.withColumn("passed", passed)
    best = judged.where("passed").agg(F.min_by("arm", F.struct("pooled", "arm")).alias("__best"))
    return judged.join(F.broadcast(best)).withColumn("chosen", F.col("arm") == F.col("__best")).drop("__best")


def weighting_decision(metrics: DataFrame, base: str, order: list[str], near: float = 0.005, limits: dict[str, float] | None = None) -> DataFrame:
    """MOD-20: every treatment's gates, whether it passes, and the one chosen: the simplest (first in ``order``) within ``near`` of the best that passes.

    ``metrics`` is wide, one row for each ``arm``: ``pooled, worst_fold, source_worst, rmse, high_price_mae,
    p90_ae, effective_share, max_weight``. Errors are compared with those of ``base`` (relative change at most the
    limit); the effective share of rows must not fall below its limit nor the largest weight rise above its own.
    The base always passes.
    """
    limits = {"pooled": 0.0, "worst_fold": 0.01, "source_worst": 0.05, "rmse": 0.02, "high_price_mae": 0.05, "p90_ae": 0.02, "effective_share": 0.9, "max_weight": 1.5} | (limits or {})
    errors = [c for c in limits if c not in ("effective_share", "max_weight")]
    ref = metrics.where(F.col("arm") == base).agg(*[F.first(c).alias(f"__{c}") for c in errors])
    fails = [(c, F.col(c) / F.col(f"__{c}") - 1 > limits[c]) for c in errors] + [("effective_share", F.col("effective_share") < limits["effective_share"]), ("max_weight", F.col("max_weight") > limits["max_weight"])]
    failed = F.when(F.col("arm") != base, F.array_join(F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), name) for name, bad in fails])), ",")).otherwise("")
    judged = metrics.join(F.broadcast(ref)).withColumn("failed", failed).withColumn("passed", F.col("failed") == "")
    best = judged.where("passed").agg(F.min("pooled").alias("__least"))
    place = F.array_position(F.array(*[F.lit(x) for x in order]), F.col("arm"))
    close = judged.join(F.broadcast(best)).withColumn("near_best", F.col("passed") & (F.col("pooled") <= F.col("__least") * (1 + near))).drop("__least")
    chosen = close.where("near_best").agg(F.min_by("arm", place).alias("__arm"))
    return close.join(F.broadcast(chosen)).withColumn("chosen", F.col("arm") == F.col("__arm")).drop("__arm", *[f"__{c}" for c in errors])
