"""Finite-sample conformal intervals, cross-fitting and bootstrap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.operators.profile import long_slices
from kerbside.operators.quantiles import quantiles, values_at, values_without, with_quantiles
from kerbside.operators.relate import lookup_with_fallback
from kerbside.staging import written

COVERAGES = (0.8, 0.9, 0.95)


def rank_wanted(n: Column, coverage: Column) -> Column:
    """ceil((n + 1) * coverage), in double precision."""
    return F.ceil((n + 1).cast("double") * coverage.cast("double")).cast("long")


def order_stats(df: DataFrame, score: str, by: list[str], coverages: tuple[float, ...] = COVERAGES, min_support: int = 0, weight: str | None = None, stored: bool = False) -> DataFrame:
    """CNF-1: ``by, coverage, support, radius``: the k-th smallest score, k = ceil((n + 1) * coverage).

    The radius is null where k exceeds n or support is too small. Null and non-finite scores do not count.
    With ``weight`` a row stands for that many scores; ``stored`` is that of :func:`values_at`.
    """
    levels = F.array(*[F.lit(float(c)) for c in coverages])
    return _tidy(values_at(df, F.col(score), by, lambda n: F.transform(levels, lambda c: rank_wanted(n, c)), weight, stored), by, levels, min_support)


def _tidy(found: DataFrame, by: list[str], coverages: Column, min_support: int) -> DataFrame:
    each = found.select(*by, F.col("n").alias("support"), F.explode(F.arrays_zip(coverages.alias("coverage"), F.col("values").alias("radius"))).alias("x"))
    return each.select(*by, "x.coverage", "support", F.when(F.col("support") >= min_support, F.col("x.radius")).alias("radius"))


def _levels(df: DataFrame, levels: dict[str, list[str]], *keep: str) -> DataFrame:
    """Every row once for each level, with ``level`` and ``key`` (its columns joined by ``|``, a null one ``missing``)."""
    pairs = F.array(*[F.struct(F.lit(level).alias("level"), F.concat_ws("|", F.lit("") if not cols else F.coalesce(F.col(cols[0]).cast("string"), F.lit("missing")), *[F.coalesce(F.col(c).cast("string"), F.lit("missing")) for c in cols[1:]]).alias("key")) for level, cols in levels.items()])
    return df.select(F.explode(pairs).alias("x"), *keep).select("x.*", *keep)


def fit_radii(df: DataFrame, by: str, score: str, min_support: int = 0, coverages: tuple[float, ...] = COVERAGES, stored: bool = False) -> DataFrame:
    """CNF-2: tidy radii ``level, key, coverage, support, radius`` for each value of ``by`` and for all rows; too small ones are left out."""
    return fit_hierarchy(df, {"global": [], by: [by]}, score, min_support, coverages, stored=stored).where("radius is not null")


def fit_hierarchy(df: DataFrame, levels: dict[str, list[str]], score: str, min_support: int = 400, coverages: tuple[float, ...] = COVERAGES, weight: str | None = None, stored: bool = False) -> DataFrame:
    """CNF-3: tidy radii of several levels in one job; a radius is null where support is below the minimum or k exceeds n."""
    long = _levels(df, levels, score, *([weight] if weight else []))
    return order_stats(long, score, ["level", "key"], coverages, min_support, weight, stored)


def apply_intervals(df: DataFrame, radii: DataFrame, levels: list[tuple[str, list[str]]], coverage: float, p: str = "p", clip_upper: bool = False) -> DataFrame:
    """CNF-4: ``df`` with ``lower``, ``upper``, ``radius``, ``support``, ``method`` and ``fallback`` (not the first level).

    The lower bound is clipped at 0; ``clip_upper`` clips the upper one too.
    """
    table = radii.where(F.col("coverage") == coverage).select("level", "key", "radius", "support")
    found = lookup_with_fallback(df, table, levels, "radius", "support")
    upper = F.col(p) + F.col("radius")
    return found.withColumn("lower", F.greatest(F.lit(0.0), F.col(p) - F.col("radius"))).withColumn("upper", F.greatest(F.lit(0.0), upper) if clip_upper else upper).withColumn("fallback", F.col("method") != levels[0][0])


def interval_metrics(df: DataFrame, coverage: float, by: list[str] | None = None, y: str = "y", p: str = "p") -> DataFrame:
    """CNF-6: coverage and its gap, rates under and over, width quantiles, and counts of clipped, fallback, reversed and invalid intervals.

    ``unclipped_coverage`` is that of intervals whose lower end may be negative: equal to ``coverage`` where no
    truth is negative (``clip_changes`` counts the rows that clipping alone decides).
    """
    lower, upper, truth, n = F.col("lower"), F.col("upper"), F.col(y), F.count(F.lit(1))
    width = upper - lower
    inside = truth.between(lower, upper)
    free = truth.between(F.col(p) - F.col("radius"), F.col(p) + F.col("radius")) if "radius" in df.columns else inside
    rate = lambda c: F.count_if(c) / n
    base = df.groupBy(*(by or [])).agg(
        n.alias("n"), rate(inside).alias("coverage"), (rate(inside) - coverage).alias("gap"), rate(truth < lower).alias("under"), rate(truth > upper).alias("over"),
        F.avg(width).alias("mean_width"), F.avg(width / F.greatest(F.col(p), F.lit(1.0))).alias("relative_width"),
        F.count_if(lower == 0).alias("clipped"), F.count_if("fallback").alias("fallbacks"), F.count_if(upper < lower).alias("reversed"),
        F.count_if(lower.isNull() | upper.isNull() | F.isnan(lower) | F.isnan(upper) | (F.abs(upper) == float("inf"))).alias("invalid"), rate(free).alias("unclipped_coverage"), F.count_if(inside != free).alias("clip_changes"),
    )
    return with_quantiles(base, df, {"p10_width": (width, 0.1), "median_width": (width, 0.5), "p90_width": (width, 0.9)}, by)


def crossfit_radii(df: DataFrame, fold: str, folds: int, levels: dict[str, list[str]], score: str, min_support: int, coverages: tuple[float, ...] = COVERAGES) -> DataFrame:
    """CNF-7: tidy radii for each fold from the rows of the other folds, one job for all; a key begins with its fold."""
    long = _levels(df, levels, score, fold)
    at = F.array(*[F.lit(float(c)) for c in coverages])
    found = values_without(long, F.col(score), ["level", "key"], fold, folds, lambda n: F.transform(at, lambda c: rank_wanted(n, c)))
    plain = [level for level, cols in levels.items() if not cols]
    key = F.when(F.col("level").isin(plain), F.col("without").cast("string")).otherwise(F.concat_ws("|", F.col("without").cast("string"), "key"))
    return _tidy(found.withColumn("key", key), ["level", "key"], at, min_support)


def crossfit_intervals(df: DataFrame, fold: str, folds: int, levels: dict[str, list[str]], score: str, coverage: float, min_support: int, p: str = "p") -> DataFrame:
    """CNF-7: every row with the interval that the other folds give it."""
    radii = crossfit_radii(df, fold, folds, levels, score, min_support, (coverage,))
    rows = df.withColumn("__for", F.col(fold))
    return apply_intervals(rows, radii, [(level, ["__for", *cols]) for level, cols in levels.items()], coverage, p).drop("__for")


def crossfit_report(df: DataFrame, coverage: float, fold: str, status: str) -> DataFrame:
    """CNF-7: interval metrics of all rows and of every status, as ``label`` (null: all), with the deviation of their coverages over folds."""
    long = df.withColumn("label", F.explode(F.array(F.lit(None).cast("string"), F.col(status).cast("string"))))
    inside = F.col("y").between(F.col("lower"), F.col("upper")).cast("double")
    folds = long.groupBy("label", fold).agg(F.avg(inside).alias("c")).groupBy(F.col("label").alias("__l")).agg(F.stddev_pop("c").alias("fold_std"))
    return interval_metrics(long, coverage, ["label"]).join(folds, F.col("label").eqNullSafe(F.col("__l"))).drop("__l")


def scaled_intervals(df: DataFrame, scale: str, by: str, coverage: float, y: str = "y", p: str = "p", stored: bool = False) -> DataFrame:
    """CNF-9: intervals whose radius is a quantile of ``|residual| / scale`` times the row's own scale."""
    scored = df.withColumn("__score", F.abs(F.col(y) - F.col(p)) / F.col(scale))
    radii = fit_radii(scored, by, "__score", 0, (coverage,), stored)
    found = lookup_with_fallback(scored, radii, [(by, [by]), ("global", [])], "radius", "support")
    r = F.col("radius") * F.col(scale)
    return found.withColumn("lower", F.greatest(F.lit(0.0), F.col(p) - r)).withColumn("upper", F.col(p) + r).withColumn("fallback", F.col("method") != by).drop("__score")


def staged_intervals(staged: DataFrame, by: str, coverage: float, min_support: int = 0, y: str = "y", p: str = "p") -> DataFrame:
    """CNF-9: the ``validate`` rows of :func:`models.staged_scale` with intervals: the radius comes from the ``calibrate`` rows of the same outer fold, as a quantile of ``|residual| / scale``.

    It is that of the row's ``by``, or of all where support is too small, times the row's own scale.
    """
    scored = staged.withColumn("__score", F.abs(F.col(y) - F.col(p)) / F.col("scale"))
    levels = {by: ["for_fold", by], "global": ["for_fold"]}
    radii = fit_hierarchy(scored.where("role = 'calibrate'"), levels, "__score", min_support, (coverage,)).where("radius is not null")
    found = lookup_with_fallback(scored.where("role = 'validate'"), radii, list(levels.items()), "radius", "support").withColumnRenamed("radius", "factor")
    r = F.col("factor") * F.col("scale")
    return found.withColumn("radius", r).withColumn("lower", F.greatest(F.lit(0.0), F.col(p) - r)).withColumn("upper", F.col(p) + r).withColumn("fallback", F.col("method") != by).drop("__score")


#: Cumulative chances of 0 to 7 for a Poisson number with mean 1; above the last it is 8.
_POISSON = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253]


def bootstrap_weight(seed: str, group: Column, replicate: Column) -> Column:
    """A Poisson(1) number by inversion of a draw that seed, group and replicate fix (48 bits of MD5)."""
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), group.cast("string"), replicate.cast("string"))), 1, 12), 16, 10).cast("double") / float(1 << 48)
    return sum(((u >= c).cast("int") for c in _POISSON), F.lit(0))


def cluster_bootstrap(df: DataFrame, group: str, num: str, den: str, replicates: int = 2000, seed: str = "bootstrap") -> DataFrame:
    """CNF-10: ratio of the sums of ``num`` and ``den``, the mean of their difference, and 95% intervals over replicates that resample whole groups.

    Rows are summed to groups first, then each group's weights are drawn where it lies; sums for each
    replicate are combined before the shuffle, so ``replicates`` rows leave a task and are all that is put in order.
    """
    groups = df.groupBy(group).agg(F.sum(num).alias("a"), F.sum(den).alias("b"), F.count(F.lit(1)).alias("n"))
    drawn = groups.select("a", "b", "n", group, F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("r")).withColumn("w", bootstrap_weight(seed, F.col(group), F.col("r")))
    a, b, n = (F.sum(F.col(c) * F.col("w")) for c in "abn")
    each = written(drawn.groupBy("r").agg((a / b).alias("ratio"), ((a - b) / n).alias("delta")), "bootstrap")
    point = groups.agg((F.sum("a") / F.sum("b")).alias("ratio"), ((F.sum("a") - F.sum("b")) / F.sum("n")).alias("delta"))
    ends = quantiles(each, {"q": F.col("ratio"), "d": F.col("delta")}, [0.025, 0.975]).join(F.broadcast(each.agg(F.count(F.lit(1)).alias("replicates"))))
    end = lambda c, k: F.get(c, F.lit(k))
    return point.join(F.broadcast(ends)).select("ratio", end("q", 0).alias("low"), end("q", 1).alias("high"), "delta", end("d", 0).alias("delta_low"), end("d", 1).alias("delta_high"), "replicates")


def gate_metrics(intervals: DataFrame, coverage: float, dimensions: list[str], price: str, high_price: float, min_support: int = 200, stored: bool = False) -> DataFrame:
    """CNF-8/11: what the gates look at, one row for each ``method`` of ``intervals``.

    ``slice_gap`` is the largest absolute coverage gap of a supported slice of ``dimensions``, ``high_price_gap`` the
    shortfall of coverage among rows of at least ``high_price``, ``balance`` the absolute difference of the rates
    under and over, ``fallback_rate`` the share of rows not served by their first level, ``reversed`` a count.
    Rows are summed once, by all ``dimensions`` together; only the median reads them again (``stored``: without a copy).
    """
    lower, upper, truth = F.col("lower"), F.col("upper"), F.col("y")
    width, inside = upper - lower, truth.between(lower, upper)
    parts = intervals.groupBy("method", *dimensions, (F.col(price) >= high_price).alias("__high")).agg(
        F.count(F.lit(1)).alias("__n"), F.count_if(inside).alias("__in"), F.count(inside).alias("__judged"), F.count_if(truth < lower).alias("__under"), F.count_if(truth > upper).alias("__over"),
        F.count_if("fallback").alias("__fallbacks"), F.count_if(upper < lower).alias("__reversed"), F.sum(width).alias("__width"), F.count(width).alias("__widths"),
    )
    parts = written(parts, "gate-parts")
    rate = lambda a, b="__n": F.try_divide(F.sum(a), F.sum(b))
    covered = rate("__in", "__judged")
    whole = parts.groupBy("method").agg(
        (rate("__in") - coverage).alias("coverage_gap"), F.abs(rate("__under") - rate("__over")).alias("balance"), rate("__fallbacks").alias("fallback_rate"), F.sum("__reversed").alias("reversed"), rate("__width", "__widths").alias("mean_width"),
    )
    long = long_slices(parts.withColumn("__m", F.col("method")), dimensions, "__m", "__n", "__in", "__judged")
    slices = long.groupBy(F.col("__m").alias("method"), "dimension", "label").agg(F.sum("__n").alias("n"), covered.alias("c")).where(F.col("n") >= min_support)
    worst = slices.groupBy("method").agg(F.max(F.abs(F.col("c") - coverage)).alias("slice_gap"))
    high = parts.where("__high").groupBy("method").agg((coverage - covered).alias("high_price_gap"))
    found = with_quantiles(whole.join(worst, "method", "left").join(high, "method", "left"), intervals, {"median_width": (width, 0.5)}, ["method"], stored=stored)
    return found.select("method", "coverage_gap", "slice_gap", "high_price_gap", "balance", "fallback_rate", "reversed", "mean_width", "median_width")


def sharpness_gates(metrics: DataFrame, base: str, limits: dict[str, float]) -> DataFrame:
    """CNF-8/11: ``method, gate, observed, threshold, passed``: whether each ``method`` of wide ``metrics`` passes each gate of ``limits``.

    Widths are relative to those of method ``base``. A gate without a value (no supported slice) passes.
    """
    ref = metrics.where(F.col("method") == base).agg(F.first("mean_width").alias("__w"), F.first("median_width").alias("__m"))
    tests = {
        "overall_gap": F.abs("coverage_gap"), "slice_gap": F.col("slice_gap"), "high_price_gap": F.col("high_price_gap"), "balance": F.col("balance"), "fallback_rate": F.col("fallback_rate"),
        "reversed": F.col("reversed").cast("double"), "width_ratio": F.col("mean_width") / F.col("__w"), "median_width_ratio": F.col("median_width") / F.col("__m"),
    }
    rows = [F.struct(F.lit(g).alias("gate"), tests[g].alias("observed"), F.lit(float(t)).alias("threshold"), F.coalesce(tests[g] <= t, F.lit(True)).alias("passed")) for g, t in limits.items()]
    return metrics.join(F.broadcast(ref)).select("method", F.explode(F.array(*rows)).alias("x")).select("method", "x.*")


def regression_gates(intervals: DataFrame, base: str, fold: str, focus: dict[str, tuple[str, str]], limits: dict[str, float]) -> DataFrame:
    """CNF-11: ``method, gate, observed, threshold, passed`` of what a method may lose against ``base`` on the same rows.

    ``worst_fold_regression`` is the largest loss of coverage in a fold, ``fold_sd_increase`` that of the coverages' deviation
    over folds, ``fallback_increase`` that of the share of rows not served by their first level, and
    ``focus_<name>_regression`` the loss of coverage where a column has the given value. A gate without a value (no such
    rows) passes.
    """
    inside = F.col("y").between(F.col("lower"), F.col("upper")).cast("double")
    parts = intervals.groupBy("method", F.col(fold).alias("__fold")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(inside).alias("c"), F.count_if("fallback").alias("f"),
        *[F.sum(F.when(F.col(c) == v, inside)).alias(f"c_{k}") for k, (c, v) in focus.items()], *[F.count_if(F.col(c) == v).alias(f"n_{k}") for k, (c, v) in focus.items()],
    )
    parts = written(parts.withColumn("share", F.col("c") / F.col("n")), "fold-coverage")
    rate = lambda a, b: F.try_divide(F.sum(a), F.sum(b))
    whole = parts.groupBy("method").agg(F.stddev_pop("share").alias("sd"), rate("f", "n").alias("fallbacks"), *[rate(f"c_{k}", f"n_{k}").alias(k) for k in focus])
    names = ["sd", "fallbacks", *focus]
    ref = whole.where(F.col("method") == base).agg(*[F.first(c).alias(f"__{c}") for c in names])
    folds = parts.where(F.col("method") == base).select(F.col("__fold").alias("__f"), F.col("share").alias("__share"))
    worst = parts.join(folds, F.col("__fold").eqNullSafe(F.col("__f"))).groupBy(F.col("method").alias("__m")).agg(F.max(F.col("__share") - F.col("share")).alias("worst"))
    wide = whole.join(F.broadcast(ref)).join(worst, F.col("method") == F.col("__m"), "left")
    tests = {"worst_fold_regression": F.col("worst"), "fold_sd_increase": F.col("sd") - F.col("__sd"), "fallback_increase": F.col("fallbacks") - F.col("__fallbacks")} | {f"focus_{k}_regression": F.col(f"__{k}") - F.col(k) for k in focus}
    rows = [F.struct(F.lit(g).alias("gate"), tests[g].alias("observed"), F.lit(float(t)).alias("threshold"), F.coalesce(tests[g] <= t, F.lit(True)).alias("passed")) for g, t in limits.items()]
    return wide.select("method", F.explode(F.array(*rows)).alias("x")).select("method", "x.*")


def choose_sharper(gates: DataFrame, widths: DataFrame, base: str, order: list[str], margin: float = 0.005) -> DataFrame:
    """CNF-12: ``method``: ``base`` unless another passes all gates; of those the simplest (first in ``order``), unless a later one is better.

    That one's mean width must be less by ``margin`` of the base's width in addition, and no gate that both have
    may come out worse for it. Of several such the narrowest.
    """
    width = widths.where(F.col("method") == base).agg(F.first("mean_width").alias("__w"))
    cut = widths.join(F.broadcast(width)).select("method", (1 - F.col("mean_width") / F.col("__w")).alias("cut"))
    place = F.array_position(F.array(*[F.lit(m) for m in order]), F.col("method")).cast("int").alias("place")
    ok = written(gates.where(F.col("method").isin(order)).groupBy("method").agg(F.bool_and("passed").alias("ok")).where("ok").join(cut, "method").select("method", "cut", place), "sharper")
    simplest = ok.agg(F.min(F.struct("place", "method", "cut")).alias("s")).select(F.col("s.method").alias("__m"), F.col("s.place").alias("__p"), F.col("s.cut").alias("__c"))
    mine = gates.join(F.broadcast(simplest), F.col("method") == F.col("__m")).select("gate", F.col("observed").alias("__o"))
    worse = gates.join(mine, "gate").where(F.col("observed") - 1e-12 > F.col("__o")).select(F.col("method").alias("__bad")).distinct()
    better = ok.join(F.broadcast(simplest)).where((F.col("place") > F.col("__p")) & (F.col("cut") - F.col("__c") >= margin)).join(worse, F.col("method") == F.col("__bad"), "left_anti")
    best = better.agg(F.max_by("method", F.struct("cut", -F.col("place"))).alias("__best"))
    return simplest.join(F.broadcast(best)).select(F.coalesce("__best", "__m", F.lit(base)).alias("method"))


def choose_method(gates: DataFrame, order: list[str], widths: DataFrame, margin: float = 0.03) -> DataFrame:
    """CNF-12: the simplest method that passes all gates, unless a later one is narrower by more than ``margin`` (relative)."""
    ok = gates.groupBy("method").agg(F.bool_and("passed").alias("ok")).where("ok").join(widths, "method")
    place = F.array_position(F.array(*[F.lit(m) for m in order]), F.col("method")).cast("int")
    ranked = ok.select("method", "mean_width", place.alias("place"))
    simplest = ranked.agg(F.min_by("mean_width", "place").alias("__w"), F.min("place").alias("__p"))
    better = ranked.join(F.broadcast(simplest)).where((F.col("place") == F.col("__p")) | (F.col("mean_width") <= F.col("__w") * (1 - margin)))
    return better.agg(F.min_by("method", F.struct("mean_width", "place")).alias("method"))


def slices_of(df: DataFrame, dimensions: list[str], coverage: float, min_support: int = 200, y: str = "y", p: str = "p") -> DataFrame:
    """Interval metrics of every supported label of every dimension."""
    long = long_slices(df, dimensions, y, p, "lower", "upper", "fallback")
    return interval_metrics(long, coverage, ["dimension", "label"], y, p).where(F.col("n") >= min_support)
