"""Source profiles and audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbside.functions.scalars import is_missing, percent, zip_ok
from kerbside.operators.quantiles import quantiles, with_quantiles
from kerbside.staging import written

PROBS = [0.01, 0.25, 0.5, 0.75, 0.95, 0.99]


def long_slices(df: DataFrame, dimensions: list[str], *keep: str) -> DataFrame:
    """P4: every row once for each dimension, with ``dimension`` and ``label`` (text; null stays null)."""
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("label")) for d in dimensions])
    return df.select(*keep, F.explode(pairs).alias("__d")).select("__d.dimension", "__d.label", *keep)


def distribution(df: DataFrame, value: str, by: list[str] | None = None, probs: list[float] | None = None) -> DataFrame:
    """PRF-2: count, min, exact percentiles (linear), max. Null and non-finite values do not count; empty gives nulls."""
    probs, by = probs or PROBS, by or []
    x = F.col(value).cast("double")
    x = F.when(F.abs(x) < float("inf"), x)
    names = [f"p{round(100 * q):02d}" for q in probs]
    out = with_quantiles(df.groupBy(*by).agg(F.count(x).alias("n"), F.min(x).alias("min"), F.max(x).alias("max")), df, {n: (x, q) for n, q in zip(names, probs)}, by)
    return out.select(*by, "n", "min", *names, "max")


def categorical_coverage(df: DataFrame, columns: list[str], k: int = 15) -> DataFrame:
    """PRF-3: the ``k`` most frequent values of each column, ties by value, with present rows, share and distinct values."""
    long = long_slices(df, columns).where(~is_missing(F.col("label")))
    counts = long.groupBy("dimension", "label").agg(F.count(F.lit(1)).alias("n"))
    sums = counts.groupBy("dimension").agg(F.sum("n").alias("present"), F.count(F.lit(1)).alias("distinct_values"))
    top = counts.withColumn("rank", F.row_number().over(Window.partitionBy("dimension").orderBy(F.desc("n"), "label"))).where(F.col("rank") <= k)
    return top.join(sums, "dimension").select("dimension", "label", "n", "rank", "present", "distinct_values")


def numeric_audit(df: DataFrame, columns: list[str]) -> DataFrame:
    """PRF-4: of each text column how many values are numeric, not numeric, or missing."""
    kind = lambda c: F.when(is_missing(F.col(c)), "missing").when(F.col(c).try_cast("double").isNotNull(), "numeric").otherwise("not_numeric")
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), kind(c).alias("kind")) for c in columns])).alias("x")).select("x.*")
    return long.groupBy("column").agg(F.count_if(F.col("kind") != "missing").alias("present"), *[F.count_if(F.col("kind") == k).alias(k) for k in ("numeric", "not_numeric", "missing")])


def threshold_flags(df: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """PRF-5/6: how many rows each condition holds for, in one pass."""
    return df.agg(*[F.count_if(c).alias(name) for name, c in flags.items()])


def top_values(df: DataFrame, value: str, k: int) -> DataFrame:
    """PRF-5: the ``k`` most repeated values, ties to the smaller."""
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), value).limit(k)


def field_support(df: DataFrame, mapping: dict[str, str | None]) -> DataFrame:
    """PRF-7: canonical field, its source column, whether there is one, and the share of rows that have a value."""
    present = lambda c: F.count_if(~is_missing(F.col(c))) if c else F.lit(0).cast("long")
    one = df.agg(F.count(F.lit(1)).alias("n"), *[present(c).alias(f"f_{k}") for k, c in mapping.items()])
    rows = F.array(*[F.struct(F.lit(k).alias("field"), F.lit(c).cast("string").alias("source_column"), F.lit(c is not None).alias("supported"), F.col(f"f_{k}").alias("present"), percent(F.col(f"f_{k}"), F.col("n")).alias("percent_present")) for k, c in mapping.items()])
    return one.select(F.explode(rows).alias("x")).select("x.*")


def iqr_outliers(df: DataFrame, value: str, by: str, k: float = 3.0) -> DataFrame:
    """PRF-8: values beyond ``k`` interquartile ranges, for each group. Groups are few rows, joined back."""
    fences = distribution(df, value, [by], [0.25, 0.75]).select(F.col(by).alias("__by"), (F.col("p25") - k * (F.col("p75") - F.col("p25"))).alias("low"), (F.col("p75") + k * (F.col("p75") - F.col("p25"))).alias("high"))
    joined = df.select(by, value).join(fences, F.col(by).eqNullSafe(F.col("__by")))
    return joined.groupBy(by).agg(F.count_if(F.col(value) < F.col("low")).alias("below"), F.count_if(F.col(value) > F.col("high")).alias("above"))


def valid_by(df: DataFrame, valid: Column, by: str) -> DataFrame:
    """PRF-9: rows and valid rows of each category."""
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count_if(valid).alias("valid")).withColumn("percent_valid", percent(F.col("valid"), F.col("n")))


def scope_audit(df: DataFrame, region: str, allowed: list[str], postcode: str) -> DataFrame:
    """PRF-10: how many rows lack a region, are in scope, out of it or malformed, and how many postal codes have no five digits."""
    r, z = F.col(region), F.col(postcode)
    missing = is_missing(r)
    return df.agg(
        F.count_if(missing).alias("missing"), F.count_if(r.isin(allowed)).alias("in_scope"), F.count_if(~missing & r.rlike("^[A-Z]{2}$") & ~r.isin(allowed)).alias("out_of_scope"), F.count_if(~missing & ~r.rlike("^[A-Z]{2}$")).alias("malformed"),
        F.count_distinct(F.when(~missing, r)).alias("regions"), F.count_if(~is_missing(z) & ~zip_ok(z)).alias("zip_malformed"), F.count_if(is_missing(z)).alias("zip_missing"),
    )


def time_audit(df: DataFrame, first: str, last: str, day: str, year: str) -> DataFrame:
    """PRF-11: the range of days, days that are missing, differ from the file's, or precede the model year, and rows first seen after they were last seen."""
    f, x, d = F.col(first), F.col(last), F.col(day)
    return df.agg(
        F.min(x).cast("string").alias("first_day"), F.max(x).cast("string").alias("last_day"), F.count_if(x.isNull()).alias("invalid"), F.count_if(x == d).alias("on_file_date"),
        F.count_if(x != d).alias("off_file_date"), F.count_if(f > x).alias("first_after_last"), F.count_if(F.year(x) < F.col(year)).alias("before_model_year"),
    )


def repeated_composites(df: DataFrame, columns: list[str]) -> DataFrame:
    """PRF-12: rows that share a complete composite key with an earlier one, and such keys; a key with a missing part is none."""
    sizes = df.where(~reduce(lambda a, b: a | b, [is_missing(F.col(c)) for c in columns])).groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.count(F.lit(1)).alias("composite_keys"), F.count_if(F.col("n") > 1).alias("repeated_composites"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("composite_rows_beyond_first"))


def source_profile(df: DataFrame, by: str, mapping: dict[str, str | None], numeric: str, categorical: list[str], reason: Column, k: int = 15) -> DataFrame:
    """PRF-1: one long report ``source, part, name, value`` of every source.

    Parts: ``accounting`` (read, accepted, and rejected by reason), ``mapping`` (percent of rows that have each
    mapped field; unmapped ones 0), ``distribution`` of a number, ``distinct`` values of categories and ``top``
    values (the ``k`` most frequent). Each part is one aggregate over all sources; the columns that they need are written once.
    """
    used = dict.fromkeys([by, *[c for c in mapping.values() if c], numeric, *categorical])
    rows = written(df.select(*used, F.coalesce(reason, F.lit("accepted")).alias("__reason")), "profile")
    entry = lambda part, name, value: F.struct(F.lit(part).alias("part"), name.alias("name"), value.cast("double").alias("value"))
    long = lambda d, pairs: d.select(F.col(by).alias("source"), F.explode(F.array(*pairs)).alias("x")).select("source", "x.*")
    counts = rows.groupBy(by).agg(F.count(F.lit(1)).alias("__n"), *[(F.count_if(~is_missing(F.col(c))) if c else F.lit(0)).alias(f"__{f}") for f, c in mapping.items()])
    reasons = rows.groupBy(by, "__reason").agg(F.count(F.lit(1)).alias("__c"))
    d = distribution(rows, numeric, [by])
    levels = rows.select(by, F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in categorical])).alias("x")).select(by, "x.*").where(~is_missing(F.col("v")))
    sizes = levels.groupBy(by, "c", "v").agg(F.count(F.lit(1)).alias("__c"))
    top = sizes.withColumn("__r", F.row_number().over(Window.partitionBy(by, "c").orderBy(F.desc("__c"), "v"))).where(F.col("__r") <= k)
    parts = [
        long(counts, [entry("accounting", F.lit("read"), F.col("__n")), *[entry("mapping", F.lit(f), percent(F.col(f"__{f}"), F.col("__n"))) for f in mapping]]),
        long(reasons, [entry("accounting", F.col("__reason"), F.col("__c"))]), long(d, [entry("distribution", F.lit(c), F.col(c)) for c in d.columns if c != by]),
        long(sizes.groupBy(by, "c").agg(F.count(F.lit(1)).alias("__c")), [entry("distinct", F.col("c"), F.col("__c"))]), long(top, [entry("top", F.concat_ws("=", "c", "v"), F.col("__c"))]),
    ]
    return reduce(DataFrame.unionByName, parts)


def repetition_audit(df: DataFrame, key: str, snapshot: str, values: list[str]) -> DataFrame:
    """PRF-12: how ids repeat over snapshots and whether their values changed (null counts as a value)."""
    rows = F.struct(*[F.coalesce(F.col(v).cast("string"), F.lit("\x00")).alias(v) for v in values])
    each = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(snapshot).alias("s"), F.count_distinct(rows).alias("v"))
    return each.agg(F.count(F.lit(1)).alias("unique_ids"), F.count_if(F.col("n") > 1).alias("repeated_ids"), F.sum(F.col("n") - 1).alias("beyond_first"), F.max("n").alias("most_rows"), F.count_if(F.col("s") > 1).alias("in_several_snapshots"), F.count_if(F.col("v") > 1).alias("changed_ids"))


def feature_coverage(df: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """PRF-13: non-missing and distinct values of every feature; min, median and max of numeric ones. Features are rows of one scan."""
    pair = lambda c, number: F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("text"), (F.col(c).cast("double") if number else F.lit(None).cast("double")).alias("x"))
    long = df.select(F.explode(F.array(*[pair(c, True) for c in numeric], *[pair(c, False) for c in categorical])).alias("p")).select("p.*")
    base = long.groupBy("feature").agg(F.count_if(~is_missing(F.col("text"))).alias("present"), F.count_distinct("text").alias("distinct_values"), F.min("x").alias("min"), F.max("x").alias("max"))
    return with_quantiles(base, long, {"median": (F.col("x"), 0.5)}, ["feature"]).select("feature", "present", "distinct_values", "min", "median", "max")


def compare_sources(df: DataFrame, source: str, value: str, columns: list[str], base: str | None = None) -> DataFrame:
    """PRF-14: rows, median and coverage (percent) of every source side by side.

    With ``base`` also each source's differences from that one: of coverage in points, of the median in percent.
    """
    counts = df.groupBy(source).agg(F.count(F.lit(1)).alias("n"), *[F.round(100.0 * F.count_if(~is_missing(F.col(c))) / F.count(F.lit(1)), 6).alias(f"coverage_{c}") for c in columns])
    out = with_quantiles(counts, df, {"median": (F.col(value), 0.5)}, [source]).select(source, "n", "median", *[f"coverage_{c}" for c in columns])
    if base is None:
        return out
    ref = out.where(F.col(source) == base).agg(F.first("median").alias("__m"), *[F.first(f"coverage_{c}").alias(f"__{c}") for c in columns])
    joined = out.join(F.broadcast(ref)).withColumn("median_shift", 100.0 * (F.col("median") - F.col("__m")) / F.col("__m"))
    return joined.withColumns({f"points_{c}": F.round(F.col(f"coverage_{c}") - F.col(f"__{c}"), 6) for c in columns}).drop("__m", *[f"__{c}" for c in columns])


def composition(df: DataFrame, source: str) -> DataFrame:
    """PRF-15: rows and percentage of each source."""
    return df.groupBy(source).agg(F.count(F.lit(1)).alias("n")).withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


def share_drift(full: DataFrame, sample: DataFrame, dimensions: list[str]) -> DataFrame:
    """PRF-16: for each dimension the largest difference of a label's share, in percentage points."""
    def shares(df: DataFrame, name: str) -> DataFrame:
        counts = long_slices(df, dimensions).groupBy("dimension", F.coalesce("label", F.lit("\x00")).alias("label")).agg(F.count(F.lit(1)).alias("n"))
        return counts.select("dimension", "label", (F.col("n") / F.sum("n").over(Window.partitionBy("dimension"))).alias(name))

    both = shares(full, "a").join(shares(sample, "b"), ["dimension", "label"], "full_outer").fillna(0.0, ["a", "b"])
    return both.groupBy("dimension").agg(F.round(100 * F.max(F.abs(F.col("a") - F.col("b"))), 6).alias("max_points"))


def median_drift(full: DataFrame, sample: DataFrame, numeric: list[str]) -> DataFrame:
    """PRF-16: ``feature, full_median, sample_median, percent``: medians of population and sample, and the difference in percent of the population's (null where that is 0)."""
    pairs = lambda df, name: df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in numeric])).alias("p")).select("p.*", F.lit(name).alias("part"))
    found = quantiles(pairs(full, "full").unionByName(pairs(sample, "sample")), {"q": F.col("x")}, [0.5], ["feature", "part"])
    of = lambda part: F.max(F.when(F.col("part") == part, F.get("q", F.lit(0))))
    wide = found.groupBy("feature").agg(of("full").alias("full_median"), of("sample").alias("sample_median"))
    return wide.withColumn("percent", F.when(F.col("full_median") != 0, F.round(100 * (F.col("sample_median") - F.col("full_median")) / F.col("full_median"), 6)))


def status_counts(df: DataFrame, status: str, features: list[str]) -> DataFrame:
    """PRF-13: rows of every status (null is one) and how many of them have each feature (``present_...``)."""
    return df.groupBy(status).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(~is_missing(F.col(c).cast("string"))).alias(f"present_{c}") for c in features])
