"""Table fingerprints and partition-scoped rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerbside.functions.scalars import content_hash
from kerbside.operators.quantiles import ordered_ranges


def table_fingerprint(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """SNK-3: ``n, sum, xor`` of row hashes: equal for equal multisets of rows, whatever their order and partitions."""
    h = F.conv(F.substring(content_hash(*[F.col(c) for c in columns or sorted(df.columns)]), 1, 15), 16, 10)
    return df.select(h.cast("long").alias("h")).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col("h").cast("decimal(38,0)")), F.lit(0)).cast("string").alias("sum"), F.coalesce(F.bit_xor("h"), F.lit(0)).alias("xor"))


def training_rows(df: DataFrame, assignment: DataFrame, key: str, part: str, columns: list[str], target: str) -> DataFrame:
    """SNK-5: the allowlisted columns and the target of the rows that ``assignment`` puts in ``part``."""
    mine = assignment.where(F.col("split") == part).select(F.col(key).alias("__key"))
    return df.join(mine, F.col(key) == F.col("__key")).select(key, *columns, target)


def row_violations(df: DataFrame, key: str, fixed: dict[str, object], reasons: list[str], bounds: dict[str, tuple[float, float]] | None = None, order: str | None = None) -> DataFrame:
    """PRJ-11: counts over a published table: fixed values that differ, keys that repeat, reasons that are not known, values out of bounds.

    ``bounds`` are inclusive; null is within them. With ``order`` (unique) also the rows whose key is not above the
    one before them: rows are cut into ranges, looked at within each, and each range's first key with the last before it.
    """
    differs, outside = F.lit(False), F.lit(False)
    for c, v in fixed.items():
        differs = differs | ~F.col(c).eqNullSafe(F.lit(v))
    for c, (low, high) in (bounds or {}).items():
        outside = outside | F.coalesce(~F.col(c).between(low, high), F.lit(False))
    keys = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated_keys"))
    rows = df.agg(F.count_if(differs).alias("fixed_differs"), F.count_if(F.col("reason_code").isNotNull() & ~F.col("reason_code").isin(reasons)).alias("unknown_reasons"), F.count_if(outside).alias("out_of_bounds"))
    found = rows.join(F.broadcast(keys))
    if order is None:
        return found
    ranges = ordered_ranges(df.select(F.col(key).alias("k"), F.col(order).alias("o")), [F.col("o")], "published-order")
    before = F.lag("k").over(Window.partitionBy("__range").orderBy("o"))
    inside = ranges.withColumn("__b", before).agg(F.count_if(F.col("k") <= F.col("__b")).alias("i"))
    ends = ranges.groupBy("__range").agg(F.min_by("k", "o").alias("first"), F.max_by("k", "o").alias("last"))
    between = ends.withColumn("__b", F.lag("last").over(Window.partitionBy(F.lit(1)).orderBy("__range"))).agg(F.count_if(F.col("first") <= F.col("__b")).alias("b"))
    return found.join(F.broadcast(inside.join(F.broadcast(between)).select((F.col("i") + F.col("b")).alias("not_increasing"))))
