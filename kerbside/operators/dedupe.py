"""Deduplication with full accounting, and conflict resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbside.functions.scalars import content_hash, once


def mark_duplicates(df: DataFrame, columns: list[str], order: Column, eligible: Column | None = None) -> DataFrame:
    """DUP-1/3: ``df`` with ``is_duplicate``: not the first, by ``order``, of the rows equal in ``columns``.

    Only ``eligible`` rows take part (deduplicate after validation: pass what was accepted). The first of a
    group comes from a partial aggregate joined back, so a key with a third of all rows does not make one
    task; rows that take no part have keys of their own, which no other row has.
    """
    take = F.lit(True) if eligible is None else F.coalesce(eligible, F.lit(False))
    key = F.when(take, content_hash(*[F.col(c) for c in columns]))
    hashed = df.select("*", once(F.struct(key.alias("hash"), order.alias("order"))).alias("__k"))
    first = hashed.where("__k.hash is not null").groupBy(F.col("__k.hash").alias("__hash")).agg(F.min("__k.order").alias("__first"))
    spread = F.coalesce(F.col("__k.hash"), F.concat(F.lit("-"), F.xxhash64("__k.order").cast("string")))
    joined = hashed.withColumn("__hash", spread).join(first, "__hash", "left")
    return joined.withColumn("is_duplicate", F.coalesce(F.col("__k.order") > F.col("__first"), F.lit(False))).drop("__hash", "__k", "__first")


def resolve_keyed(df: DataFrame, key: list[str], digest: str, order: Column) -> DataFrame:
    """DUP-2 / SRC-6: ``df`` with ``outcome``: ``accepted`` (first of its key by ``order``), ``duplicate`` (same content) or ``conflict`` (other content).

    Every row has an outcome: a null in a key is a value like others, and so is a null digest.
    """
    with_order = df.withColumn("__order", order)
    first = with_order.groupBy(*[F.col(k).alias(f"__{k}") for k in key]).agg(F.min_by(F.struct("__order", digest), "__order").alias("__first"))
    outcome = F.when(F.col("__order") == F.col("__first")["__order"], "accepted").when(F.col(digest).eqNullSafe(F.col("__first")[digest]), "duplicate").otherwise("conflict")
    joined = with_order.join(first, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in key])
    return joined.withColumn("outcome", outcome).drop("__order", "__first", *[f"__{k}" for k in key])


def accounting(df: DataFrame, reason: str = "reason_code", duplicate: str = "is_duplicate", by: list[str] | None = None, ranges: dict[str, Column] | None = None) -> DataFrame:
    """DUP-4: seen, accepted, rejected and duplicates, whether they add up, and rejected rows by reason (a map).

    ``ranges`` names values whose least and greatest among accepted rows are added (``min_...``, ``max_...``).
    """
    by = by or []
    rejected, repeated = F.col(reason).isNotNull(), F.col(duplicate)
    clean = ~rejected & ~repeated
    extremes = [f(F.when(clean, c)).alias(f"{name}_{k}") for k, c in (ranges or {}).items() for name, f in (("min", F.min), ("max", F.max))]
    # Reasons are few: counts by reason first, then one row for each group.
    parts = df.groupBy(*by, reason).agg(F.count(F.lit(1)).alias("__n"), F.count_if(clean).alias("__a"), F.count_if(~rejected & repeated).alias("__d"), *extremes)
    counts = parts.groupBy(*by).agg(
        F.sum("__n").alias("seen"), F.sum("__a").alias("accepted"), F.coalesce(F.sum(F.when(rejected, F.col("__n"))), F.lit(0)).alias("rejected"), F.sum("__d").alias("duplicates"),
        F.map_from_entries(F.sort_array(F.collect_list(F.when(rejected, F.struct(reason, "__n"))))).alias("by_reason"), *[f(f"{name}_{k}").alias(f"{name}_{k}") for k in ranges or {} for name, f in (("min", F.min), ("max", F.max))],
    )
    return counts.withColumn("balanced", F.col("seen") == F.col("accepted") + F.col("rejected") + F.col("duplicates"))


def repeat_stats(df: DataFrame, key: Column) -> DataFrame:
    """DUP-5: rows beyond the first of their key, keys that repeat, and rows without a key."""
    sizes = df.select(key.alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    known = F.col("k").isNotNull()
    return sizes.agg(F.coalesce(F.sum(F.when(known, F.col("n") - 1)), F.lit(0)).alias("beyond_first"), F.count_if(known & (F.col("n") > 1)).alias("repeated_keys"), F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("invalid_keys"))


def duplicate_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """DUP-6: rows in any set of equal rows, and rows beyond the first of theirs."""
    sizes = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("in_sets"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("beyond_first"))


def retain_latest(df: DataFrame, key: list[str], order: list[Column], n: int) -> DataFrame:
    """SNK-6/7: the newest ``n`` rows of every key; Spark limits each partition before the shuffle."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("__n") <= n).drop("__n")
