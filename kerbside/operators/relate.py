"""Joins, set operations and reconciliation between tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbside.staging import broadcast_if_small, written


def align(raw: DataFrame, candidate: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """JON-1: candidate rows beside their raw rows by ``key``, and candidates that have none (must be empty)."""
    return candidate.join(raw, key), candidate.join(raw, key, "left_anti")


def assignment_differences(expected: DataFrame, found: DataFrame, key: str, value: str) -> DataFrame:
    """JON-2: keys that are ``missing``, ``extra`` or ``different`` between two assignments."""
    a = expected.select(F.col(key).alias("__a"), F.col(value).alias("__va"))
    b = found.select(F.col(key).alias("__b"), F.col(value).alias("__vb"))
    problem = F.when(F.col("__b").isNull(), "missing").when(F.col("__a").isNull(), "extra").when(~F.col("__va").eqNullSafe(F.col("__vb")), "different")
    return a.join(b, F.col("__a") == F.col("__b"), "full_outer").select(F.coalesce("__a", "__b").alias(key), problem.alias("problem")).where("problem is not null")


def anti_collisions(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """JON-3: rows of ``left`` whose keys no row of ``right`` has; null equals null."""
    other = right.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    return left.join(other, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], "left_anti")


def collision_report(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """JON-4: distinct complete keys of each side and of both; a key with a null is dropped."""
    sides = reduce(DataFrame.unionByName, [df.select(*keys).dropna().withColumn("__side", F.lit(n)) for n, df in ((1, a), (2, b))])
    merged = sides.groupBy(*keys).agg(F.bit_or("__side").alias("s"))
    return merged.agg(F.count_if(F.col("s").isin(1, 3)).alias("left_keys"), F.count_if(F.col("s").isin(2, 3)).alias("right_keys"), F.count_if(F.col("s") == 3).alias("shared_keys"))


def coverage_difference(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """JON-5: of each column, how many distinct values only one side has, and how many both."""
    pairs = lambda df, n: df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x"), F.lit(n).alias("side")).select("x.*", "side").where("value is not null")
    merged = pairs(a, 1).unionByName(pairs(b, 2)).groupBy("column", "value").agg(F.bit_or("side").alias("s"))
    return merged.groupBy("column").agg(F.count_if(F.col("s") == 1).alias("only_left"), F.count_if(F.col("s") == 2).alias("only_right"), F.count_if(F.col("s") == 3).alias("both"))


def overlap_risk(origins: DataFrame) -> DataFrame:
    """JON-6: pairs of sources that are not known to be apart: ``left_id, right_id, risk``. A family of n sources gives n (n - 1) / 2 pairs; :func:`overlap_families` says the same in n rows.

    ``origins`` is ``source_id, families`` (array of upstream families; null or empty: unknown). ``confirmed``
    pairs share a family, found by joining on families. A source of unknown provenance may overlap with any
    other: it is one row with a null ``right_id`` and risk ``indeterminate``. All other pairs have risk none, and no row.
    """
    known = origins.select("source_id", F.explode("families").alias("__f")).distinct()
    a, b = known.withColumnRenamed("source_id", "left_id"), known.withColumnRenamed("source_id", "right_id")
    shared = a.join(b, "__f").where(F.col("left_id") < F.col("right_id")).select("left_id", "right_id").distinct().withColumn("risk", F.lit("confirmed"))
    unknown = origins.where(F.coalesce(F.size("families"), F.lit(0)) <= 0).select(F.col("source_id").alias("left_id"), F.lit(None).cast("string").alias("right_id"), F.lit("indeterminate").alias("risk"))
    return shared.unionByName(unknown)


def overlap_families(origins: DataFrame) -> DataFrame:
    """JON-6: ``source_id, family, representative, members, risk``: each source with each of its families, that family's smallest source and how many it has.

    Two sources are ``confirmed`` to overlap if they have a row of one family. A family of one source is ``none``; a source of unknown
    provenance is one row without a family, ``indeterminate``. Rows grow with the memberships, however popular a family is.
    """
    known = origins.select("source_id", F.explode("families").alias("family")).distinct()
    sizes = known.groupBy(F.col("family").alias("__f")).agg(F.min("source_id").alias("representative"), F.count(F.lit(1)).alias("members"))
    held = known.join(sizes, F.col("family").eqNullSafe(F.col("__f"))).select("source_id", "family", "representative", "members", F.when(F.col("members") > 1, "confirmed").otherwise("none").alias("risk"))
    unknown = origins.where(F.coalesce(F.size("families"), F.lit(0)) <= 0).select("source_id", F.lit(None).cast("string").alias("family"), F.lit(None).cast("string").alias("representative"), F.lit(None).cast("long").alias("members"), F.lit("indeterminate").alias("risk"))
    return held.unionByName(unknown)


def combine_sources(first: DataFrame, second: DataFrame, columns: list[str], keys: list[str], keep: Column) -> tuple[DataFrame, DataFrame]:
    """JON-7: the union of two sources on ``columns``, and what each step removed from the second.

    Steps: repeated rows, rows that fail ``keep``, rows that collide with the first source in ``keys``.
    """
    distinct = second.dropDuplicates(columns)
    filtered = distinct.where(keep)
    clear = anti_collisions(filtered, first, keys)
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("step"), F.lit(name).alias("name"), "n") for k, (name, df) in enumerate([("read", second), ("distinct", distinct), ("filtered", filtered), ("clear", clear)])]
    steps = reduce(DataFrame.unionByName, counts)
    removed = F.coalesce(F.lag("n").over(Window.orderBy("step")) - F.col("n"), F.lit(0))
    return first.select(*columns).unionByName(clear.select(*columns)), steps.select("step", "name", "n", removed.alias("removed"))


def mixed_groups(df: DataFrame, group: str, part: str) -> DataFrame:
    """JON-8: groups that are in more than one part (must be empty). One shuffle."""
    return df.groupBy(group).agg(F.min(part).alias("a"), F.max(part).alias("b")).where(F.col("a") != F.col("b")).select(group)


def lookup_with_fallback(df: DataFrame, table: DataFrame, levels: list[tuple[str, list[str]]], value: str, support: str) -> DataFrame:
    """JON-9: ``df`` with ``value``, ``support`` and ``method`` from the first level that has a value for the row.

    ``table`` is tidy: ``level, key, value, support``, one row for each level and key; a level's key is its
    columns joined by ``|``, a null one ``missing``. Each level is an equi-join, broadcast if its entries
    are few; a level without columns is one row.
    """
    entries = written(table.where(F.col(value).isNotNull()).select("level", "key", F.struct(F.col(value).alias("value"), F.col(support).alias("support")).alias("__e")), "lookup")
    joined = df
    for k, (level, cols) in enumerate(levels):
        mine = entries.where(F.col("level") == level)
        if cols:
            key = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("missing")) for c in cols])
            joined = joined.join(broadcast_if_small(mine.select(F.col("key").alias(f"__key{k}"), F.col("__e").alias(f"__hit{k}"))), key == F.col(f"__key{k}"), "left").drop(f"__key{k}")
        else:
            joined = joined.join(F.broadcast(mine.agg(F.first("__e").alias(f"__hit{k}"))))
    hits = [F.col(f"__hit{k}") for k in range(len(levels))]
    method = F.coalesce(*[F.when(h.isNotNull(), level) for h, (level, _) in zip(hits, levels)])
    found = joined.withColumn("__hit", F.coalesce(*hits)).withColumn("method", method)
    return found.withColumn(value, F.col("__hit")["value"]).withColumn(support, F.col("__hit")["support"]).drop("__hit", *[f"__hit{k}" for k in range(len(levels))])


def slice_changes(base: DataFrame, challenger: DataFrame, metric: str, k: int = 10) -> DataFrame:
    """JON-10: the ``k`` slices whose metric changed most, relative to the base; ties by name."""
    on = ["dimension", "label"]
    both = base.select(*on, F.col(metric).alias("base")).join(challenger.select(*on, F.col(metric).alias("challenger")), on)
    return both.withColumn("change", F.when(F.col("base") != 0, F.round((F.col("challenger") - F.col("base")) / F.col("base"), 6))).orderBy(F.desc(F.abs("change")), *on).limit(k)


def not_in(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """JON-11: keys of ``a`` that ``b`` lacks (none: a is a subset)."""
    return a.select(key).join(b.select(key), key, "left_anti")


def join_outcomes(predictions: DataFrame, outcomes: DataFrame) -> DataFrame:
    """JON-12: outcomes with their predictions by ``event_id``, of the same source and not before them."""
    p = predictions.select("event_id", F.col("source_id").alias("p_source"), "observed_at", "prediction")
    return outcomes.join(p, "event_id").where((F.col("occurred_at") >= F.col("observed_at")) & (F.col("source_id") == F.col("p_source"))).drop("p_source")
