"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

Within a source every document expects the same number of copies, the source's target over its size. In a
fixed order (by size class, then by digest of the id) the expected copies are summed up from one offset,
and a document is emitted once for each whole number its step crosses. The sum is a rank times a rate; the
rank comes from two levels (counts of small buckets, then positions in a bucket), so that a source with a
third of all rows is as spread out as any other.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbside.staging import written

#: Rows that a bucket of a hot source should hold at most.
BUCKET = 20_000


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """``__source, source_size, target`` from a table of ``__source`` (string) and ``source_size`` (long).

    Sources by code point, null last, take the weights in turn and share ``share`` of all sizes. Targets
    stop at ``cap`` times the source's size; the excess is shared again by weight until none is above.
    Sources are ranked within ranges that Spark cuts to one size, and ranges by their counts, so any number of
    sources is spread out, whatever they begin with; the rounds gather three sums each.
    """
    keyed = sizes.withColumn("__last", F.col("__source").isNull())
    ranges = written(keyed.repartitionByRange("__last", "__source").withColumn("__range", F.spark_partition_id()), "mixing-ranges")
    heads = ranges.groupBy("__range").count().select("__range", (F.sum("count").over(Window.partitionBy(F.lit(1)).orderBy("__range")) - F.col("count")).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__range").orderBy("__last", "__source")) + F.col("__before") - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod("__rank", F.lit(len(weights))) + 1).cast("int"))
    ranked = written(ranges.join(heads, "__range").withColumn("__rank", place).select("__source", "source_size", weight.cast("double").alias("weight")), "mixing-sources")
    rate, at_cap = 0.0, -1
    full = F.lit(cap) * F.col("source_size")
    while True:
        above = F.col("weight") * F.lit(rate) >= full if at_cap >= 0 else F.lit(False)
        row = ranked.agg(F.count_if(above).alias("n"), F.coalesce(F.sum(F.when(above, full)), F.lit(0.0)).alias("taken"), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0)).alias("weight"), F.coalesce(F.sum("source_size"), F.lit(0)).alias("total")).first()
        if row["n"] == at_cap:
            break
        at_cap = row["n"]
        rate = (share * row["total"] - row["taken"]) / row["weight"] if row["weight"] else math.inf
    target = F.when(F.col("source_size") == 0, 0.0).when(F.lit(math.isinf(rate)), full).otherwise(F.least(full, F.col("weight") * F.lit(0.0 if math.isinf(rate) else rate)))
    return ranked.select("__source", "source_size", target.alias("target"))


def size_class(size: Column) -> Column:
    """A whole number that grows with ``size``: its bit length and the four bits after the first."""
    one = size + 1
    bits = F.length(F.bin(one))
    top = F.when(bits > 5, F.floor(one / F.pow(F.lit(2.0), bits - 5)).cast("long")).otherwise(one)
    return (bits * 32 + top).cast("int")


def offset(source: Column) -> Column:
    """The source's offset in [0, 1), a multiple of 2 to the power -16, fixed by its name."""
    return F.conv(F.substring(F.md5(F.concat(F.lit("offset:"), F.coalesce(source, F.lit("")))), 1, 4), 16, 10).cast("double") / 65536


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", size_col: str = "size", cap: float = 2.0, **shares) -> DataFrame:
    """``docs`` with ``source_size``, ``target`` (its source's) and ``copies`` (0 to 2, how often the mix takes it).

    A column of those names in ``docs`` is replaced. Null sizes count 0; a null source is a source of its
    own. Rows that repeat are sampled one by one; the draw depends on ids, sizes and sources, among rows
    that share all three on a hash of the whole row (but maps), so reruns and any partitioning agree. Rows
    without an id are ordered by size. Sources without words get target 0 and no copies. ``docs`` is read
    twice, the first time only those three columns. Rows of one id (or size, without ids) in one source
    are one bucket; all others are spread over buckets by digest.
    """
    size = F.coalesce(F.col(size_col).cast("long"), F.lit(0))
    source = F.col(source_col).cast("string")
    digest = F.md5(F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null:"), size.cast("string"))))
    tie = F.xxhash64(*[F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind])
    rows = docs.select(F.struct("*").alias("__row"), tie.alias("__tie"), source.alias("__source"), size.alias("__size"), digest.alias("__digest"), size_class(size).alias("__class"))
    narrow = written(rows.groupBy("__source", "__class", F.substring("__digest", 1, 2).alias("__two")).agg(F.count(F.lit(1)).alias("n"), F.sum("__size").alias("s")), "mixing-counts")
    total = narrow.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    digits = 2 if total <= 256 * BUCKET else min(8, math.ceil(math.log(total / BUCKET, 16)))
    key = lambda c: F.concat(F.when(F.col(c).isNull(), "-").otherwise("="), F.coalesce(F.col(c), F.lit("")))
    prefix = F.substring("__digest", 1, digits)
    counts = narrow.select(key("__source").alias("__key"), "__class", F.col("__two").alias("__part"), "n") if digits == 2 else written(rows.groupBy(key("__source").alias("__key"), "__class", prefix.alias("__part")).agg(F.count(F.lit(1)).alias("n")), "mixing-buckets")
    classes = counts.groupBy("__key", "__class").agg(F.sum("n").alias("c"))
    classes = classes.select("__key", "__class", (F.sum("c").over(Window.partitionBy("__key").orderBy("__class")) - F.col("c")).alias("__below"))
    within = F.sum("n").over(Window.partitionBy("__key", "__class").orderBy("__part")) - F.col("n")
    starts = counts.withColumn("__within", within).join(classes, ["__key", "__class"]).select("__key", "__class", "__part", (F.col("__within") + F.col("__below")).alias("__start"))
    targets = source_targets(narrow.groupBy("__source").agg(F.sum("s").alias("source_size")), cap=cap, **shares)
    plan = written(starts.join(targets.select(key("__source").alias("__key"), "source_size", "target", offset(F.col("__source")).alias("__offset")), "__key"), "mixing-plan")
    ordered = Window.partitionBy("__key", "__class", "__part").orderBy("__digest", "__size", "__tie")
    joined = rows.withColumn("__key", key("__source")).withColumn("__part", prefix).withColumn("__at", F.row_number().over(ordered)).join(plan, ["__key", "__class", "__part"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rank = (F.col("__start") + F.col("__at")).cast("double")
    copies = F.floor(F.col("__offset") + rate * rank) - F.floor(F.col("__offset") + rate * (rank - 1))
    kept = [F.col(f"__row.`{c}`") for c in docs.columns if c not in ("source_size", "target", "copies")]
    return joined.select(*kept, "source_size", "target", F.least(copies, F.lit(math.ceil(cap))).cast("int").alias("copies"))
