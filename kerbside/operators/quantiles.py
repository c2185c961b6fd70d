"""Exact order statistics and ranks that no single task computes for a whole group."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbside.staging import broadcast_if_small, written

#: Steps of a power of two that values are cut into first, and equal parts that such a step is cut into next.
OCTAVE, PARTS = 64, 4096


def _octave(x: Column) -> Column:
    """A whole number that never falls as x grows: the sign and the logarithm in steps."""
    size = F.floor(F.log2(F.abs(x)) * OCTAVE) + 1200 * OCTAVE
    return F.when(x > 0, size).when(x < 0, -size).otherwise(0).cast("int")


def _hits(parts: DataFrame, keys: list[str], part: str, need: Column, *keep: str) -> DataFrame:
    """Of ``parts`` (with ``__s`` values each) those that hold a needed rank, with the ranks counted from their own first value; written, and broadcast if they are few."""
    below = (F.sum("__s").over(Window.partitionBy(*keys).orderBy(part)) - F.col("__s")).alias("__below")
    asked = parts.select("*", below).select("*", F.explode(need).alias("__k")).select("*", "__k.*").where((F.col("rank") > F.col("__below")) & (F.col("rank") <= F.col("__below") + F.col("__s")))
    need = F.collect_list(F.struct("pos", (F.col("rank") - F.col("__below")).alias("rank"))).alias("__need")
    return broadcast_if_small(written(asked.groupBy(*keys, part).agg(need, *[F.first(c).alias(c) for c in keep]), "wanted"))


def _place() -> Column:
    """Which of ``PARTS`` equal cells between ``__lo`` and ``__hi`` holds ``__x``."""
    return F.when(F.col("__hi") > F.col("__lo"), F.floor((F.col("__x") - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * PARTS)).otherwise(0).cast("int")


def values_at(df: DataFrame, value: Column, by: list[str], wanted: Callable[[Column], Column], weight: str | None = None, stored: bool = False, rank_type: str = "long") -> DataFrame:
    """``by...``, ``n`` (values) and ``values``: of every group the values at the ranks ``wanted(n)``, an array of longs from 1.

    Null, NaN and infinite values do not count; a rank outside of 1 to n gives null; groups without values have no
    row; null keys are keys. With ``weight`` a row stands for that many values, also for a part of one if ``rank_type`` is
    a decimal; a rank is then reached by the first value up to which the weights add up to it. Counts are summed up over
    ranges, on the map side first, only ranges that hold a wanted rank are cut further, and only the values of those
    parts are counted one by one and put in order. Rows are shuffled only where more than 10,000 ranges or
    parts hold a wanted rank, that is, with many groups: those are joined and not broadcast. Each step's windows
    hold a bounded number of sums, or the values of one small part. ``df`` is read three times: it is
    written first, unless it is ``stored``, that is, cheap to read again.
    """
    group = F.struct(*[F.col(c) for c in by]) if by else F.struct(F.lit(0).alias("__all"))
    times = F.sum(weight) if weight else F.count(F.lit(1))
    rows = df.select(group.alias("__g"), value.cast("double").alias("__x"), *([weight] if weight else [])).where(F.abs("__x") < float("inf"))
    rows = (rows if stored else written(rows, "values")).withColumn("__a", _octave(F.col("__x")))
    total = F.sum("__s")
    octaves = rows.groupBy("__g", "__a").agg(times.alias("__s"), F.min("__x").alias("__lo"), F.max("__x").alias("__hi"))
    parts = written(octaves.withColumn("n", total.over(Window.partitionBy("__g"))), "octaves")
    numbered = F.transform(wanted(F.col("n")), lambda k, i: F.struct(i.alias("pos"), k.cast(rank_type).alias("rank")))
    first = _hits(parts, ["__g"], "__a", numbered, "__lo", "__hi")
    near = rows.join(first.drop("__need"), ["__g", "__a"]).withColumn("__b", _place())
    cells = near.groupBy("__g", "__a", "__b").agg(times.alias("__s"))
    second = _hits(cells.join(first.select("__g", "__a", "__need"), ["__g", "__a"]), ["__g", "__a"], "__b", F.col("__need"))
    counted = near.join(second.drop("__need"), ["__g", "__a", "__b"]).groupBy("__g", "__a", "__b", "__x").agg(times.alias("__n"))
    last = counted.join(second, ["__g", "__a", "__b"]).withColumn("__upto", F.sum("__n").over(Window.partitionBy("__g", "__a", "__b").orderBy("__x")))
    found = last.select("__g", "__x", "__n", "__upto", F.explode("__need").alias("__k")).where((F.col("__k.rank") <= F.col("__upto")) & (F.col("__k.rank") > F.col("__upto") - F.col("__n")))
    at = found.groupBy("__g").agg(F.map_from_entries(F.collect_list(F.struct("__k.pos", "__x"))).alias("__at"))
    every = parts.groupBy("__g").agg(F.first("n").alias("n")).join(at, "__g", "left")
    values = F.transform(wanted(F.col("n")), lambda k, i: F.try_element_at("__at", i))
    return every.select(*[F.col(f"__g.`{c}`").alias(c) for c in by], "n", values.alias("values"))


def values_without(df: DataFrame, value: Column, by: list[str], part: str, parts: int, wanted: Callable[[Column], Column], stored: bool = False) -> DataFrame:
    """``by...``, ``without``, ``n`` and ``values``: :func:`values_at` for each of the ``parts`` (numbers from 0) over the rows of all others.

    Rows are not expanded: counts of ranges, of their cells and of single values are taken by part, and only those are
    added up for the parts that they serve. Rows of no part serve none.
    """
    group = F.struct(*[F.col(c) for c in by]) if by else F.struct(F.lit(0).alias("__all"))
    rows = df.select(group.alias("__g"), F.col(part).cast("int").alias("__p"), value.cast("double").alias("__x")).where((F.abs("__x") < float("inf")) & F.col("__p").isNotNull())
    rows = (rows if stored else written(rows, "values")).withColumn("__a", _octave(F.col("__x")))
    n, total = F.count(F.lit(1)).alias("__s"), F.sum("__s").alias("__s")
    served = F.explode(F.filter(F.sequence(F.lit(0), F.lit(parts - 1)), lambda f: f != F.col("__p"))).alias("__f")
    octaves = written(rows.groupBy("__g", "__p", "__a").agg(n, F.min("__x").alias("__lo"), F.max("__x").alias("__hi")), "octaves")
    mine = octaves.select("__g", "__a", "__s", served).groupBy("__g", "__f", "__a").agg(total)
    mine = written(mine.withColumn("n", F.sum("__s").over(Window.partitionBy("__g", "__f"))), "octaves-served")
    numbered = F.transform(wanted(F.col("n")), lambda k, i: F.struct(i.alias("pos"), k.cast("long").alias("rank")))
    first = _hits(mine, ["__g", "__f"], "__a", numbered)
    spans = octaves.groupBy("__g", "__a").agg(F.min("__lo").alias("__lo"), F.max("__hi").alias("__hi"))
    near = rows.join(broadcast_if_small(written(first.select("__g", "__a").distinct().join(spans, ["__g", "__a"]), "hit-octaves")), ["__g", "__a"]).withColumn("__b", _place())
    cells = near.groupBy("__g", "__a", "__b", "__p").agg(n).select("__g", "__a", "__b", "__s", served).groupBy("__g", "__f", "__a", "__b").agg(total)
    second = _hits(cells.join(first, ["__g", "__f", "__a"]), ["__g", "__f", "__a"], "__b", F.col("__need"))
    few = near.join(broadcast_if_small(written(second.select("__g", "__a", "__b").distinct(), "hit-cells")), ["__g", "__a", "__b"])
    counted = few.groupBy("__g", "__a", "__b", "__p", "__x").agg(n).select("__g", "__a", "__b", "__x", "__s", served).groupBy("__g", "__f", "__a", "__b", "__x").agg(total)
    last = counted.join(second, ["__g", "__f", "__a", "__b"]).withColumn("__upto", F.sum("__s").over(Window.partitionBy("__g", "__f", "__a", "__b").orderBy("__x")))
    found = last.select("__g", "__f", "__x", "__s", "__upto", F.explode("__need").alias("__k")).where((F.col("__k.rank") <= F.col("__upto")) & (F.col("__k.rank") > F.col("__upto") - F.col("__s")))
    at = found.groupBy("__g", "__f").agg(F.map_from_entries(F.collect_list(F.struct("__k.pos", "__x"))).alias("__at"))
    every = mine.groupBy("__g", "__f").agg(F.first("n").alias("n")).join(at, ["__g", "__f"], "left")
    values = F.transform(wanted(F.col("n")), lambda k, i: F.try_element_at("__at", i))
    return every.select(*[F.col(f"__g.`{c}`").alias(c) for c in by], F.col("__f").alias("without"), "n", values.alias("values"))


def values_by_cell(df: DataFrame, value: Column, cell: list[str], weights: DataFrame, to: list[str], wanted: Callable[[Column], Column], stored: bool = False) -> DataFrame:
    """``to...``, ``n`` (total weight) and ``values``: :func:`values_at` for every group ``to`` of ``weights`` (``to..., cell..., weight``), in which a row stands for the weight of its cell.

    A cell may serve many groups. Rows are not expanded: counts of ranges, of their cells and of single values are
    taken by cell, and only counts are multiplied and added up. Weights are rounded to nine decimals, so sums are exact in any
    order; rows of cells without a weight above zero serve none. ``weights`` has a row for each group and cell.
    """
    rows = df.select(F.struct(*cell).alias("__p"), value.cast("double").alias("__x")).where(F.abs("__x") < float("inf"))
    rows = (rows if stored else written(rows, "values")).withColumn("__a", _octave(F.col("__x")))
    held = written(weights.select(F.struct(*to).alias("__g"), F.struct(*cell).alias("__p"), F.col("weight").cast("decimal(18,9)").alias("__w")).where("__w > 0"), "cell-weights")
    n, total = F.count(F.lit(1)).alias("__n"), F.sum(F.col("__n").cast("decimal(18,0)") * F.col("__w")).cast("decimal(28,9)").alias("__s")
    octaves = written(rows.groupBy("__p", "__a").agg(n, F.min("__x").alias("__lo"), F.max("__x").alias("__hi")), "octaves")
    mine = octaves.join(held, "__p").groupBy("__g", "__a").agg(total)
    mine = written(mine.withColumn("n", F.sum("__s").over(Window.partitionBy("__g"))), "octaves-served")
    numbered = F.transform(wanted(F.col("n")), lambda k, i: F.struct(i.alias("pos"), k.cast("decimal(38,12)").alias("rank")))
    first = _hits(mine, ["__g"], "__a", numbered)
    spans = octaves.groupBy("__a").agg(F.min("__lo").alias("__lo"), F.max("__hi").alias("__hi"))
    near = rows.join(broadcast_if_small(written(first.select("__a").distinct().join(spans, "__a"), "hit-octaves")), "__a").withColumn("__b", _place())
    served = written(first.select("__g", "__a").join(held, "__g"), "hit-weights")
    cells = near.groupBy("__a", "__b", "__p").agg(n).join(served, ["__a", "__p"]).groupBy("__g", "__a", "__b").agg(total)
    second = _hits(cells.join(first, ["__g", "__a"]), ["__g", "__a"], "__b", F.col("__need"))
    few = near.join(broadcast_if_small(written(second.select("__a", "__b").distinct(), "hit-cells")), ["__a", "__b"])
    counted = few.groupBy("__a", "__b", "__p", "__x").agg(n).join(written(second.select("__g", "__a", "__b").join(held, "__g"), "hit-cell-weights"), ["__a", "__b", "__p"]).groupBy("__g", "__a", "__b", "__x").agg(total)
    last = counted.join(second, ["__g", "__a", "__b"]).withColumn("__upto", F.sum("__s").over(Window.partitionBy("__g", "__a", "__b").orderBy("__x")))
    found = last.select("__g", "__x", "__s", "__upto", F.explode("__need").alias("__k")).where((F.col("__k.rank") <= F.col("__upto")) & (F.col("__k.rank") > F.col("__upto") - F.col("__s")))
    at = found.groupBy("__g").agg(F.map_from_entries(F.collect_list(F.struct("__k.pos", "__x"))).alias("__at"))
    every = mine.groupBy("__g").agg(F.first("n").alias("n")).join(at, "__g", "left")
    values = F.transform(wanted(F.col("n")), lambda k, i: F.try_element_at("__at", i))
    return every.select(*[F.col(f"__g.`{c}`").alias(c) for c in to], "n", values.alias("values"))


def _shares(probs: list[str]) -> Callable[[Column], Column]:
    """The weights at which each of ``probs`` (decimals as text) is reached."""
    return lambda n: F.array(*[(n.cast("decimal(28,9)") * F.lit(Decimal(p))).cast("decimal(38,12)") for p in probs])


def weighted_quantiles(df: DataFrame, value: Column, by: list[str], probs: list[str], weight: Column, stored: bool = False) -> DataFrame:
    """``by...``, ``total`` and ``values``: of every group the smallest value up to which at least the share p of the weight lies, for each of ``probs`` (decimals as text).

    Weights may be fractions. They are rounded to nine decimals, so that their sums are exact, whatever the order of rows;
    rows whose weight is null or not above zero do not count.
    """
    rows = df.select(*by, value.alias("__v"), weight.cast("decimal(18,9)").alias("__w")).where("__w > 0")
    found = values_at(rows, F.col("__v"), by, _shares(probs), "__w", stored, "decimal(38,12)")
    return found.select(*by, F.col("n").alias("total"), "values")


def weighted_quantiles_by_cell(df: DataFrame, value: Column, cell: list[str], weights: DataFrame, to: list[str], probs: list[str], stored: bool = False) -> DataFrame:
    """:func:`weighted_quantiles` for every group ``to`` of :func:`values_by_cell`, whose rows have the weights of their cells."""
    found = values_by_cell(df, value, cell, weights, to, _shares(probs), stored)
    return found.select(*to, F.col("n").alias("total"), "values")


def _neighbours(n: Column, probs: list[float]) -> Column:
    """The two ranks around each quantile."""
    return F.flatten(F.transform(F.array(*[F.lit(float(p)) for p in probs]), lambda p: F.array(F.floor((n - 1) * p) + 1, F.ceil((n - 1) * p) + 1)))


def _between(probs: list[float]) -> Column:
    """The quantiles from ``n`` and the ``values`` at :func:`_neighbours`."""
    value = lambda i: F.get("values", i)
    return F.transform(F.array(*[F.lit(float(p)) for p in probs]), lambda p, i: value(2 * i) + (value(2 * i + 1) - value(2 * i)) * ((F.col("n") - 1) * p - F.floor((F.col("n") - 1) * p)))


def quantiles_without(df: DataFrame, value: Column, probs: list[float], by: list[str], part: str, parts: int, stored: bool = False) -> DataFrame:
    """``by...``, ``without`` and ``q``: of every group and part the exact quantiles over the rows of all other parts."""
    found = values_without(df, value, by, part, parts, lambda n: _neighbours(n, probs), stored)
    return found.select(*by, "without", _between(probs).alias("q"))


def quantiles(df: DataFrame, values: dict[str, Column], probs: list[float], by: list[str] | None = None, weight: str | None = None, stored: bool = False) -> DataFrame:
    """``by...`` and for each of ``values`` an array of its exact quantiles at ``probs``, between neighbours in proportion.

    Quantiles of all ``values`` are found together. A value that is null or not finite does not count; a group
    without any value at all has no row; without ``by`` there is always one row. ``stored`` is that of :func:`values_at`.
    """
    by = by or []
    pairs = [F.struct(F.lit(k).alias("__name"), v.cast("double").alias("__v")) for k, v in values.items()]
    rows = df.select(*by, *([weight] if weight else []), (F.explode(F.array(*pairs)) if len(pairs) > 1 else pairs[0]).alias("__p")).select(*by, *([weight] if weight else []), "__p.*")
    found = values_at(rows, F.col("__v"), [*by, "__name"], lambda n: _neighbours(n, probs), weight, stored)
    return found.withColumn("__q", _between(probs)).groupBy(*by).agg(*[F.max(F.when(F.col("__name") == k, F.col("__q"))).alias(k) for k in values])


def with_quantiles(base: DataFrame, df: DataFrame, columns: dict[str, tuple[Column, float]], by: list[str] | None = None, weight: str | None = None, stored: bool = False) -> DataFrame:
    """``base`` (a row for each group in ``by``) with a column for each quantile (value, probability) of ``df``; null where there is no value. ``weight`` and ``stored`` are those of :func:`quantiles`."""
    by = by or []
    names: dict[str, str] = {}
    values: dict[str, Column] = {}
    for value, _ in columns.values():
        if str(value) not in names:
            names[str(value)] = f"__v{len(names)}"
            values[names[str(value)]] = value
    probs = sorted({p for _, p in columns.values()})
    found = quantiles(df, values, probs, by, weight, stored)
    found = found.select(*[F.col(c).alias(f"__by_{c}") for c in by], *[F.get(names[str(v)], F.lit(probs.index(p))).alias(name) for name, (v, p) in columns.items()])
    joined = base.join(found, [F.col(c).eqNullSafe(F.col(f"__by_{c}")) for c in by], "left") if by else base.join(F.broadcast(found.agg(*[F.first(c).alias(c) for c in columns])))
    return joined.drop(*[f"__by_{c}" for c in by])


def ordered_ranges(df: DataFrame, order: list[Column], label: str) -> DataFrame:
    """``df`` written in ranges that Spark cuts to one size by ``order``, with ``__range`` (ranges ascend in that order)."""
    return written(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), label)


def running_sums(df: DataFrame, by: list[str], order: list[Column], sums: dict[str, Column], label: str = "running") -> DataFrame:
    """``df`` with ``rank`` (from 1) and the running sums of ``sums`` in ``order`` within ``by``; ``order`` must be total.

    Rows are cut into ranges of ``by`` and ``order``; sums within a range are added to those of the ranges before.
    So a group is as many tasks as it needs, and ``by`` may be empty.
    """
    rows = ordered_ranges(df.select("*", *[c.alias(f"__{k}") for k, c in sums.items()]), [*map(F.col, by), *order], label)
    totals = rows.groupBy(*by, "__range").agg(F.count(F.lit(1)).alias("__n"), *[F.sum(f"__{k}").alias(f"__{k}") for k in sums])
    before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = written(totals.select(*[F.col(c).alias(f"__by_{c}") for c in by], F.col("__range").alias("__r"), *[F.coalesce(F.sum(f"__{k}").over(before), F.lit(0)).alias(f"__0{k}") for k in ["n", *sums]]), f"{label}-starts")
    inside = Window.partitionBy(*by, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.join(broadcast_if_small(starts), [F.col("__range") == F.col("__r"), *[F.col(c).eqNullSafe(F.col(f"__by_{c}")) for c in by]])
    return joined.select(*df.columns, (F.row_number().over(inside) + F.col("__0n")).alias("rank"), *[(F.sum(f"__{k}").over(inside) + F.col(f"__0{k}")).alias(k) for k in sums])
