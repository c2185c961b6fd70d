"""Leakage-safe splits, folds and exact samples from hash-ranked groups.

Order always comes from a digest and ends in a unique column, so results do not depend on partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbside.operators.quantiles import quantiles, running_sums
from kerbside.staging import broadcast_if_small, written


def seeded_digest(seed: str, *columns: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("\x00")) for c in columns]), 256)


#: Rows that a digest bucket holds on average, at most.
BUCKET_ROWS = 100_000


def _digits(n: int) -> int:
    """Leading digest digits that keep a bucket of ``n`` rows below ``BUCKET_ROWS`` on average."""
    digits = 1
    while digits < 8 and n > BUCKET_ROWS * 16**digits:
        digits += 1
    return digits


def prefix_sums(df: DataFrame, by: list[str], digest: str, value: str, digits: int | None = None) -> DataFrame:
    """``df`` with ``running`` and ``rank`` (inclusive) of its rows in digest order within ``by``; nulls in ``by`` are values.

    Two levels: rows are summed within buckets of equal leading hex digits, buckets within ``by``. A stratum
    with a third of all rows is thus ``16 ** digits`` tasks, not one; without ``digits`` rows are counted for as
    many as keep a bucket below ``BUCKET_ROWS``.
    """
    if digits is None:
        digits = _digits(df.count())
    rows = df.withColumn("__bucket", F.substring(digest, 1, digits))
    buckets = rows.groupBy(*by, "__bucket").agg(F.sum(value).alias("__v"), F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets.select(*[F.col(c).alias(f"__by_{c}") for c in by], F.col("__bucket").alias("__b"), F.coalesce(F.sum("__v").over(before), F.lit(0)).alias("__v0"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__n0"))
    inside = Window.partitionBy(*by, "__bucket").orderBy(digest).rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.join(starts, [F.col("__bucket") == F.col("__b"), *[F.col(c).eqNullSafe(F.col(f"__by_{c}")) for c in by]])
    found = joined.withColumn("running", F.sum(value).over(inside) + F.col("__v0")).withColumn("rank", F.row_number().over(inside) + F.col("__n0"))
    return found.drop("__bucket", "__b", "__v0", "__n0", *[f"__by_{c}" for c in by])


def closest_prefix_groups(df: DataFrame, group: list[str], stratum: str, num: int, den: int, seed: str, times: str | None = None) -> DataFrame:
    """SPL-1: ``stratum, group..., n, selected``: the digest-ordered prefix of whole groups closest to num/den of the stratum's rows, each of which may stand for ``times`` rows.

    Deviations are compared as whole numbers, ``abs(running * den - total * num)``; ties take the smaller
    prefix and the empty prefix takes part. Null groups and strata are groups and strata. Target-free.
    """
    name = "__s"
    keyed = df.withColumn(name, F.coalesce(F.col(stratum).cast("string"), F.lit("\x00")))
    groups = written(keyed.groupBy(name, stratum, *group).agg((F.sum(times) if times else F.count(F.lit(1))).alias("n")).withColumn("__digest", seeded_digest(seed, F.col(stratum), *[F.col(g) for g in group])), "split-sizes")
    ranked = written(prefix_sums(groups, [name], "__digest", "n"), "split-groups")
    totals = ranked.groupBy(name).agg(F.sum("n").alias("__total"))
    off = F.abs(F.col("running") * den - F.col("__total") * num)
    best = ranked.join(totals, name).groupBy(name).agg(F.min(F.struct(off.alias("off"), F.col("rank").cast("long").alias("rank"))).alias("__b"), F.first("__total").alias("__total"))
    cut = best.select(name, F.least(F.col("__b"), F.struct((F.col("__total") * num).alias("off"), F.lit(0).cast("long").alias("rank")))["rank"].alias("__cut"))
    return ranked.join(broadcast_if_small(written(cut, "split-cuts")), name).select(stratum, *group, "n", (F.col("rank") <= F.col("__cut")).alias("selected"))


def closest_prefix_split(df: DataFrame, group: list[str], stratum: str, num: int, den: int, seed: str) -> DataFrame:
    """SPL-1..3: ``df`` with ``selected``, the same for all rows of a group."""
    chosen = closest_prefix_groups(df, group, stratum, num, den, seed).drop("n")
    other = chosen.select(*[F.col(c).alias(f"__{c}") for c in [stratum, *group]], "selected")
    on = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in [stratum, *group]]
    return df.join(other, on).drop(*[f"__{c}" for c in [stratum, *group]])


def screening_sample(df: DataFrame, group: list[str], stratum: str, num: int, den: int, seed: str) -> DataFrame:
    """SPL-3: :func:`closest_prefix_groups` for a proper fraction num/den; an error if a stratum, the null one included, would keep no group.

    The closest prefix is empty where the first group alone is farther from the share than none. An empty table gives no rows.
    """
    if not 0 < num < den:
        raise ValueError(f"{num}/{den} is not a proper fraction")
    chosen = written(closest_prefix_groups(df, group, stratum, num, den, seed), "screening")
    empty = chosen.groupBy(stratum).agg(F.max("selected").alias("__any")).where(~F.col("__any"))
    n, example = empty.agg(F.count(F.lit(1)), F.min(F.coalesce(F.col(stratum).cast("string"), F.lit("null")))).first()
    if n:
        raise ValueError(f"{n} strata would be empty, such as {example!r}")
    return chosen


def ranked_sample(df: DataFrame, bucket: str, key: str, num: int, den: int, seed: str) -> DataFrame:
    """SPL-4: ``bucket, key, selected`` for every row: rows ranked by digest, as many as lie closest to num/den (half rounds down). A null bucket is one like others."""
    rows = df.select(bucket, key).withColumn("__digest", seeded_digest(seed, F.col(bucket), F.col(key))).withColumn("__one", F.lit(1).cast("long"))
    ranked = prefix_sums(rows, [bucket], "__digest", "__one")
    totals = df.groupBy(F.col(bucket).alias("__of")).agg(F.count(F.lit(1)).alias("__total"))
    want = F.ceil((2 * F.col("__total") * num - den) / F.lit(2 * den))
    return ranked.join(totals, F.col(bucket).eqNullSafe(F.col("__of"))).select(bucket, key, (F.col("rank") <= want).alias("selected"))


def chrono_group_split(df: DataFrame, key: str, day: str, cutoff: str) -> DataFrame:
    """SPL-5: ``df`` with ``split``: a row on or after the cutoff is test, and so is every row of a group that has one.

    ``promoted`` marks earlier rows that moved with their group; ``last_day`` is the group's latest day.
    """
    late = F.col(day) >= F.lit(cutoff).cast("date")
    groups = df.groupBy(F.col(key).alias("__key")).agg(F.max(late).alias("__test"), F.max(day).alias("last_day"))
    joined = df.join(groups, F.col(key) == F.col("__key")).withColumn("split", F.when(F.col("__test"), "test").otherwise("train"))
    return joined.withColumn("promoted", F.col("__test") & ~late).drop("__key", "__test")


def split_metrics(split: DataFrame, key: str, day: str, cutoff: str, by: str = "split") -> DataFrame:
    """SPL-7: rows, groups, promoted rows and groups of each part (or bucket), and its rows on or after the cutoff (none in training)."""
    late = (F.col(day) >= F.lit(cutoff).cast("date")).cast("long")
    groups = split.groupBy(by, key).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("promoted").cast("long")).alias("p"), F.sum(late).alias("l"))
    return groups.groupBy(by).agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_groups"), F.sum("p").alias("promoted_rows"), F.count_if(F.col("p") > 0).alias("promoted_groups"), F.coalesce(F.sum("l"), F.lit(0)).alias("rows_after_cutoff"))


def bucket_partition(df: DataFrame, bucket: str, buckets: list[str]) -> DataFrame:
    """SPL-8: the last bucket calibrates, the earlier ones develop; each must be there."""
    have = {r[0] for r in df.select(bucket).distinct().limit(len(buckets) + 2).collect()}
    if have - {None} != set(buckets):
        raise ValueError(f"buckets are {sorted(x for x in have if x is not None)}, not {buckets}")
    return df.withColumn("part", F.when(F.col(bucket) == buckets[-1], "calibration").when(F.col(bucket).isNotNull(), "development"))


def lightest_first(sizes: list[tuple[int, int]], k: int) -> dict[int, list[int]]:
    """For every size (size, number of groups), largest first, how many of its groups each of ``k`` folds gets if each group goes to the lightest fold (ties: the first).

    Groups of one size s go to the ``c`` smallest of ``load + j * s`` over all folds and j, so their numbers follow from the value up to which all are taken.
    """
    loads, given = [0] * k, {}
    for size, c in sorted(sizes, reverse=True):
        upto = lambda t: [max(0, (t - load) // size + 1) for load in loads]  # noqa: B023, E731
        low, high = min(loads) - 1, max(loads) + size * c
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if sum(upto(middle)) <= c else (low, middle - 1)
        counts = upto(low)
        left = c - sum(counts)
        for f in range(k):  # the next value is taken by the first folds that reach it
            if left and (low + 1 - loads[f]) % size == 0 and low + 1 >= loads[f]:
                counts[f], left = counts[f] + 1, left - 1
        loads = [load + size * n for load, n in zip(loads, counts)]
        given[size] = counts
    return given


def group_kfold(df: DataFrame, group: str, k: int) -> DataFrame:
    """SPL-10: ``group, n, fold``: groups by size, largest first, each to the fold with the fewest rows so far (ties: the first fold).

    The assignment runs over sizes, not groups: the driver gets the number of groups of each distinct size (at most
    the root of twice the rows), and a group's fold follows from its rank, by digest, among those of its size.
    """
    groups = written(df.groupBy(group).agg(F.count(F.lit(1)).alias("n")).withColumn("__digest", seeded_digest("kfold", F.col(group))), "kfold-groups")
    given = lightest_first([(r["n"], r["count"]) for r in groups.groupBy("n").count().collect()], k)
    upto = [(size, [sum(counts[: f + 1]) for f in range(k)]) for size, counts in given.items()]
    limits = df.sparkSession.createDataFrame(upto, "__n long, __upto array<long>")
    ranked = prefix_sums(groups.withColumn("__one", F.lit(1).cast("long")), ["n"], "__digest", "__one").join(limits, F.col("n") == F.col("__n"))
    return ranked.select(group, "n", F.size(F.filter("__upto", lambda x: x < F.col("rank"))).cast("int").alias("fold"))


def forward_folds(df: DataFrame, bucket: str, order: list[str]) -> DataFrame:
    """SPL-11: ``df`` once for each fold and role: fold f trains on buckets before f and validates on f; the first only trains."""
    position = F.array_position(F.array(*[F.lit(b) for b in order]), F.col(bucket)) - 1
    folds = df.sparkSession.range(1, len(order)).select(F.col("id").cast("int").alias("fold"))
    placed = df.drop("fold", "role").withColumn("__pos", position).where("__pos >= 0")
    return placed.join(F.broadcast(folds), F.col("__pos") <= F.col("fold")).withColumn("role", F.when(F.col("__pos") == F.col("fold"), "validate").otherwise("train")).drop("__pos")


def fold_check(folds: DataFrame, key: str) -> DataFrame:
    """SPL-12: rows validated once, never and more often, and rows with two roles in one fold."""
    each = folds.groupBy(key).agg(F.count_if(F.col("role") == "validate").alias("v"), F.count(F.lit(1)).alias("n"), F.count_distinct("fold").alias("f"))
    return each.agg(F.count_if(F.col("v") == 1).alias("once"), F.count_if(F.col("v") == 0).alias("never"), F.count_if(F.col("v") > 1).alias("often"), F.count_if(F.col("n") > F.col("f")).alias("two_roles"))


def _remainder(target: int, total: int) -> Column:
    """What is left of ``n * target`` over whole shares of ``total``; the product may need more than 64 bits."""
    return F.pmod(F.col("n").cast("decimal(19,0)") * F.lit(target).cast("decimal(19,0)"), F.lit(max(1, total)).cast("decimal(38,0)")).cast("long")


def _share(target: int, total: int) -> Column:
    """Whole shares: ``n * target div total``."""
    product = F.col("n").cast("decimal(19,0)") * F.lit(target).cast("decimal(19,0)")
    return F.call_function("div", product, F.lit(max(1, total)).cast("decimal(38,0)"))


def proportional_quotas(strata: DataFrame, key: str, target: int) -> DataFrame:
    """SPL-13: ``key, n, quota`` by largest remainder; ties go to the smaller key. ``strata`` has ``key`` and ``n``."""
    total = strata.agg(F.sum("n").alias("t")).first()["t"] or 0
    if not 0 <= target <= total:
        raise ValueError("the target must lie between 0 and the number of rows")
    base = strata.withColumns({"__floor": _share(target, total), "__rest": _remainder(target, total)})
    short = target - (base.agg(F.sum("__floor").alias("s")).first()["s"] or 0)
    ranked = running_sums(base, [], [F.desc("__rest"), F.col(key)], {}, "quota-ranks")
    return ranked.select(key, "n", (F.col("__floor") + (F.col("rank") <= short).cast("long")).alias("quota"))


def _full_rounds(current: DataFrame, excess: int) -> tuple[int, int]:
    """How many rounds, each giving one of every stratum that still can, take at most ``excess``; and what the next round has to give.

    Up to the spare s of a stratum all with at most s have given their own, the others s each: running sums over
    the distinct spares in order show the last of them that is within the excess.
    """
    spares = running_sums(current.groupBy("__spare").agg(F.count(F.lit(1)).alias("c")), [], [F.col("__spare")], {"upto": F.col("c").cast("decimal(38,0)"), "own": F.col("c") * F.col("__spare").cast("decimal(19,0)")}, "spares")
    many = current.count()
    given = F.col("own") + (F.lit(many) - F.col("upto")) * F.col("__spare").cast("decimal(19,0)")
    last = spares.where(given <= F.lit(excess).cast("decimal(38,0)")).agg(F.max(F.struct("__spare", given.alias("given"), "upto")).alias("x")).first()["x"]
    low, used, gone = (int(last["__spare"]), int(last["given"]), int(last["upto"])) if last else (0, 0, 0)
    if many > gone:  # between two spares every stratum that is left gives in every round
        more = (excess - used) // (many - gone)
        low, used = low + more, used + more * (many - gone)
    return low, excess - used


def nested_quotas(strata: DataFrame, key: str, target: int, minimum: str) -> DataFrame:
    """SPL-14: quotas for ``target`` of at least ``minimum``; the excess comes off strata above it, smallest remainder first, one each a round.

    The order of strata is fixed, and one that is above its minimum by s gives in the first s rounds. So how
    many rounds are full follows from the counts of s, and ranks among those that still give from one pass.
    """
    quotas = proportional_quotas(strata.select(key, "n"), key, target).withColumnRenamed("n", "__n").join(strata, key)
    total = strata.agg(F.sum("n").alias("t")).first()["t"] or 1
    rest = _remainder(target, total)
    quota = F.greatest("quota", minimum)
    current = written(quotas.select(key, "n", minimum, quota.alias("quota"), rest.alias("__rest"), (quota - F.col(minimum)).alias("__spare")), "quotas")
    sums = current.agg(F.coalesce(F.sum("quota"), F.lit(0)).alias("q"), F.coalesce(F.sum("__spare"), F.lit(0)).alias("s")).first()
    excess = sums["q"] - target
    if excess > sums["s"]:
        raise ValueError("the minimum sample is larger than the target")
    low, left = _full_rounds(current, max(0, excess))
    gives = (F.col("__spare") > low).cast("long")
    ranked = running_sums(current, [], [F.col("__rest"), F.col(key)], {"__turn": gives}, "quota-turns")
    down = F.least("__spare", F.lit(low)) + F.when((gives == 1) & (F.col("__turn") <= left), 1).otherwise(0)
    return ranked.select(key, "n", minimum, (F.col("quota") - down).alias("quota"))


def value_decile(df: DataFrame, value: str, name: str = "decile", upper: bool = False) -> DataFrame:
    """SPL-15: ``df`` with the decile (1 to 10, null for null) of ``value`` in the whole table, by exact edges.

    A value on an edge belongs to the part below it, or with ``upper`` to the part above; then edges that are equal count
    once, and the smallest and the largest value are no edges. Values that are not finite have no part in the edges.
    """
    steps = range(11) if upper else range(1, 10)
    edges = quantiles(df, {"__e": F.col(value)}, [k / 10 for k in steps]).agg(F.first("__e").alias("__e"))
    inner = F.filter(F.array_distinct("__e"), lambda e: (e > F.get("__e", F.lit(0))) & (e < F.get("__e", F.lit(10))))
    below = F.size(F.filter(inner, lambda e: e <= F.col(value)) if upper else F.filter("__e", lambda e: e < F.col(value)))
    return df.join(F.broadcast(edges)).withColumn(name, F.when(F.col(value).isNotNull(), 1 + below)).drop("__e")


def stratified_sample(df: DataFrame, key: str, stratum: str, quotas: DataFrame, seed: str) -> DataFrame:
    """SPL-15: the ``quota`` rows of each stratum with the smallest digests; quotas that grow give nested samples.

    Keys are counted by digest bucket of a stratum, and only those of buckets that begin within the quota are ranked; rows are joined with
    those that were chosen: ``key`` is unique. A null stratum is one like others; strata without a quota give no rows. ``df`` is read
    four times: it should be written.
    """
    keys = df.select(F.col(key).alias("__key"), F.col(stratum).alias("__stratum"), seeded_digest(seed, F.col(key)).alias("__digest"))
    keys = keys.withColumn("__bucket", F.substring("__digest", 1, _digits(df.count())))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("__stratum").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = keys.groupBy("__stratum", "__bucket").agg(F.count(F.lit(1)).alias("__n")).withColumn("__n0", before)
    limits = quotas.select(F.col(stratum).alias("__limited"), "quota")
    hit = starts.join(limits, F.col("__stratum").eqNullSafe(F.col("__limited"))).where(F.col("__n0") < F.col("quota"))
    hit = broadcast_if_small(written(hit.select(F.col("__stratum").alias("__of"), F.col("__bucket").alias("__b"), "__n0", "quota"), "sample-buckets"))
    near = keys.join(hit, (F.col("__bucket") == F.col("__b")) & F.col("__stratum").eqNullSafe(F.col("__of")))
    rank = F.row_number().over(Window.partitionBy("__stratum", "__bucket").orderBy("__digest")) + F.col("__n0")
    chosen = broadcast_if_small(written(near.withColumn("__rank", rank).where(F.col("__rank") <= F.col("quota")).select("__key"), "sample-keys"))
    return df.join(chosen, F.col(key).eqNullSafe(F.col("__key"))).drop("__key")
