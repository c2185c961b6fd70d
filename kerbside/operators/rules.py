"""Ordered rejection rules, contracts, permissions and gates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.functions import scalars as S
from kerbside.staging import broadcast_if_small, written

Rule = tuple[str, Column]


def first_failure(rules: list[Rule]) -> Column:
    """PRJ-3: the reason of the first rule that fails; null if none does. A rule that is null holds."""
    return F.coalesce(*[F.when(F.coalesce(failed, F.lit(False)), F.lit(reason)) for reason, failed in rules])


def with_reason(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """``df`` with ``reason_code`` (null: accepted); split it with two filters. The cascade is looked at once for a row, whatever follows."""
    return df.select(*[c for c in df.columns if c != "reason_code"], S.once(first_failure(rules)).alias("reason_code"))


def target_violations(df: DataFrame, target: str) -> DataFrame:
    """PRJ-2: how many targets are null, not finite, or not positive."""
    x = F.col(target)
    return df.agg(F.count_if(x.isNull()).alias("n_null"), F.count_if(F.isnan(x) | (F.abs(x) == float("inf"))).alias("n_not_finite"), F.count_if(x <= 0).alias("n_not_positive"))


def listing_rules(first_year: int = 1886, last_year: int = 2025) -> list[Rule]:
    """PRJ-4: the invariants of a canonical row."""
    c = F.col
    return [
        ("country_invalid", c("market_country") != "US"), ("currency_invalid", c("currency") != "USD"), ("year_invalid", c("year").isNull() | ~c("year").between(first_year, last_year)),
        ("price_invalid", c("price_cents").isNull() | (c("price_cents") <= 0)), ("mileage_invalid", c("mileage") < 0), ("status_invalid", ~c("vehicle_status").isin("new", "used", "certified")),
        ("digest_invalid", ~c("raw_content_sha256").rlike("^[0-9a-f]{64}$")), ("url_invalid", ~c("canonical_url").rlike("^https?://")),
    ]


def region_rules(region: Column, allowed: list[str]) -> list[Rule]:
    """PRJ-5: malformed and foreign regions have different reasons."""
    return [("state_invalid", region.isNull() | ~region.rlike("^[A-Z]{2}$")), ("market_not_us", ~region.isin(allowed))]


def range_flags(low: Column, high: Column) -> list[Column]:
    """PRJ-6: what is wrong with a price range."""
    both = low.isNotNull() & high.isNotNull()
    return [
        F.coalesce(both & (low > 0) & (high > 0) & (low <= high), F.lit(False)).alias("valid"), (low.isNull() & high.isNull()).alias("both_missing"), (low.isNull() != high.isNull()).alias("one_missing"),
        F.coalesce(low > high, F.lit(False)).alias("inverted"), F.coalesce((low == 0) | (high == 0), F.lit(False)).alias("zero"), F.coalesce((low < 0) | (high < 0), F.lit(False)).alias("negative"), F.coalesce(low == high, F.lit(False)).alias("equal"),
    ]


def gate_by_permission(df: DataFrame, permissions: DataFrame, source: str, use: str, day: Column) -> DataFrame:
    """PRJ-7: ``df`` with ``approved``: a grant of this use to this source that holds on the day. Unknown sources are denied.

    ``permissions`` has ``source, use, granted_from, granted_until``; a source may have several grants. They are a row for each
    source and go to the rows, so that rows of one source do not meet in one task.
    """
    grants = permissions.where(F.col("use") == use).select(F.col("source").alias("__source"), "granted_from", "granted_until").groupBy("__source").agg(F.collect_set(F.struct("granted_from", "granted_until")).alias("__grants"))
    held = F.exists("__grants", lambda g: (day >= g["granted_from"]) & (g["granted_until"].isNull() | (day < g["granted_until"])))
    return df.join(broadcast_if_small(written(grants, "grants")), F.col(source) == F.col("__source"), "left").withColumn("approved", F.coalesce(held, F.lit(False))).drop("__source", "__grants")


def training_exclusion(kind: Column, currency: Column, kinds: list[str], wanted: str = "USD") -> Column:
    """PRJ-8: why a row may not be trained on; null if it may."""
    return F.when(~kind.isin(kinds), F.concat(F.lit("price_kind_not_approved:"), kind)).when(currency != wanted, F.concat(F.lit("currency_not_approved:"), currency))


def leakage_audit(df: DataFrame, denied: dict[str, str]) -> DataFrame:
    """PRJ-9: a row for each denied predictor: its reason, whether ``df`` has it, and how many rows would leak a value."""
    count = lambda name: F.count_if(~S.is_missing(F.col(name))) if name in df.columns else F.lit(0).cast("long")
    one = df.agg(F.count(F.lit(1)).alias("__n"), *[count(name).alias(f"__{k}") for k, name in enumerate(denied)])
    rows = [F.struct(F.lit(name).alias("column"), F.lit(reason).alias("reason"), F.lit(name in df.columns).alias("present"), F.col(f"__{k}").alias("values")) for k, (name, reason) in enumerate(denied.items())]
    return one.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def sentinel_audit(df: DataFrame, columns: list[str], sentinel: str) -> DataFrame:
    """PRJ-10: for each column how many values are the sentinel, missing, or exposed. One pass."""
    kinds = lambda c: F.struct(F.lit(c).alias("column"), F.when(S.is_missing(F.col(c)), "missing").when(F.col(c).cast("string") == sentinel, "sentinel").otherwise("exposed").alias("kind"))
    long = df.select(F.explode(F.array(*[kinds(c) for c in columns])).alias("x")).select("x.*")
    return long.groupBy("column").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("sentinel", "missing", "exposed")])


def url_violation(url: Column, allowed: Callable[[Column], Column], prefix: str, keys: list[str], most: int = 2048) -> Column:
    """PRJ-12: the first thing that is wrong with a URL; null if nothing is. ``allowed`` tells of a host whether it may be used."""
    part = lambda k: F.regexp_extract(url, r"^([a-z]+)://([^/?#@]*@)?([^/?#:]*)(:[0-9]*)?([^?#]*)(\?[^#]*)?(#.*)?$", k)
    path = F.coalesce(F.try_url_decode(part(5)), part(5))
    names = F.filter(F.transform(F.split(F.substring(part(6), F.lit(2), F.length(url)), "&"), lambda x: F.regexp_extract(x, "^[^=]*", 0)), lambda x: x != "")
    return first_failure([
        ("too_long", url.isNull() | (F.length(url) > most)), ("scheme", ~part(1).isin("http", "https")), ("userinfo", part(2) != ""), ("host", ~allowed(part(3))), ("port", part(4) != ""),
        ("fragment", part(7) != ""), ("path", ~path.startswith(prefix) | path.contains("..")), ("query", F.size(F.array_except(names, F.array(*[F.lit(k) for k in keys]))) > 0),
    ])


def provenance_violations(rows: DataFrame, run: DataFrame, columns: list[str]) -> DataFrame:
    """PRJ-13: rows whose provenance is not the run's (one row of ``run`` for each ``run_id``), with the first column that differs.

    Runs go to the rows, so that rows of one run do not meet in one task.
    """
    other = broadcast_if_small(written(run.select(F.col("run_id").alias("__run"), *[F.col(c).alias(f"__{c}") for c in columns]), "runs"))
    reason = first_failure([(c, ~F.col(c).eqNullSafe(F.col(f"__{c}"))) for c in columns])
    joined = rows.join(other, F.col("run_id") == F.col("__run"), "left")
    return joined.withColumn("differs", F.when(F.col("__run").isNull(), "run_id").otherwise(reason)).where("differs is not null").select(*rows.columns, "differs")


def evaluate_gates(metrics: DataFrame, rules: list[tuple[str, str, str, float]]) -> DataFrame:
    """P5 / EVL-15: ``gate, observed, operator, threshold, passed`` for rules (gate, metric, operator, threshold).

    ``metrics`` is a small long table ``metric, value``. A metric that is missing or null fails its gate.
    """
    table = metrics.sparkSession.createDataFrame([(g, m, o, float(t)) for g, m, o, t in rules], "gate string, metric string, operator string, threshold double")
    x, t = F.col("value"), F.col("threshold")
    held = F.when(F.col("operator") == "<=", x <= t).when(F.col("operator") == ">=", x >= t).when(F.col("operator") == "<", x < t).when(F.col("operator") == ">", x > t)
    return table.join(metrics, "metric", "left").select("gate", F.col("value").alias("observed"), "operator", "threshold", F.coalesce(held, F.lit(False)).alias("passed"))


def classify(gates: DataFrame, strict: list[str], loose: list[str]) -> DataFrame:
    """EVL-15: ``strong`` if all strict gates pass, ``portfolio`` if all loose ones do, else ``rejected``."""
    every = lambda names: F.coalesce(F.bool_and(F.when(F.col("gate").isin(names), F.col("passed"))), F.lit(False))
    return gates.agg(F.when(every(strict), "strong").when(every(loose), "portfolio").otherwise("rejected").alias("classification"))
