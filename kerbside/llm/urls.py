"""URL filters with dated lists, in DataFrame functions only.

A list is a history: from some time on a pattern is blocked, allowed or off the list again. Each pattern's
history becomes validity intervals, and every capture is joined with the intervals of the patterns that its
URL can match and that hold at its fetch time; the most specific one decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbside.staging import written

#: Later wins if one pattern changes twice at one time.
ACTIONS = ["remove", "allow", "block"]


def url_host(url: Column) -> Column:
    """The lower-case host without user, port and final dots; null if the URL has no scheme or no host."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    host = F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r"\.*(:[0-9]*)?$", ""))
    return F.when(host != "", host)


def url_path(url: Column) -> Column:
    """The path without its first slash, query and fragment."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*/([^?#]*)", 1)


def validity_intervals(entries: DataFrame) -> DataFrame:
    """``scope, pattern, action, valid_from, valid_to`` (exclusive; null: still valid) from dated entries.

    ``entries`` has ``scope`` (``domain``: a host and all below it; ``host``: that host; ``prefix``: a host and the
    first segments of a path, such as ``example.org/a/b``; case does not count, in paths either), ``pattern``, ``action`` (one of ``ACTIONS``) and
    ``listed_at``. Entries with a null or another action say nothing; repeated ones count once. A pattern's
    own history is what one window partition holds.
    """
    rank = F.array_position(F.array(*[F.lit(a) for a in ACTIONS]), F.col("action"))
    known = entries.where(F.col("action").isin(ACTIONS) & F.col("pattern").isNotNull() & F.col("scope").isNotNull() & F.col("listed_at").isNotNull())
    changes = known.groupBy("scope", F.lower("pattern").alias("pattern"), "listed_at").agg(F.max(rank).alias("rank"))
    history = Window.partitionBy("scope", "pattern").orderBy("listed_at")
    spans = changes.select("scope", "pattern", F.element_at(F.array(*[F.lit(a) for a in ACTIONS]), F.col("rank").cast("int")).alias("action"), F.col("listed_at").alias("valid_from"), F.lead("listed_at").over(history).alias("valid_to"))
    return spans.where(F.col("action") != "remove")


def filter_urls(captures: DataFrame, entries: DataFrame, url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """``captures`` with ``host``, ``verdict`` and the interval that decided (``scope, pattern, valid_from, valid_to``).

    The verdict is ``block`` or ``allow`` of the most specific interval valid at the fetch time (a longer path
    before a host before a longer domain), ``pass`` if there is none, ``invalid`` without a host. A null time
    matches no interval. Rows that repeat stay; columns of those names are replaced. Each distinct URL and
    time is matched once. No pattern has more parts than the list's longest, so no longer key is made.
    """
    out = ["host", "verdict", "scope", "pattern", "valid_from", "valid_to"]
    intervals = written(validity_intervals(entries), "url-intervals")
    depth = intervals.agg(
        F.coalesce(F.max(F.when(F.col("scope") == "domain", F.size(F.split("pattern", r"\.")))), F.lit(0)).alias("labels"),
        F.coalesce(F.max(F.when(F.col("scope") == "prefix", F.size(F.split("pattern", "/")) - 1)), F.lit(0)).alias("segments"),
    ).first()
    rows = captures.select(F.struct("*").alias("__row"), F.col(url_col).cast("string").alias("__url"), F.col(time_col).alias("__time"))
    asked = rows.select("__url", "__time", url_host(F.col("__url")).alias("__host"), F.lower(url_path(F.col("__url"))).alias("__path")).where(F.col("__host").isNotNull() & F.col("__time").isNotNull()).distinct()
    parts = asked.select("__url", "__time", "__host", F.split("__host", r"\.").alias("__labels"), F.when(F.col("__path") != "", F.split("__path", "/")).otherwise(F.array().cast("array<string>")).alias("__segments"))
    up_to = lambda n, most: F.when(F.least(n, F.lit(most)) >= 1, F.sequence(F.lit(1), F.least(n, F.lit(most)))).otherwise(F.array().cast("array<int>"))
    labels, segments = F.col("__labels"), F.col("__segments")
    key = lambda scope, pattern, level: F.struct(F.lit(scope).alias("scope"), pattern.alias("pattern"), F.lit(level).alias("level"))
    domains = F.transform(up_to(F.size(labels), depth["labels"]), lambda k: key("domain", F.array_join(F.slice(labels, F.size(labels) - k + 1, k), "."), 1))
    prefixes = F.transform(up_to(F.size(segments), depth["segments"]), lambda k: key("prefix", F.concat("__host", F.lit("/"), F.array_join(F.slice(segments, F.lit(1), k), "/")), 3))
    keys = parts.select("__url", "__time", F.explode(F.concat(domains, F.array(key("host", F.col("__host"), 2)), prefixes)).alias("k")).select("__url", "__time", "k.*")
    valid = (F.col("__time") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("__time") < F.col("valid_to")))
    found = keys.join(intervals, ["scope", "pattern"]).where(valid)
    most = F.max_by(F.struct(F.col("action").alias("verdict"), "scope", "pattern", "valid_from", "valid_to"), F.struct("level", F.length("pattern")))
    decided = found.groupBy("__url", "__time").agg(most.alias("__by")).select(F.col("__url").alias("__u"), F.col("__time").alias("__t"), "__by")
    joined = rows.join(decided, (F.col("__url") == F.col("__u")) & (F.col("__time") == F.col("__t")), "left")
    host = url_host(F.col("__url"))
    verdict = F.when(host.isNull(), "invalid").otherwise(F.coalesce(F.col("__by.verdict"), F.lit("pass")))
    kept = [F.col(f"__row.`{c}`") for c in captures.columns if c not in out]
    return joined.select(*kept, host.alias("host"), verdict.alias("verdict"), *[F.col(f"__by.{c}").alias(c) for c in out[2:]])
