"""Delayed outcomes: predictions wait for what really happened.

Batch forms define the results; the streaming forms keep state by event and by segment.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from kerbside.functions.scalars import identifier_ok
from kerbside.operators.quantiles import running_sums
from kerbside.operators.rules import Rule, first_failure
from kerbside.staging import written

_COLUMNS = ["outcome_id", "event_id", "source_id", "occurred_at", "prediction", "target", "reason_code"]
RESULT = "outcome_id string, event_id string, source_id string, occurred_at timestamp, prediction double, target double, reason_code string"


def event_rules() -> list[Rule]:
    """STR-1: what makes a prediction event invalid."""
    c = F.col
    return [("invalid_event_id", ~identifier_ok(c("event_id"))), ("invalid_source", c("source_id").isNull()), ("invalid_time", c("observed_at").isNull()), ("invalid_prediction", c("prediction").isNull() | F.isnan("prediction") | (c("prediction") <= 0))]


def validate_events(events: DataFrame) -> DataFrame:
    """STR-1: ``events`` (batch or stream) with ``reason_code``."""
    return events.withColumn("reason_code", first_failure(event_rules()))


def static_rules(approved: list[str]) -> list[Rule]:
    """STR-3: the checks after duplicates, unknown events and sources, in order. ``utc`` and ``features_valid`` are flags, true where not given."""
    c = F.col
    target = c("target").isNull() | F.isnan("target") | (F.abs("target") == float("inf")) | (c("target") <= 0)
    return [
        ("invalid_target", ~identifier_ok(c("outcome_id"))), ("source_not_approved", ~c("source_id").isin(approved)), ("outcome_before_prediction", c("occurred_at").isNull() | ~c("utc") | (c("occurred_at") < c("observed_at"))),
        ("invalid_predictors", ~c("features_valid")), ("invalid_target", target),
    ]


def _flag(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn(name, F.coalesce(F.col(name), F.lit(False)) if name in df.columns else F.lit(True))


def match_outcomes(predictions: DataFrame, outcomes: DataFrame, approved: list[str]) -> DataFrame:
    """STR-3, batch: every outcome with ``reason_code`` (null: accepted), in the order of checks.

    Of outcomes with one id, and of accepted ones with one event, the first by time and id counts and the
    others are duplicates. Predictions that repeat an event id count once, the first. ``predictions`` may have
    ``features_valid`` (were its predictors within their contract) and ``outcomes`` may have ``utc`` (did its time say
    that it is UTC); a time that is not counts as out of order. Firsts come from aggregates joined back, so no
    id's rows meet in one task.
    """
    p = _flag(predictions, "features_valid").select("event_id", "source_id", "observed_at", "prediction", "features_valid")
    first = p.groupBy("event_id").agg(F.min_by(F.struct("source_id", "observed_at", "prediction", "features_valid"), F.struct("observed_at", "prediction")).alias("__p"))
    joined = _flag(outcomes, "utc").join(first, "event_id", "left").withColumns({c: F.col(f"__p.{c}") for c in ("observed_at", "prediction", "features_valid")})
    rows = written(joined.select("outcome_id", "event_id", "source_id", "occurred_at", "target", "utc", "observed_at", "prediction", "features_valid", F.col("__p.source_id").alias("__source"), F.col("__p").isNull().alias("__unknown"), F.monotonically_increasing_id().alias("__no")), "outcomes")
    least = lambda df, key, *order: df.groupBy(F.col(key).alias("__key")).agg(F.min(F.struct(*order, "__no"))["__no"].alias("__least"))
    ids = rows.join(least(rows, "outcome_id", "occurred_at", "event_id"), F.col("outcome_id").eqNullSafe(F.col("__key"))).withColumn("__again", F.col("__no") != F.col("__least")).drop("__key", "__least")
    reason = first_failure([("duplicate_outcome", F.col("__again")), ("event_not_found", F.col("__unknown")), ("source_mismatch", F.col("__source") != F.col("source_id")), *static_rules(approved)])
    judged = ids.withColumn("reason_code", reason)
    # A second accepted outcome of an event is a duplicate.
    used = least(judged.where("reason_code is null"), "event_id", "occurred_at", "outcome_id")
    final = F.when(F.col("reason_code").isNull() & (F.col("__no") != F.col("__least")), "duplicate_outcome").otherwise(F.col("reason_code"))
    return judged.join(used, F.col("event_id") == F.col("__key"), "left").select("outcome_id", "event_id", "source_id", "occurred_at", "prediction", "target", final.alias("reason_code"))


_OUTCOME = "outcome_id string, event_id string, source_id string, at timestamp, target double, utc boolean, id_ok boolean, again boolean"
_HELD = "event_id array<string>, source_id array<string>, observed_us array<long>, prediction array<double>, features_valid array<boolean>, used array<boolean>, expires_ms array<long>"
#: Digest buckets of ids that share a state; a checkpoint is bound to the number. A call to the state takes up to 40 ms, so they are few.
BUCKETS = 128


def _bucket(key: str | Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _firsts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Outcomes with ``again`` where the same frame has an earlier one of their id, so that a frequent id does not meet in one task."""
    for frame in frames:
        yield frame.assign(again=frame.sort_values(["at", "event_id"], na_position="first")["outcome_id"].duplicated())


class IdRefusal(StatefulProcessor):
    """STR-2: per bucket the outcome ids that have been seen, whatever their event: all but an id's first by time and event are ``again``."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getListState("seen", "ids array<string>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found = pd.concat(list(rows), ignore_index=True)
        told = found["again"].astype(bool)
        open_ = found[~told].sort_values(["at", "event_id"], na_position="first")
        if len(open_):
            seen = {i for (ids,) in self.seen.get() for i in ids}
            ids = open_["outcome_id"].map(_text)
            again = ids.duplicated() | ids.isin(seen)
            if not again.all():
                self.seen.appendValue((ids[~again].tolist(),))
            found = pd.concat([open_.assign(again=again), found[told]])
        yield found[[c.split()[0] for c in _OUTCOME.split(", ")]]

    def close(self) -> None:
        pass


class OutcomeMatcher(StatefulProcessor):
    """STR-3/4: per bucket of event ids each one's prediction and whether an outcome was accepted; the checks and their order are those of :func:`match_outcomes`.

    With a time to live a timer gives up predictions that still wait: each is reported as ``event_expired`` and late
    outcomes are not found. A bucket has a timer for the prediction that expires next.
    """

    def __init__(self, approved: list[str], ttl_ms: int | None, event_time: bool):
        self.approved, self.ttl_ms, self.event_time = approved, ttl_ms, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", _HELD)

    def _read(self) -> dict[str | None, list]:
        """Event id to source, time, prediction, whether its predictors are valid, whether it has an accepted outcome, and when it expires."""
        columns = self.held.get() or ((),) * 7
        return {event: list(rest) for event, *rest in zip(*columns)}

    def _write(self, held: dict[str | None, list]) -> None:
        self.held.update((list(held), *map(list, zip(*held.values())))) if held else self.held.clear()

    def _next(self, held: dict[str | None, list]) -> int | None:
        return min((v[5] for v in held.values()), default=None) if self.ttl_ms is not None else None

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        both = pd.concat(list(rows), ignore_index=True)
        held, out, changed = self._read(), [], False
        soonest = self._next(held)
        for row in both[both["kind"] == "prediction"].sort_values(["at", "prediction"]).drop_duplicates("event_id").itertuples():
            event = _text(row.event_id)
            if event not in held:
                now = _micros(row.at) // 1000 if self.event_time else timerValues.getCurrentProcessingTimeInMs() if self.ttl_ms is not None else 0
                held[event] = [_text(row.source_id), _micros(row.at), float(row.prediction), bool(row.ok), False, now + (self.ttl_ms or 0)]
                changed = True
        ends = self._next(held)
        if ends is not None and (soonest is None or ends < soonest):
            self.handle.registerTimer(ends)
        for row in both[both["kind"] == "outcome"].sort_values(["at", "outcome_id"], na_position="first").itertuples():
            event = _text(row.event_id)
            made = held.get(event)
            reason = self._reason(row, made)
            if reason is None and made[4]:
                reason = "duplicate_outcome"
            elif reason is None:
                made[4] = changed = True
            out.append((_text(row.outcome_id), event, _text(row.source_id), row.at, made[2] if made else None, row.target, reason))
        if changed:
            self._write(held)
        yield pd.DataFrame(out, columns=_COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, out = self._read(), []
        now = timerValues.getCurrentWatermarkInMs() if self.event_time else timerValues.getCurrentProcessingTimeInMs()
        for event in [e for e, v in held.items() if v[5] <= max(expiredTimerInfo.getExpiryTimeInMs(), now)]:
            source, at, prediction, _, used, _ = held.pop(event)
            if not used:
                out.append((None, event, source, pd.Timestamp(at, unit="us"), prediction, None, "event_expired"))
        self._write(held)
        if held:
            self.handle.registerTimer(self._next(held))
        yield pd.DataFrame(out, columns=_COLUMNS)

    def _reason(self, row, held) -> str | None:
        if row.again:
            return "duplicate_outcome"
        if held is None:
            return "event_not_found"
        if _text(row.source_id) is not None and held[0] is not None and held[0] != row.source_id:
            return "source_mismatch"
        if not row.id_ok:
            return "invalid_target"
        if _text(row.source_id) is not None and row.source_id not in self.approved:
            return "source_not_approved"
        if pd.isna(row.at) or not row.ok or _micros(row.at) < held[1]:
            return "outcome_before_prediction"
        if not held[3]:
            return "invalid_predictors"
        return None if 0 < row.target < float("inf") else "invalid_target"

    def close(self) -> None:
        pass


def _micros(at: pd.Timestamp) -> int:
    return pd.Timestamp(at).value // 1000


def _text(value) -> str | None:
    return value if isinstance(value, str) else None


def match_stream(predictions: DataFrame, outcomes: DataFrame, approved: list[str], ttl_ms: int | None = None, late: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """STR-2/3/4, streaming: two stateful operators in one query, by outcome id and then by event id. Needs the RocksDB state store.

    Ids share a state by digest bucket: it is read and written once a batch, not once an id, so a batch costs as much as the rows and the
    state of the buckets that it touches. ``buckets`` should grow with the ids, so that a bucket's stay well under a million.

    The first refuses outcome ids that come again, for whatever event. The results are those of
    :func:`match_outcomes`, where predictions do not come later than their outcomes; within a batch rows are put in order.
    With ``ttl_ms`` predictions expire, each that waited in vain with a row ``event_expired`` that has no outcome. With ``late``
    that is in event time: a timer at the prediction's time and ``ttl_ms``, run down by the watermark, so that it also
    ends under ``availableNow``; ids are then refused within an event only, and rows later than the watermark are dropped by
    Spark. Without ``late`` it is in processing time, and Spark wakes the query up again and again: it must run with
    an interval trigger and be stopped.
    """
    flag = lambda df, name: (F.coalesce(F.col(name), F.lit(False)) if name in df.columns else F.lit(True))
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    p = predictions.select(F.lit("prediction").alias("kind"), "event_id", "source_id", F.col("observed_at").cast("timestamp").alias("at"), F.col("prediction").cast("double").alias("prediction"), none("string", "outcome_id"), none("double", "target"), flag(predictions, "features_valid").alias("ok"), F.lit(True).alias("id_ok"), F.lit(False).alias("again"))
    o = outcomes.select("outcome_id", "event_id", "source_id", F.col("occurred_at").cast("timestamp").alias("at"), F.col("target").cast("double").alias("target"), flag(outcomes, "utc").alias("utc"), F.coalesce(identifier_ok(F.col("outcome_id")), F.lit(False)).alias("id_ok"))
    if late is None:
        o = o.mapInPandas(_firsts, _OUTCOME).withColumn("bucket", F.when(F.col("again"), _bucket("event_id", buckets)).otherwise(_bucket("outcome_id", buckets)))
        o = o.groupBy("bucket").transformWithStateInPandas(IdRefusal(), _OUTCOME, "append", "none")
    else:
        o = o.withColumn("again", F.lit(False))
    o = o.select(F.lit("outcome").alias("kind"), "event_id", "source_id", "at", none("double", "prediction"), "outcome_id", "target", F.col("utc").alias("ok"), "id_ok", "again")
    both = p.unionByName(o)
    both = both.withWatermark("at", late) if late else both
    mode = "none" if ttl_ms is None else "eventTime" if late else "processingTime"
    both = both.withColumn("bucket", _bucket("event_id", buckets))
    return both.groupBy("bucket").transformWithStateInPandas(OutcomeMatcher(approved, ttl_ms, late is not None), RESULT, "append", mode)


def dedupe_stream(events: DataFrame, key: str, at: str, late: str = "1 day") -> DataFrame:
    """STR-2: a stream without repeated ids within the watermark."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def join_outcomes_stream(predictions: DataFrame, outcomes: DataFrame, late: str, within: str) -> DataFrame:
    """JON-12, streaming: predictions with their outcomes of the same source, at most ``within`` after them; without an outcome when the watermark says that none can come any more.

    Both streams have a watermark of ``late``, and the time bound lets Spark drop rows that can match nothing new.
    """
    p = predictions.select("event_id", F.col("source_id").alias("p_source"), F.col("observed_at").cast("timestamp").alias("observed_at"), "prediction").withWatermark("observed_at", late)
    o = outcomes.select("outcome_id", F.col("event_id").alias("o_event"), "source_id", F.col("occurred_at").cast("timestamp").alias("occurred_at"), "target").withWatermark("occurred_at", late)
    near = (F.col("event_id") == F.col("o_event")) & (F.col("source_id") == F.col("p_source")) & (F.col("occurred_at") >= F.col("observed_at")) & (F.col("occurred_at") <= F.col("observed_at") + F.expr(f"INTERVAL {within}"))
    return p.join(o, near, "left_outer").select("outcome_id", "event_id", "observed_at", "occurred_at", "prediction", "target")


def prequential(scored: DataFrame, by: str, at: list[str], y: str = "y", p: str = "p", static: str = "static") -> DataFrame:
    """STR-5: after each outcome the cumulative errors of the candidate and of the static reference, by segment; ``at`` is a total order.

    Running sums go over ranges of time within a segment, so a segment is as many tasks as it needs.
    """
    e, s = F.col(p) - F.col(y), F.col(static) - F.col(y)
    run = running_sums(scored, [by], [F.col(c) for c in at], {"__ae": F.abs(e), "__se": e * e, "__sae": F.abs(s), "__sse": s * s}, "prequential")
    mean = lambda c: F.col(c) / F.col("rank")
    found = run.withColumns({"n": F.col("rank"), "mae": mean("__ae"), "rmse": F.sqrt(mean("__se")), "static_mae": mean("__sae"), "static_rmse": F.sqrt(mean("__sse"))})
    return found.withColumns({"mae_delta": F.col("mae") - F.col("static_mae"), "rmse_delta": F.col("rmse") - F.col("static_rmse")}).drop("rank", "__ae", "__se", "__sae", "__sse")


def rolling_last_n(scored: DataFrame, by: str, at: list[str], n: int = 100, y: str = "y", p: str = "p") -> DataFrame:
    """STR-6: the error over the last ``n`` outcomes of the segment by arrival; ``at`` is a total order.

    Outcomes are numbered and cut into blocks of ``n``; each is also context for the next block, so a window holds two blocks.
    """
    e = F.abs(F.col(p) - F.col(y))
    block = F.floor((F.col("rank") - 1) / n)
    ranked = running_sums(scored, [by], [F.col(c) for c in at], {}, "rolling")
    rows = ranked.withColumn("__own", block).withColumn("__block", F.explode(F.array(block, block + 1)))
    w = Window.partitionBy(by, "__block").orderBy("rank").rowsBetween(-(n - 1), 0)
    found = rows.withColumns({"rolling_n": F.count(F.lit(1)).over(w), "rolling_mae": F.sum(e).over(w) / F.count(F.lit(1)).over(w)})
    return found.where(F.col("__own") == F.col("__block")).drop("__own", "__block", "rank")


def stream_status(matched: DataFrame, predictions: DataFrame) -> DataFrame:
    """STR-9 / PRF-17: predicted, learned, pending, processed (all outcomes that were judged) and quarantined, and quarantined by reason, as ``counter, n``."""
    made = predictions.agg(F.count_distinct("event_id").alias("predicted"))
    learned = matched.agg(F.count_if(F.col("reason_code").isNull()).alias("learned"), F.count_if(F.col("reason_code").isNotNull()).alias("quarantined"))
    one = made.join(F.broadcast(learned))
    pairs = F.array(*[F.struct(F.lit(n).alias("counter"), c.alias("n")) for n, c in (("predicted", F.col("predicted")), ("learned", F.col("learned")), ("pending", F.col("predicted") - F.col("learned")), ("processed", F.col("learned") + F.col("quarantined")), ("quarantined", F.col("quarantined")))])
    reasons = matched.where("reason_code is not null").groupBy(F.concat(F.lit("quarantined:"), "reason_code").alias("counter")).agg(F.count(F.lit(1)).alias("n"))
    return one.select(F.explode(pairs).alias("x")).select("x.*").unionByName(reasons)


def windowed_metrics(matched: DataFrame, at: str, width: str, slide: str | None = None, late: str | None = None, y: str = "y", p: str = "p") -> DataFrame:
    """STR-11: of tumbling or sliding windows the accepted outcomes, their mean error, and the quarantined ones; with ``late`` a watermark for streams.

    ``matched`` may have ``reason_code`` (null: accepted); without it all rows are accepted.
    """
    rows = matched.withWatermark(at, late) if late else matched
    ok = F.col("reason_code").isNull() if "reason_code" in matched.columns else F.lit(True)
    window = F.window(at, width, slide) if slide else F.window(at, width)
    error = F.sum(F.when(ok, F.abs(F.col(p) - F.col(y)))) / F.count_if(ok)
    return rows.groupBy(window).agg(F.count_if(ok).alias("n"), F.when(F.count_if(ok) > 0, error).alias("mae"), F.count_if(~ok).alias("quarantined")).select(F.col("window.start").alias("window_start"), "n", "mae", "quarantined")
