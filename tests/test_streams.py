"""Streams with a stop between two runs against their batch forms."""

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kerbside.plans import registry
from kerbside.plans.learning import in_runs, in_two_runs
from kerbside.staging import fresh_dir
from kerbside.streaming import keyed, outcomes
from kerbside.streaming.runs import STATE_PARTITIONS, rocksdb, run_available

SF = "/root/testdata/sf0.001"
START = dt.datetime(2024, 1, 1)


def jumpy(spark):
    rng = random.Random(7)
    rows = [(rng.choice(["a", "b", None]), START + dt.timedelta(minutes=i), float(rng.randint(1, 90)), float(rng.randint(1, 90)) + 400 * (i > 800), "c" * rng.randint(1, 3)) for i in range(1500)]
    rows.append(("a", START, None, 1.0, "c"))
    return spark.createDataFrame(rows, "k string, at timestamp, y double, p double, c string").repartition(3)


def test_drift_and_learners_go_on_after_a_stop(spark):
    df = jumpy(spark)
    batch = sorted(map(tuple, keyed.adwin_by_key(df, "k", ["at"]).collect()), key=str)
    assert len(batch) == 3 and sum(r[1] for r in batch) == 1500 and sum(r[2] for r in batch) > 0
    drift = in_two_runs(spark, df, "at", lambda s: keyed.adwin_stream(s, "k", ["at"]), keyed.DRIFT, "drift-test")
    assert drift.count() == 6 and sorted(map(tuple, keyed.latest(drift).collect()), key=str) == batch
    args = ("k", ["at"], ["p"], ["c"], "y", 10.0)
    learned = in_two_runs(spark, df, "at", lambda s: keyed.online_linear_stream(s, *args), keyed.LEARNED, "learn-test")
    assert sorted(map(tuple, keyed.latest(learned).collect()), key=str) == sorted(map(tuple, keyed.online_linear_by_key(df, *args).collect()), key=str)


@pytest.mark.parametrize("name,batch", [("str_8_online_stream", "str_8_online_linear_by_segment")])
def test_stream_queries_equal_batch_queries(spark, name, batch):
    found, want = (sorted(map(tuple, registry.queries()[n](spark, SF).collect()), key=str) for n in (name, batch))
    assert found == want and found


def test_ids_are_refused_across_events_and_runs(spark):
    day = lambda d, h=0: START + dt.timedelta(days=d, hours=h)
    made = [("e1", "view", day(0), 5.0, True), ("e2", "view", day(0), 6.0, True), ("e3", "view", day(0), 7.0, False), ("e4", "click", day(0), 7.0, True), ("e5", "view", day(0, 9), 8.0, True), ("e1", "view", day(0, 1), 50.0, False)]
    seen = [
        ("o1", "e1", "view", day(1), 3.0, True), ("o1", "e2", "view", day(1, 1), 3.0, True), ("o2", "e9", "view", day(1), 3.0, True), ("o3", "e4", "view", day(1), 3.0, True), ("o4", "e4", "click", day(1), 3.0, True),
        ("o1", "e5", "view", day(20), 3.0, True), ("o5", "e1", "view", day(20), 4.0, True), ("o6", "e3", "view", day(20), 4.0, True), ("o7", "e5", "view", day(0, 3), 4.0, True), ("bad id", "e2", "view", day(20), 4.0, True),
        ("o8", "e2", "view", day(20), 4.0, False), ("o9", "e2", "view", day(20), float("inf"), True), ("o10", "e2", "view", day(21), 4.0, True), ("o11", "e2", "view", day(22), 4.0, True), (None, "e5", "view", day(22), 4.0, True),
    ]
    p = spark.createDataFrame(made, "event_id string, source_id string, observed_at timestamp, prediction double, features_valid boolean")
    o = spark.createDataFrame(seen, "outcome_id string, event_id string, source_id string, occurred_at timestamp, target double, utc boolean")
    key = lambda df: Counter((r.outcome_id, r.event_id, r.source_id, r.occurred_at, r.prediction, r.reason_code) for r in df.collect())
    batch = key(outcomes.match_outcomes(p, o, ["view"]))
    stream = in_runs(spark, "refused", {"p": (p, "observed_at"), "o": (o, "occurred_at")}, lambda s: outcomes.match_stream(s["p"], s["o"], ["view"]), outcomes.RESULT, 2)
    assert key(stream) == batch
    reasons = Counter(k[-1] for k in batch.elements())
    assert set(reasons) == {None, "duplicate_outcome", "event_not_found", "source_mismatch", "source_not_approved", "invalid_predictors", "outcome_before_prediction", "invalid_target"}


def test_interval_join_drops_state(spark):
    """Two runs: after the watermark has passed the first day its rows are no longer held."""
    base, held = fresh_dir(spark, "interval-test"), []
    p = "event_id string, source_id string, observed_at timestamp, prediction double"
    o = "outcome_id string, event_id string, source_id string, occurred_at timestamp, target double"
    for day, n in ((0, 200), (10, 20), (20, 1)):
        at = START + dt.timedelta(days=day)
        spark.createDataFrame([(f"e{day}-{k}", "view", at, 1.0) for k in range(n)], p).coalesce(1).write.mode("append").parquet(f"{base}/p")
        spark.createDataFrame([(f"o{day}-{k}", f"e{day}-{k}", "view", at + dt.timedelta(hours=1 if k else 30), 2.0) for k in range(n)], o).coalesce(1).write.mode("append").parquet(f"{base}/o")
        with rocksdb(spark):
            joined = outcomes.join_outcomes_stream(spark.readStream.schema(p).parquet(f"{base}/p"), spark.readStream.schema(o).parquet(f"{base}/o"), "1 hour", "12 HOURS")
            query = joined.writeStream.outputMode("append").option("checkpointLocation", f"{base}/c").trigger(availableNow=True).format("parquet").start(f"{base}/out")
            query.awaitTermination()
            held.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    assert held[0] >= 200 and held[1] <= 60 and held[2] < 20
    found = Counter(r.outcome_id is None for r in spark.read.schema("outcome_id string, event_id string").parquet(f"{base}/out").where("event_id like 'e0-%' or event_id like 'e10-%'").select("outcome_id").collect())
    assert found == {False: 218, True: 2}


def test_a_batch_is_made_into_records_in_parts():
    import tracemalloc

    import pandas as pd

    class Sums(keyed._Segment):
        def init(self, handle):
            pass

        def read(self):
            self.seen = []
            return self

        def step(self, row):
            self.seen.append(row["at"]) if len(self.seen) < 3 else None

        def write(self, state):
            pass

        def result(self):
            return {"n": 0}

    frame = pd.DataFrame({"at": range(200_000, 0, -1), "x": 1.5, "y": 2.5})
    held = frame.memory_usage(index=False).sum()
    sums = Sums(["at"])
    tracemalloc.start()
    list(sums.handleInputRows(("k",), iter([frame]), None))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sums.seen == [1, 2, 3] and peak < 8 * held


class Calls:
    """A handle whose states live in memory and count how often they are called."""

    def __init__(self):
        self.n, self.value, self.chunks, self.timers = 0, None, [], []

    def getValueState(self, name, schema):
        return self

    getListState = getValueState

    def registerTimer(self, ms):
        self.timers.append(ms)

    def exists(self):
        self.n += 1
        return self.value is not None

    def get(self):
        self.n += 1
        return self.value if not self.chunks else iter(self.chunks)

    def update(self, value):
        self.n, self.value = self.n + 1, value

    def clear(self):
        self.n, self.value = self.n + 1, None

    def appendValue(self, value):
        self.n += 1
        self.chunks.append(value)


def test_many_ids_reach_the_state_once():
    """a call to the state costs up to 40 ms, so its number must not grow with the ids."""
    import pandas as pd

    ids, at = [f"e{k}" for k in range(1000)], pd.Timestamp("2024-01-01")
    both = pd.DataFrame({"kind": ["prediction"] * 1000 + ["outcome"] * 1000, "event_id": ids * 2, "source_id": "view", "at": [at] * 1000 + [at + pd.Timedelta(hours=1)] * 1000, "prediction": 5.0, "outcome_id": [None] * 1000 + [f"o{k}" for k in range(1000)], "target": 6.0, "ok": True, "id_ok": True, "again": False})
    calls, matcher = Calls(), outcomes.OutcomeMatcher(["view"], None, False)
    matcher.init(calls)
    (out,) = matcher.handleInputRows((7,), iter([both]), None)
    assert calls.n <= 3 and sorted(out["event_id"]) == sorted(ids) and out["reason_code"].isna().all() and (out["prediction"] == 5).all()
    (out,) = matcher.handleInputRows((7,), iter([both]), None)
    assert calls.n <= 6 and set(out["reason_code"]) == {"duplicate_outcome"}
    calls, refusal = Calls(), outcomes.IdRefusal()
    calls.value = []
    refusal.init(calls)
    seen = pd.DataFrame({"outcome_id": ids + ids[:1], "event_id": "e", "source_id": "view", "at": [at] * 1000 + [at - pd.Timedelta(hours=1)], "target": 1.0, "utc": True, "id_ok": True, "again": False})
    (out,) = refusal.handleInputRows((7,), iter([seen]), None)
    assert calls.n <= 3 and out[out["again"]][["outcome_id", "at"]].values.tolist() == [["e0", at]]
    (out,) = refusal.handleInputRows((7,), iter([seen.head(5)]), None)
    assert calls.n <= 6 and out["again"].all()


def test_a_bucket_expires_when_spark_says(spark):
    """of predictions that share a bucket and a timer those end whose time the watermark has reached, also exactly."""
    day = lambda d: START + dt.timedelta(days=d)
    made = [(f"e{k}", "view", day(k), 5.0) for k in range(6)] + [("end", "view", day(9), 5.0)]
    seen = [("o1", "e1", "view", day(2), 3.0), ("o2", "e9", "view", day(2), 3.0), ("o3", "e3", "view", day(12), 3.0), ("o4", "e5", "view", day(12), 3.0), ("o5", "end", "view", day(12), 3.0), ("o6", "e4", "view", day(12), 3.0)]
    p = spark.createDataFrame(made, "event_id string, source_id string, observed_at timestamp, prediction double")
    o = spark.createDataFrame(seen, "outcome_id string, event_id string, source_id string, occurred_at timestamp, target double")
    for buckets in (1, 64):
        found = in_runs(spark, "expires", {"p": (p, "observed_at"), "o": (o, "occurred_at")}, lambda s: outcomes.match_stream(s["p"], s["o"], ["view"], 5 * 86_400_000, "0 seconds", buckets), outcomes.RESULT, 3)  # noqa: B023
        got = sorted((r.event_id, r.outcome_id or "", r.reason_code or "") for r in found.collect())
        assert got == [
            ("e0", "", "event_expired"), ("e1", "o1", ""), ("e2", "", "event_expired"), ("e3", "", "event_expired"), ("e3", "o3", "event_not_found"), ("e4", "", "event_expired"), ("e4", "o6", "event_not_found"),
            ("e5", "o4", ""), ("e9", "o2", "event_not_found"), ("end", "o5", ""),
        ]


def test_a_state_has_no_more_partitions_than_cores(spark):
    """opening and committing a state partition costs the same however little it holds, so their number must not follow the session's."""
    base, name = fresh_dir(spark, "partitions-test"), "spark.sql.shuffle.partitions"
    spark.range(300).select(F.concat(F.lit("e"), F.col("id") % 100).alias("event_id"), F.lit(START).alias("observed_at")).write.parquet(f"{base}/in")
    before = spark.conf.get(name)
    spark.conf.set(name, "64")
    try:
        run_available(lambda s: outcomes.dedupe_stream(s, "event_id", "observed_at"), spark.readStream.schema("event_id string, observed_at timestamp").parquet(f"{base}/in"), f"{base}/out", f"{base}/c")
        assert spark.conf.get(name) == "64"
    finally:
        spark.conf.set(name, before)
    assert spark.read.parquet(f"{base}/out").count() == 100
    logged = "".join(r.value for r in spark.read.text(f"{base}/c/offsets/0").collect())
    assert f'"{name}":"{max(STATE_PARTITIONS, spark.sparkContext.defaultParallelism)}"' in logged


def test_the_middle_of_the_events_is_found_once(spark, monkeypatch):
    from kerbside.plans import learning

    base, calls, found = fresh_dir(spark, "halves-test"), [], learning.quantiles
    monkeypatch.setattr(learning, "quantiles", lambda *a, **b: calls.append(1) or found(*a, **b))
    counts = [spark.read.parquet(f"{base}/in").agg(F.count("ts"), F.max("ts")).first() for _ in learning.half_files(spark, SF, f"{base}/in")]
    events = spark.read.parquet(f"{SF}/events.parquet")
    assert calls == [1] and counts[0][0] == events.count() // 2 and counts[1][0] == events.count()
    assert events.where(F.col("ts") <= F.lit(counts[0][1])).count() == counts[0][0]


def test_a_segments_batch_is_sorted_in_bounded_memory(monkeypatch):
    import random
    import weakref

    import pandas as pd

    monkeypatch.setattr(keyed, "RUN", 100, raising=False)
    monkeypatch.setattr(keyed, "HEAD", 7, raising=False)
    draw, alive, most = random.Random(5), weakref.WeakSet(), [0]
    day = lambda k: dt.date(2024, 1, 1) + dt.timedelta(k) if k < 30 else None
    table = [{"key": "a", "at": day(draw.randrange(31)), "id": draw.choice(["x", "y", None]), "n": k, "v": draw.random()} for k in range(2_000)]

    class Listed:
        def __init__(self):
            self.rows = []

        def step(self, row):
            self.rows.append(row)

        def result(self):
            return {"n": len(self.rows)}

    class Order(keyed._Segment):
        def init(self, handle):
            pass

        def read(self):
            self.state = Listed()
            return self.state

        def write(self, state):
            pass

    class Frame(pd.DataFrame):
        pass

    def frames(rows):
        for start in range(0, len(rows), 20):
            frame = Frame(rows[start : start + 20])
            alive.add(frame)
            most[0] = max(most[0], sum(1 for _ in alive))
            yield frame
            del frame

    monkeypatch.setattr(Frame, "__hash__", object.__hash__, raising=False)
    for rows in (table, table[:90], table[:100], table[:120]):
        order = Order(["at", "id", "n"])
        (out,) = order.handleInputRows(("a",), frames(rows), None)
        want = pd.DataFrame(rows).sort_values(["at", "id", "n"], ignore_index=True)
        assert [r["n"] for r in order.state.rows] == want.n.tolist() and [r["v"] for r in order.state.rows] == want.v.tolist()
        assert out.to_dict("records") == [{"key": "a", "n": len(rows)}]
    assert most[0] <= 8  # of 100
