"""Sequential learners and drift detectors, one small state for each segment.

They scale by key. Within a key order is what defines the result, so a key's rows are folded one after the
other; nothing but the state is held. The batch forms fold what Spark streams to a worker; the streaming forms
keep the same state between batches and over restarts.
"""

from __future__ import annotations

import heapq
import itertools
import math
import tempfile
from collections import deque
from collections.abc import Callable, Iterator
from operator import itemgetter

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


class Adwin:
    """Adaptive windowing (Bifet and Gavalda, 2007): an exponential histogram of the recent past; a cut where two parts' means differ."""

    def __init__(self, delta: float = 0.002, per_row: int = 5, every: int = 32):
        self.delta, self.per_row, self.every = delta, per_row, every
        self.rows: list[deque] = [deque()]  # of (sum, sum of squared deviations) of 2**k values each
        self.n, self.total, self.seen = 0, 0.0, 0

    def add(self, x: float) -> bool:
        """Take a value; whether drift was found (and the past before it dropped)."""
        self.rows[0].appendleft((x, 0.0))
        self.n, self.total, self.seen = self.n + 1, self.total + x, self.seen + 1
        for k, row in enumerate(self.rows):
            if len(row) <= self.per_row:
                break
            if k + 1 == len(self.rows):
                self.rows.append(deque())
            (s1, v1), (s2, v2) = row.pop(), row.pop()
            size = 1 << k
            self.rows[k + 1].appendleft((s1 + s2, v1 + v2 + (s1 - s2) ** 2 / (2 * size)))
        return self.seen % self.every == 0 and self.n > 10 and self._cut()

    def _cut(self) -> bool:
        found = False
        while self._drop_oldest_if_different():
            found = True
        return found

    def _drop_oldest_if_different(self) -> bool:
        mean = self.total / self.n
        variance = sum(v + (1 << k) * (s / (1 << k) - mean) ** 2 for k, row in enumerate(self.rows) for s, v in row) / self.n
        log = math.log(2 * math.log(max(self.n, 3)) / self.delta)
        n0, s0 = 0, 0.0
        for k in range(len(self.rows) - 1, -1, -1):
            for s, _ in reversed(self.rows[k]):
                n0, s0 = n0 + (1 << k), s0 + s
                n1 = self.n - n0
                if n0 < 5 or n1 < 5:
                    continue
                m = 1 / (1 / (n0 - 4) + 1 / (n1 - 4))
                if abs(s0 / n0 - (self.total - s0) / n1) > math.sqrt(2 / m * variance * log) + 2 / (3 * m) * log:
                    last = len(self.rows) - 1
                    gone = self.rows[last].pop()
                    self.n, self.total = self.n - (1 << last), self.total - gone[0]
                    if not self.rows[last] and last:
                        self.rows.pop()
                    return True
        return False


class OnlineLinear:
    """Least squares by gradient steps on standardised numbers and one-hot categories; predicts before it learns."""

    def __init__(self, rate: float = 0.01):
        self.rate, self.bias, self.weights = rate, 0.0, {}
        self.moments: dict[str, list[float]] = {}

    def _features(self, numbers: dict[str, float], categories: dict[str, str]) -> dict[str, float]:
        out = {f"{k}={v}": 1.0 for k, v in categories.items()}
        for k, x in numbers.items():
            n, mean, square = self.moments.get(k, (0, 0.0, 0.0))
            dev = math.sqrt(square / n) if n else 0.0
            out[k] = (x - mean) / dev if dev > 0 else 0.0
        return out

    def predict(self, numbers: dict[str, float], categories: dict[str, str]) -> float:
        return self.bias + sum(self.weights.get(k, 0.0) * v for k, v in self._features(numbers, categories).items())

    def learn(self, numbers: dict[str, float], categories: dict[str, str], y: float) -> None:
        for k, x in numbers.items():
            n, mean, square = self.moments.get(k, (0, 0.0, 0.0))
            n, step = n + 1, x - mean
            mean += step / n
            self.moments[k] = [n, mean, square + step * (x - mean)]
        features = self._features(numbers, categories)
        error = self.bias + sum(self.weights.get(k, 0.0) * v for k, v in features.items()) - y
        error = max(-1e6, min(1e6, error))
        self.bias -= self.rate * error
        for k, v in features.items():
            self.weights[k] = self.weights.get(k, 0.0) - self.rate * error * v


def _relative_errors(df: DataFrame, key: str, at: list[str], y: str, p: str) -> DataFrame:
    error = F.abs(F.col(p) - F.col(y)) / F.greatest(F.col(y), F.lit(1.0))
    return df.select(F.col(key).cast("string").alias("key"), *at, error.cast("double").alias("error")).where("error is not null")


def _examples(df: DataFrame, key: str, at: list[str], numbers: list[str], categories: list[str], y: str, scale: float) -> DataFrame:
    return df.select(F.col(key).cast("string").alias("key"), *at, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"n_{c}") for c in numbers], *[F.coalesce(F.col(c).cast("string"), F.lit("__missing__")).alias(f"c_{c}") for c in categories], (F.col(y).cast("double") / scale).alias("target")).where("target is not null")


def _fold(rows: DataFrame, at: list[str], start: Callable[[], object], step: Callable[[object, dict], None], result: Callable[[object], dict], schema: str) -> DataFrame:
    """One state for each ``key`` (null is a key), folded over its rows in order; ``schema`` begins with the key."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, name = None, None
        for frame in frames:
            for row in _records(frame):
                key = row["key"] if isinstance(row["key"], str) else None
                if state is None or key != name:
                    if state is not None:
                        yield pd.DataFrame([{"key": name, **result(state)}])
                    state, name = start(), key
                step(state, row)
        if state is not None:
            yield pd.DataFrame([{"key": name, **result(state)}])

    return rows.repartition("key").sortWithinPartitions("key", *at).mapInPandas(run, schema)


class Drift:
    """What STR-7 keeps for a segment."""

    def __init__(self, delta: float):
        self.adwin, self.n, self.detections = Adwin(delta), 0, 0

    def step(self, row: dict) -> None:
        self.n += 1
        self.detections += self.adwin.add(float(row["error"]))

    def result(self) -> dict:
        return {"n": self.n, "detections": self.detections}


class Learning:
    """What STR-8 keeps for a segment."""

    def __init__(self, numbers: list[str], categories: list[str], scale: float):
        self.model, self.numbers, self.categories, self.scale, self.n, self.total = OnlineLinear(), numbers, categories, scale, 0, 0.0

    def step(self, row: dict) -> None:
        x, c = {k: row[f"n_{k}"] for k in self.numbers}, {k: row[f"c_{k}"] for k in self.categories}
        self.n, self.total = self.n + 1, self.total + abs(self.model.predict(x, c) - row["target"])
        self.model.learn(x, c, row["target"])

    def result(self) -> dict:
        return {"n": self.n, "mae": self.scale * self.total / self.n}


DRIFT, LEARNED = "key string, n long, detections long", "key string, n long, mae double"


def adwin_by_key(df: DataFrame, key: str, at: list[str], y: str = "y", p: str = "p", delta: float = 0.002) -> DataFrame:
    """STR-7, batch: ``key, n, detections``: drift of the relative error |p - y| / max(y, 1) in each segment's order; rows without one do not count, a null segment is a segment."""
    return _fold(_relative_errors(df, key, at, y, p), at, lambda: Drift(delta), Drift.step, Drift.result, DRIFT)


def online_linear_by_key(df: DataFrame, key: str, at: list[str], numbers: list[str], categories: list[str], y: str, scale: float = 1.0) -> DataFrame:
    """STR-8, batch: ``key, n, mae``: each segment's own model, tested on every row before it learns it; null numbers count 0, rows without ``y`` do not count, a null segment is a segment."""
    return _fold(_examples(df, key, at, numbers, categories, y, scale), at, lambda: Learning(numbers, categories, scale), Learning.step, Learning.result, LEARNED)


#: Rows of a segment's batch that are put in order in memory. More of them are sorted in runs of so many in a file of the worker's own, and ``HEAD`` rows of each are held as they are merged.
RUN, HEAD = 100_000, 1_000
#: Rows of a batch that are Python records at one time.
RECORDS = 10_000


def _runs(frames: Iterator[pd.DataFrame], at: list[str]) -> Iterator[pd.DataFrame]:
    """``frames`` as sorted ones of about ``RUN`` rows."""
    held, n = [], 0
    for frame in frames:
        held.append(frame)
        n += len(frame)
        if n >= RUN:
            yield pd.concat(held, ignore_index=True).sort_values(at, ignore_index=True)
            held, n = [], 0
    if held:
        yield pd.concat(held, ignore_index=True).sort_values(at, ignore_index=True)


def _records(frame: pd.DataFrame) -> Iterator[dict]:
    names = list(frame.columns)
    return (dict(zip(names, row)) for row in zip(*[frame[c].tolist() for c in names]))


def _keys(frame: pd.DataFrame, at: list[str]) -> list[tuple]:
    """What orders each row; what is missing comes last, as in ``sort_values``."""
    parts = []
    for c in at:
        gone = frame[c].isna().tolist()
        parts += [gone, [0 if none else x for none, x in zip(gone, frame[c].tolist())]]
    return list(zip(*parts))


def _in_order(frames: Iterator[pd.DataFrame], at: list[str]) -> Iterator[dict]:
    """The rows of ``frames`` in the order of ``at``, with a bounded number of them in memory."""
    runs = _runs(frames, at)
    first, second = next(runs, None), next(runs, None)
    if second is None:
        for start in range(0, 0 if first is None else len(first), RECORDS):
            yield from _records(first.iloc[start : start + RECORDS])
        return
    with tempfile.TemporaryFile() as file:  # has no name, so nothing is left of it
        places = []
        for run in itertools.chain((first, second), runs):
            first = second = None
            places.append([])
            for start in range(0, len(run), HEAD):
                places[-1].append(file.tell())
                table = pa.Table.from_pandas(run.iloc[start : start + HEAD], preserve_index=False)
                with pa.ipc.new_stream(file, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_table(table)
        run = None

        def read(places: list[int]) -> Iterator[tuple[tuple, dict]]:
            for place in places:
                file.seek(place)
                frame = pa.ipc.open_stream(file).read_all().to_pandas()
                yield from zip(_keys(frame, at), _records(frame))

        for _, row in heapq.merge(*map(read, places), key=itemgetter(0)):
            yield row


class _Segment(StatefulProcessor):
    """Rows of a batch in order into the segment's state, which is read and written once a batch; the result so far goes out. A batch is sorted in bounded memory."""

    def __init__(self, at: list[str]):
        self.at = at

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = self.read()
        for row in _in_order((frame.drop(columns="key", errors="ignore") for frame in rows), self.at):
            state.step(row)
        self.write(state)
        yield pd.DataFrame([{"key": key[0], **state.result()}])

    def close(self) -> None:
        pass


class DriftProcessor(_Segment):
    """STR-7: the exponential histogram as a list (a row for each bucket), counters as one value."""

    def __init__(self, at: list[str], delta: float):
        super().__init__(at)
        self.delta = delta

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.buckets = handle.getListState("buckets", "level int, total double, deviations double")
        self.counters = handle.getValueState("counters", "n long, detections long, held long, total double, seen long, levels int")

    def read(self) -> Drift:
        state = Drift(self.delta)
        if self.counters.exists():
            state.n, state.detections, state.adwin.n, state.adwin.total, state.adwin.seen, levels = self.counters.get()
            state.adwin.rows = [deque() for _ in range(levels)]
            for level, total, deviations in self.buckets.get():
                state.adwin.rows[level].append((total, deviations))
        return state

    def write(self, state: Drift) -> None:
        held = state.adwin
        self.buckets.put([(k, s, v) for k, row in enumerate(held.rows) for s, v in row])
        self.counters.update((state.n, state.detections, held.n, held.total, held.seen, len(held.rows)))


class LearningProcessor(_Segment):
    """STR-8: weights and moments as maps by feature, the rest as one value; a row is predicted before it is learned."""

    def __init__(self, at: list[str], numbers: list[str], categories: list[str], scale: float):
        super().__init__(at)
        self.numbers, self.categories, self.scale = numbers, categories, scale

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.weights = handle.getMapState("weights", "feature string", "weight double")
        self.moments = handle.getMapState("moments", "feature string", "n long, mean double, square double")
        self.counters = handle.getValueState("counters", "n long, total double, bias double")

    def read(self) -> Learning:
        state = Learning(self.numbers, self.categories, self.scale)
        if self.counters.exists():
            state.n, state.total, state.model.bias = self.counters.get()
            state.model.weights = {k[0]: v[0] for k, v in self.weights.iterator()}
            state.model.moments = {k[0]: list(v) for k, v in self.moments.iterator()}
        return state

    def write(self, state: Learning) -> None:
        for k, v in state.model.weights.items():
            self.weights.updateValue((k,), (v,))
        for k, v in state.model.moments.items():
            self.moments.updateValue((k,), tuple(v))
        self.counters.update((state.n, state.total, state.model.bias))


def adwin_stream(stream: DataFrame, key: str, at: list[str], y: str = "y", p: str = "p", delta: float = 0.002) -> DataFrame:
    """STR-7, streaming: after every batch ``key, n, detections`` so far of the segments that had rows. Rows are put in order within a batch; later batches are later."""
    return _relative_errors(stream, key, at, y, p).groupBy("key").transformWithStateInPandas(DriftProcessor(at, delta), DRIFT, "append", "none")


def online_linear_stream(stream: DataFrame, key: str, at: list[str], numbers: list[str], categories: list[str], y: str, scale: float = 1.0) -> DataFrame:
    """STR-8, streaming: after every batch ``key, n, mae`` so far of the segments that had rows."""
    return _examples(stream, key, at, numbers, categories, y, scale).groupBy("key").transformWithStateInPandas(LearningProcessor(at, numbers, categories, scale), LEARNED, "append", "none")


def latest(results: DataFrame) -> DataFrame:
    """Of what a stream has put out the last row of each segment."""
    last = results.groupBy("key").agg(F.max_by(F.struct(*[c for c in results.columns if c != "key"]), "n").alias("x"))
    return last.select("key", "x.*")
