"""Forests and boosted trees grown from sums by cell.

Rows with equal inputs (a cell) fall into the same leaf of every tree. What a split gains, and what a leaf predicts, follows from
the number of a cell's sampled rows and the sum of their targets, so the rows are only read to draw samples and to add up. Where inputs repeat
that makes the trees' work independent of the number of rows. Samples are drawn row by row, as MLlib draws them, but by a digest of the row's key:
they do not depend on partitions. Cut points are MLlib's, taken from all training rows and not from a sample of them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbside.staging import TEXT_BATCH, arrow_batches, written

#: Cells, and features of all cells, that are known to the driver and to every tree at most; with more of them MLlib reads the rows.
MOST_CELLS, MOST_FEATURES = 50_000, 4_000_000
#: Trees of a forest that one task grows, for all folds.
BLOCK = 4
#: Rows that are stored as one, where they are read again and again; Spark's Parquet reader holds 4,096 of those at a time.
PACKED = 1000


class Spec(NamedTuple):
    """What an estimator of MLlib asks for; ``loss`` is none for a forest."""

    trees: int
    depth: int
    least: int
    subset: str
    rate: float
    replace: bool
    seed: int
    bins: int
    gain: float
    loss: str | None = None
    step: float = 1.0


def spec(estimator: object) -> Spec | None:
    """The spec of a forest or of boosted trees; none for other estimators, or if something is set that is not known here."""
    if not isinstance(estimator, (RandomForestRegressor, GBTRegressor)):
        return None
    at = estimator.getOrDefault
    if any(estimator.isSet(p) for p in ("weightCol", "leafCol", "validationIndicatorCol", "thresholds") if estimator.hasParam(p)) or at("minWeightFractionPerNode") > 0:
        return None
    boosted = isinstance(estimator, GBTRegressor)
    common = (at("maxDepth"), at("minInstancesPerNode"), at("featureSubsetStrategy"), at("subsamplingRate"), not boosted and at("bootstrap"), at("seed"), at("maxBins"), at("minInfoGain"))
    return Spec(at("maxIter"), *common, at("lossType"), at("stepSize")) if boosted else Spec(at("numTrees"), *common)


def numbered(known: DataFrame, inputs: list[str]) -> DataFrame | None:
    """The distinct ``inputs`` of ``known`` as ``cell`` from 0, written; none if they are more than ``MOST_CELLS``."""
    cells = written(known.select(*inputs).distinct(), "cells")
    if cells.limit(MOST_CELLS + 1).count() > MOST_CELLS:
        return None
    return written(cells.withColumn("cell", F.row_number().over(Window.orderBy(*inputs)) - 1), "cells")


def same(left: DataFrame, cells: DataFrame, inputs: list[str]) -> DataFrame:
    """``left`` with what ``cells`` has beside the ``inputs``."""
    held = F.broadcast(cells.select(*[F.col(c).alias(f"__{c}") for c in inputs], *[c for c in cells.columns if c not in inputs]))
    return left.join(held, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in inputs]).drop(*[f"__{c}" for c in inputs])


# --- trees ---------------------------------------------------------------------------------------------------------


def cuts(x: np.ndarray, n: np.ndarray, bins: int) -> np.ndarray:
    """Where MLlib cuts a number into ``bins``: between all values if they are few, else after equal numbers of rows."""
    values, at = np.unique(x, return_inverse=True)
    middle = (values[1:] + values[:-1]) / 2
    if len(middle) < bins:
        return middle
    upto = np.cumsum(np.bincount(at, weights=n))
    stride, found = upto[-1] / bins, []
    target = stride
    for k in range(1, len(values)):
        if abs(upto[k - 1] - target) < abs(upto[k] - target):
            found.append(middle[k - 1])
            target += stride
    return np.array(found)


class Binned:
    """Cells as a tree sees them: the bin of every feature, learned where there are training rows."""

    def __init__(self, x: np.ndarray, n: np.ndarray, bins: int):
        seen = n > 0
        edges = [cuts(x[seen, j], n[seen], min(bins, int(n.sum()))) for j in range(x.shape[1])]
        kind = np.uint8 if bins <= 256 else np.int32
        self.bins = np.column_stack([np.searchsorted(e, x[:, j], side="left").astype(kind) for j, e in enumerate(edges)])
        self.wide = [(j, len(e) + 1) for j, e in enumerate(edges) if len(e) > 1]
        self.flags = np.array([j for j, e in enumerate(edges) if len(e) == 1], np.int64)
        self.at, self.flag = np.nonzero(self.bins[:, self.flags])  # most are of categories: few cells have them


def per_node(subset: str, features: int, trees: int) -> int:
    """How many of the ``features`` a node looks at, as MLlib counts them."""
    if subset == "auto":
        subset = "all" if trees == 1 else "onethird"
    named = {"all": features, "onethird": math.ceil(features / 3), "sqrt": math.ceil(math.sqrt(features)), "log2": max(1, math.ceil(math.log2(features)))}
    if subset in named:
        return named[subset]
    return min(int(subset), features) if subset.isdigit() else math.ceil(float(subset) * features)


def _gains(n_left: np.ndarray, s_left: np.ndarray, n: np.ndarray, s: np.ndarray, least: int) -> np.ndarray:
    """How much each split of nodes lowers the sum of squares; minus infinity where a side has fewer than ``least`` rows."""
    n_right, s_right = n - n_left, s - s_left
    found = s_left**2 / np.maximum(n_left, 1) + s_right**2 / np.maximum(n_right, 1) - s**2 / np.maximum(n, 1)
    return np.where((n_left >= least) & (n_right >= least), found, -np.inf)


def grow(cells: Binned, n: np.ndarray, s: np.ndarray, depth: int, least: int, look: int, gain: float, rng: np.random.Generator) -> np.ndarray:
    """What a tree predicts for every cell, grown level by level from the cells' sampled rows ``n`` and the sums ``s`` of their targets; every node looks at ``look`` features."""
    features = cells.bins.shape[1]
    value = np.full(len(n), s.sum() / max(n.sum(), 1))
    live, node, nodes = np.arange(len(n)), np.zeros(len(n), np.int64), 1  # cells that may be split further, and their nodes
    at, flag = cells.at, cells.flag
    where = node.copy()  # as node, for all cells; -1 beyond
    for _ in range(depth):
        weight, total = n[live], s[live]
        sum_n, sum_s = np.bincount(node, weight, nodes), np.bincount(node, total, nodes)
        best, chosen, upto = np.full(nodes, -np.inf), np.zeros(nodes, np.int64), np.zeros(nodes, np.int64)
        seen = rng.random((nodes, features)).argsort(1).argsort(1) < look if look < features else None
        for j, m in cells.wide:
            spot = node * m + cells.bins[live, j]
            lefts = [np.bincount(spot, w, nodes * m).reshape(nodes, m).cumsum(1)[:, :-1] for w in (weight, total)]
            found = _gains(*lefts, sum_n[:, None], sum_s[:, None], least)
            where_best = found.argmax(1)
            top = found[np.arange(nodes), where_best]
            better = top > best if seen is None else (top > best) & seen[:, j]
            best[better], chosen[better], upto[better] = top[better], j, where_best[better]
        if len(cells.flags):
            m = len(cells.flags)
            spot = where[at] * m + flag
            rights = [np.bincount(spot, w[at], nodes * m).reshape(nodes, m) for w in (n, s)]
            found = _gains(*rights, sum_n[:, None], sum_s[:, None], least)
            if seen is not None:
                found[~seen[:, cells.flags]] = -np.inf
            where_best = found.argmax(1)
            top = found[np.arange(nodes), where_best]
            better = top > best
            best[better], chosen[better], upto[better] = top[better], cells.flags[where_best[better]], 0
        split = (best > 1e-12 * sum_s**2 / np.maximum(sum_n, 1)) & (best >= gain * sum_n) & (best > 0)
        if not split.any():
            break
        place = np.cumsum(split) - 1
        where[live[~split[node]]] = -1
        live, node = live[split[node]], node[split[node]]
        node = 2 * place[node] + (cells.bins[live, chosen[node]] > upto[node])
        nodes = 2 * int(split.sum())
        where[live] = node
        kept = where[at] >= 0
        at, flag = at[kept], flag[kept]
        value[live] = (np.bincount(node, s[live], nodes) / np.bincount(node, n[live], nodes))[node]
    return value


# --- samples -------------------------------------------------------------------------------------------------------


def draws(digest: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """A draw of 32 bits for every row, fixed by its digest, the seed and the tree (SplitMix64)."""
    x = digest + np.uint64((seed * 0x9E3779B97F4A7C15 + (tree + 1) * 0xD1B54A32D192ED03) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(32)).astype(np.uint32)


def times(digest: np.ndarray, asked: Spec, tree: int) -> np.ndarray:
    """How often each row is in the sample of a tree: a Poisson number where rows are drawn with replacement, else 0 or 1."""
    if not asked.replace:
        return np.ones(len(digest), np.int32) if asked.rate >= 1 else (draws(digest, asked.seed, tree) < np.uint32(asked.rate * 2**32)).astype(np.int32)
    drawn, out = draws(digest, asked.seed, tree), np.zeros(len(digest), np.int32)
    chance = upto = math.exp(-asked.rate)
    k = 0
    while upto * 2**32 < 2**32 - 0.5:
        out += drawn >= np.uint32(upto * 2**32)
        k += 1
        chance *= asked.rate / k
        upto += chance
    return out


def _by_code(code: np.ndarray, digest: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The codes, where each begins, and digests and targets in their order."""
    if (code[1:] < code[:-1]).any():
        order = code.argsort(kind="stable")
        code, digest, y = code[order], digest[order], y[order]
    starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
    return code[starts], starts, digest, y


def _arrays(batch: pa.RecordBatch) -> list[np.ndarray]:
    """Codes, digests and targets of a batch of rows."""
    if batch.column("y").null_count:
        raise ValueError("a target is null")
    code, digest, y = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("code", "digest", "y"))
    return [code.astype(np.int32), digest.view(np.uint64), y]


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        held = _arrays(batch)
        yield pa.RecordBatch.from_arrays([pa.array([x[k : k + PACKED].tobytes() for k in range(0, len(x), PACKED)], pa.binary()) for x in held], ["code", "digest", "y"])


def _unpack(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(b"".join(batch.column(c).to_pylist()), kind) for c, kind in (("code", np.int32), ("digest", np.uint64), ("y", np.float64))]


def by_code(rows: DataFrame, fold: str, folds: int, key: str, y: str) -> DataFrame:
    """``code`` (cell and fold), ``digest`` (of the key) and ``y`` of rows with their ``cell``, equal codes side by side. Ranges end anywhere, so a cell with many rows has many tasks."""
    found = rows.select((F.col("cell") * folds + F.col(fold)).cast("int").alias("code"), F.xxhash64(key).alias("digest"), F.col(y).cast("double").alias("y"))
    return found.repartitionByRange("code", "digest").sortWithinPartitions("code")


# --- models --------------------------------------------------------------------------------------------------------


def forests(rows: DataFrame, asked: list[Spec], binned: Callable[[int, int], Binned], cells: int, folds: int) -> DataFrame:
    """``cell, __p``: what the forests that were grown without each fold predict for a cell, an array by fold of arrays by forest; ``rows`` as :func:`by_code` gives them.

    Rows are read once, for the samples of all trees; a task then grows ``BLOCK`` trees of one forest for all folds.
    """
    work = [(k, start) for k, a in enumerate(asked) for start in range(0, a.trees, BLOCK)]
    seen = {a.bins: [binned(f, a.bins) for f in range(folds)] for a in asked}

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            codes, starts, digest, y = _by_code(*_arrays(batch))
            out = []
            for k, start in work:
                drawn = [times(digest, asked[k], t) for t in range(start, min(start + BLOCK, asked[k].trees))]
                out.append((np.column_stack([np.add.reduceat(w, starts) for w in drawn]).astype(np.int32).tobytes(), np.column_stack([np.add.reduceat(w * y, starts) for w in drawn]).tobytes()))
            columns = [pa.array(range(len(work)), pa.int32()), pa.array([codes.astype(np.int32).tobytes()] * len(work), pa.binary()), pa.array([n for n, _ in out], pa.binary()), pa.array([s for _, s in out], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["task", "codes", "n", "s"])

    def plant(table: pa.Table) -> pa.Table:
        k, start = work[table.column("task")[0].as_py()]
        a = asked[k]
        trees = min(BLOCK, a.trees - start)
        n, s = np.zeros((cells * folds, trees)), np.zeros((cells * folds, trees))
        for codes, some_n, some_s in zip(*(table.column(c) for c in ("codes", "n", "s"))):
            at = np.frombuffer(codes.as_buffer(), np.int32)
            n[at] += np.frombuffer(some_n.as_buffer(), np.int32).reshape(-1, trees)
            s[at] += np.frombuffer(some_s.as_buffer(), np.float64).reshape(-1, trees)
        n, s = n.reshape(cells, folds, trees), s.reshape(cells, folds, trees)
        out = np.zeros((cells, folds))
        for f in range(folds):
            others = [g for g in range(folds) if g != f]
            view = seen[a.bins][f]
            look = per_node(a.subset, view.bins.shape[1], a.trees)
            for t in range(trees):
                rng = np.random.default_rng([a.seed % 2**63, start + t, f])
                out[:, f] += grow(view, n[:, others, t].sum(1), s[:, others, t].sum(1), a.depth, a.least, look, a.gain, rng)
        return pa.table({"forest": pa.array(np.full(cells, k, np.int32)), "cell": pa.array(np.arange(cells, dtype=np.int32)), "p": pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), folds).cast(pa.list_(pa.float64()))})

    sampled = rows.mapInArrow(sample, "task int, codes binary, n binary, s binary")
    # As many partitions as tasks of trees: few bytes each, but seconds of work.
    planted = sampled.repartition(len(work), "task").groupBy("task").applyInArrow(plant, "forest int, cell int, p array<double>")
    of = lambda k, f: F.sum(F.when(F.col("forest") == k, F.get("p", F.lit(f)))) / asked[k].trees
    return written(planted.groupBy("cell").agg(F.array(*[F.array(*[of(k, f) for k in range(len(asked))]) for f in range(folds)]).alias("__p")), "forests")


def boosted(rows: DataFrame, asked: list[Spec], binned: Callable[[int, int], Binned], cells: int, folds: int) -> DataFrame:
    """As :func:`forests`, for boosted trees: ``rows`` are written, ``PACKED`` of them as one, and read once a round for all models and folds.

    The first tree is fitted to the targets, each further one to what the loss pulls at (squared: twice the error; absolute: its sign), as in
    MLlib. For squared loss that follows from number and sum; for absolute loss rows below the prediction of their cell are counted. The
    driver holds a sum for each cell, fold and model, and grows the small trees.
    """
    if any(a.loss not in ("squared", "absolute") for a in asked):
        raise ValueError("the loss is squared or absolute")
    seen = {a.bins: [binned(f, a.bins) for f in range(folds)] for a in asked}
    made = np.zeros((len(asked), folds, cells))
    spark = rows.sparkSession
    packed = written(rows.mapInArrow(_pack, "code binary, digest binary, y binary"), "packed")
    for turn in range(max(a.trees for a in asked)):
        going = [k for k, a in enumerate(asked) if turn < a.trees]
        #: A column of sums for each model, or for each model and fold where rows below its prediction are counted.
        columns = [(k, f) for k in going for f in (range(folds) if turn and asked[k].loss == "absolute" else [None])]
        held = made[going] if turn else None

        def add(batches: Iterator[pa.RecordBatch], turn=turn, going=going, columns=columns, held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                codes, starts, digest, y = _by_code(*_unpack(batch))
                drawn = {k: times(digest, asked[k], turn) for k in going}
                n = np.column_stack([np.add.reduceat(drawn[k], starts) for k in going]).astype(np.int32)
                long = np.diff(np.r_[starts, len(y)])
                below = lambda k, f: y < np.repeat(held[going.index(k), f, codes // folds], long)
                s = np.column_stack([np.add.reduceat(drawn[k] * (y if f is None else below(k, f)), starts) for k, f in columns]).astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (codes.astype(np.int32), n, s)], ["codes", "n", "s"])

        n, s = np.zeros((cells * folds, len(going))), np.zeros((cells * folds, len(columns)))
        with arrow_batches(spark, TEXT_BATCH):
            sums = packed.mapInArrow(add, "codes binary, n binary, s binary").toArrow()
        for some in sums.to_batches():
            for codes, some_n, some_s in zip(*some.columns):
                at = np.frombuffer(codes.as_buffer(), np.int32)
                n[at] += np.frombuffer(some_n.as_buffer(), np.int32).reshape(-1, len(going))
                s[at] += np.frombuffer(some_s.as_buffer(), np.float64).reshape(-1, len(columns))
        n, s = n.reshape(cells, folds, -1), s.reshape(cells, folds, -1)
        for i, k in enumerate(going):
            a = asked[k]
            for f in range(folds):
                others = [g for g in range(folds) if g != f]
                count = n[:, others, i].sum(1)
                total = s[:, others, columns.index((k, f) if (k, f) in columns else (k, None))].sum(1)
                if turn:
                    total = 2 * (total - count * made[k, f]) if a.loss == "squared" else count - 2 * total
                view = seen[a.bins][f]
                look = per_node(a.subset, view.bins.shape[1], 1)
                tree = grow(view, count, total, a.depth, a.least, look, a.gain, np.random.default_rng([a.seed % 2**63, turn, f]))
                made[k, f] += tree * (a.step if turn else 1.0)
    table = pa.table({"cell": pa.array(np.arange(cells, dtype=np.int32)), "__p": pa.array(made.transpose(2, 1, 0).tolist(), pa.list_(pa.list_(pa.float64())))})
    return written(spark.createDataFrame(table), "boosted")


def scored(rows: DataFrame, names: list[str], fold: str, keep: list[str], out: str) -> DataFrame:
    """``candidate, keep..., out``: ``rows`` with their cell's predictions ``__p``, once for each of ``names``, by the model that was made without their fold."""
    p: Callable[[int], Column] = lambda k: F.get(F.get("__p", F.col(fold)), F.lit(k)).alias(out)
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("candidate"), p(k)) for k, name in enumerate(names)])).alias("__e")
    return rows.select(*keep, each).select("__e.candidate", *keep, f"__e.{out}")
