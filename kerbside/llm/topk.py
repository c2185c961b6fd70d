"""Exact top-k search by exhaustive term-at-a-time accumulation.

A vector is a sparse row: its non-zero components are terms with weights. Queries and candidates are cut
into blocks of bounded size, and each pair of a query block with a candidate block is one group of a
shuffle. There the candidates are inverted into postings (term to rows and weights), every term of every
query scatters its weighted postings into that query's dense score array, and a partition selection keeps
the best k. The kept rows of all blocks are merged by rank.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbside.staging import written

#: Vectors in a block of candidates and of queries.
CANDIDATES, QUERIES = 4096, 1024


def integer_components(vector: Column, scale: int = 1024) -> Column:
    """``floor(scale * x)`` of every component as longs; null if the vector or a component is null or not finite."""
    ok = vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    return F.when(ok, F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long")))


def _postings(rows: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers, terms and weights of the non-zero components, by term and then row."""
    sizes = rows.map(len).to_numpy()
    weights = np.concatenate([np.asarray(r, dtype=np.int64) for r in rows]) if sizes.sum() else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(rows)), sizes)
    term = np.arange(len(weights)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    order = np.lexsort((row, term))
    order = order[weights[order] != 0]
    return row[order], term[order], weights[order]


def best_rows(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id, in that order."""
    at = np.arange(len(scores))
    if len(at) > k:
        least = np.partition(scores, len(at) - k)[len(at) - k]
        at = np.flatnonzero(scores >= least)
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", components: str = "components") -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best inner products of each query row with all other rows.

    ``vectors`` has a long id and integer ``components`` (array of longs; a missing component counts as
    zero). Rows whose id or components are null take no part. Every other row is one of its own, whether or
    not it repeats an id or a vector: a query meets all rows but itself, and two query rows of one id have
    rankings of their own (``k`` rows each). Ties go to the smaller id. Vectors so long that a score might not fit
    64 bits (a squared length of 2^62 or more) are an error. Fewer than
    k other rows: all of them. No query: no rows. A block's vectors are in one task's memory together, so
    very long vectors want smaller blocks.
    """
    # Rows are numbered once and written, so that a row has the same number in every block.
    known = vectors.where(F.col(id_col).isNotNull() & F.col(components).isNotNull())
    rows = written(known.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("vec_id"), F.col(components).alias("components"), is_query.alias("asks")), "topk-rows")
    # No inner product, and no part of one, is larger than the largest squared length.
    length = F.aggregate("components", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    sizes = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("q"), F.max(length).alias("longest")).first()
    if (sizes["longest"] or 0.0) >= 2.0**62:
        raise OverflowError(f"scores of vectors of squared length {sizes['longest']:.3g} may not fit 64 bits; use a smaller scale")
    n_blocks, q_blocks = max(1, math.ceil(sizes["n"] / CANDIDATES)), max(1, math.ceil(sizes["q"] / QUERIES))
    block = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    pair = (F.col("c") * F.lit(q_blocks).cast("long") + F.col("q")).alias("pair")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    queries = rows.where("asks").withColumn("q", block(q_blocks)).select("row", "vec_id", "components", "q", every(n_blocks).alias("c")).select(pair, "row", "vec_id", "components")
    candidates = rows.withColumn("c", block(n_blocks)).select("row", "vec_id", "components", "c", every(q_blocks).alias("q")).select(pair, "row", "vec_id", "components")

    def local_best(asking: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"row": [], "query_id": [], "vec_id": [], "score": []}
        if len(asking) and len(held):
            ids, numbers = held["vec_id"].to_numpy(dtype=np.int64), held["row"].to_numpy(dtype=np.int64)
            row, term, weight = _postings(held["components"])
            cuts = np.searchsorted(term, np.arange(term.max() + 2 if len(term) else 1))
            for own, query, parts in zip(asking["row"].tolist(), asking["vec_id"].tolist(), asking["components"]):
                scores = np.zeros(len(ids), np.int64)
                for t in np.flatnonzero(parts).tolist():
                    if t + 1 < len(cuts):
                        a, b = cuts[t], cuts[t + 1]
                        scores[row[a:b]] += np.int64(parts[t]) * weight[a:b]  # a row occurs once in a term's postings
                others = np.flatnonzero(numbers != own)
                best = others[best_rows(scores[others], ids[others], k)]
                out["row"].append(np.full(len(best), own))
                out["query_id"].append(np.full(len(best), query))
                out["vec_id"].append(ids[best])
                out["score"].append(scores[best])
        return pd.DataFrame({c: np.concatenate(v) if v else np.zeros(0, np.int64) for c, v in out.items()})

    local = queries.groupBy("pair").cogroup(candidates.groupBy("pair")).applyInPandas(local_best, "row long, query_id long, vec_id long, score long")
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
