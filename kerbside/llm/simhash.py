"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints differ in at most ``2 * half`` bits exactly when some third value lies within
``half`` bits of both. So every distinct fingerprint emits its whole ball of that radius (2,081 values
for ``half`` = 2), values are shuffled, and fingerprints that meet in one value are linked. No pair of
members of a group is ever formed: whoever meets in a value is within the radius of every other one
there (triangle inequality), which is the verification, and each is linked to one representative.

Nearly all of the values belong to a single fingerprint. They are therefore shuffled twice over, first as
compressed keys only (a sorted list of hashed values per block, about two bytes for each) to learn which
keys occur more than once, and then in full for those keys alone. A key that two different values share
by chance costs a row in the second shuffle and nothing else: there values are compared in full.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.llm.components import component_labels
from kerbside.staging import written, written_from_texts

#: Fingerprints that one task expands at a time, and expanded values that one task compares.
BLOCK, RANGE = 4096, 4_000_000
#: Fingerprints whose balls are held in full at a time, and passes over a block, each of which holds the keys of its part of the ranges.
SLICE, PASSES = 256, 2


def text_fingerprint(text: str | None, width: int = 4) -> int:
    """The fingerprint of one text, unsigned. See :func:`fingerprints`."""
    from xxhash import xxh64_intdigest

    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= width:
        hashes = [xxh64_intdigest(joined, 42)]
    else:
        ends = list(accumulate(map((1).__add__, map(len, found))))
        starts = [0, *ends[: -width]]
        hashes = [xxh64_intdigest(joined[a : b - 1], 42) for a, b in zip(starts, ends[width - 1 :])]
    rows = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    ones = np.unpackbits(rows, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, id_type: str = "long") -> DataFrame:
    """``id_col`` (as ``id_type``) and ``fp`` (the fingerprint as a signed long) of every row.

    A-Z are lower-cased; words are runs without ASCII white space; shingles of ``width`` words count as
    often as they occur, and a shorter text is one shingle. A bit is set if more than half of the
    shingles' XXH64 (seed 42) have it. Null, empty and blank texts get 0.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([text_fingerprint(t.as_py(), width) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=[id_col, "fp"])

    kept = docs.select(F.col(id_col).cast(id_type).alias(id_col), F.col(text_col).cast("string").alias("__text"))
    return kept.mapInArrow(hashed, f"`{id_col}` {id_type}, fp long")


def ball_masks(half: int) -> np.ndarray:
    """All 64-bit values with at most ``half`` (0 to 2) bits set."""
    one = np.uint64(1) << np.arange(64, dtype=np.uint64)
    two = (one[:, None] | one[None, :])[np.triu_indices(64, 1)]
    return np.concatenate([np.zeros(1, np.uint64), one, two][: half + 1])


def _key(values: np.ndarray, bits: int) -> np.ndarray:
    """The top ``bits`` of a mixed 64-bit value (xor-shift and multiply, a bijection before the cut)."""
    x = values ^ (values >> np.uint64(32))
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x >> np.uint64(64 - bits)


def _pack(keys: np.ndarray, low: int, cells: int) -> bytes:
    """Sorted keys below ``cells << low``: how many fall in each cell, then their low bits byte by byte."""
    counts = np.bincount((keys >> np.uint64(low)).astype(np.int64), minlength=cells)
    wide = counts >= 255
    planes = keys.astype("<u4").view(np.uint8).reshape(-1, 4)[:, : (low + 7) // 8].copy()
    if low % 8:
        planes[:, -1] &= (1 << low % 8) - 1
    return b"".join([
        np.array([len(keys), wide.sum()], "<u8").tobytes(), np.where(wide, 255, counts).astype(np.uint8).tobytes(),
        counts[wide].astype("<u8").tobytes(), np.ascontiguousarray(planes.T).tobytes(),
    ])


def _unpack(blob: bytes, low: int, cells: int) -> np.ndarray:
    """What :func:`_pack` packed, sorted."""
    n, n_wide = (int(x) for x in np.frombuffer(blob, "<u8", 2))
    counts = np.frombuffer(blob, np.uint8, cells, 16).astype(np.int64)
    counts[counts == 255] = np.frombuffer(blob, "<u8", n_wide, 16 + cells).astype(np.int64)
    planes = np.frombuffer(blob, np.uint8, offset=16 + cells + 8 * n_wide).reshape(-1, n) if n else np.zeros((0, 0), np.uint8)
    keys = np.repeat(np.arange(cells, dtype=np.uint64) << np.uint64(low), counts)
    for k, plane in enumerate(planes):
        keys |= plane.astype(np.uint64) << np.uint64(8 * k)
    return keys


def _repeated(keys: np.ndarray) -> np.ndarray:
    """The values that a sorted array holds more than once, each once."""
    again = keys[1:][keys[1:] == keys[:-1]]
    return again[np.concatenate([[True], again[1:] != again[:-1]])] if len(again) else again


def _least_member(n: int, pairs: np.ndarray) -> np.ndarray:
    """For each of ``n`` places the least one that it is joined to; ``pairs`` are distinct, as ``a * n + b``."""
    top = np.arange(n)
    a, b = pairs // max(1, n), pairs % max(1, n)
    while len(a):
        x, y = top[a], top[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(top, np.maximum(x, y), np.minimum(x, y))
        while (top[top] != top).any():
            top = top[top]
    return top


def linked_fingerprints(fps: DataFrame, half: int = 2) -> DataFrame:
    """Edges ``src``, ``dst`` over distinct fingerprints (column ``fp``) with the components of all pairs within ``2 * half`` bits.

    An edge joins a member to a representative of those it is linked with, directly or over others of its
    block, so there are far fewer edges than pairs. ``fps`` is a written table; it may repeat fingerprints.
    Without rows there are no edges.
    """
    nodes = written(fps.select("fp").where(F.col("fp").isNotNull()).distinct(), "simhash-nodes")
    n = nodes.count()
    masks = ball_masks(half)
    n_blocks = max(1, math.ceil(n / BLOCK))
    n_ranges = 1 << max(0, math.ceil(math.log2(max(1, n * len(masks) / RANGE))))
    bits = math.ceil(math.log2(max(2, n * len(masks)))) + 9
    in_range = bits - int(math.log2(n_ranges))  # bits of a key below those that name its range
    low = max(8, bits - max(8, int(math.log2(BLOCK * len(masks))) - 2))
    low = min(low, in_range)
    cells = 1 << (in_range - low)
    blocks = nodes.select(F.pmod(F.xxhash64("fp", F.lit(7)), F.lit(n_blocks)).cast("int").alias("block"), "fp")

    def balls(fp: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """The balls of a few fingerprints at a time: the first one's position, values and their keys."""
        for a in range(0, len(fp), SLICE):
            values = (fp[a : a + SLICE].astype(np.int64).view(np.uint64)[:, None] ^ masks[None, :]).ravel()
            yield a, values, _key(values, bits)

    def keys_of(block: pd.DataFrame) -> pd.DataFrame:
        fp = block["fp"].to_numpy()
        rest, blobs = np.uint64((1 << in_range) - 1), []
        of_pass = math.ceil(n_ranges / PASSES)
        for first in range(0, n_ranges, of_pass):
            edges = np.arange(first, min(first + of_pass, n_ranges) + 1, dtype=np.uint64) << np.uint64(in_range)
            room, n_keys = np.empty(len(fp) * len(masks), np.uint64), 0  # only what is filled takes memory
            for _, _, some in balls(fp):
                some = some[(some >= edges[0]) & (some < edges[-1])]
                room[n_keys : n_keys + len(some)] = some
                n_keys += len(some)
            keys = room[:n_keys]
            keys.sort()
            at = np.searchsorted(keys, edges)
            blobs += [_pack(keys[a:b] & rest, low, cells) for a, b in zip(at, at[1:])]
        return pd.DataFrame({"range": np.arange(n_ranges, dtype=np.int32), "block": np.int32(block["block"].iloc[0]), "keys": blobs})

    def repeated_keys(group: pd.DataFrame) -> pd.DataFrame:
        start = np.uint64(int(group["range"].iloc[0]) << in_range)
        every = np.empty(sum(int(np.frombuffer(b, "<u8", 1)[0]) for b in group["keys"]), np.uint64)
        at = 0
        for b in group["keys"]:
            keys = _unpack(b, low, cells)
            every[at : at + len(keys)] = keys
            at += len(keys)
        every.sort()
        again = _repeated(every)
        del every
        slot = np.zeros(1 << min(in_range, 22), bool)  # most keys are ruled out by their top bits
        cut = np.uint64(max(0, in_range - 22))
        slot[(again >> cut).astype(np.int64)] = True
        found = []
        for b in group["keys"]:  # unpacked anew: all of them at once would take as much again
            keys = _unpack(b, low, cells)
            some = keys[slot[(keys >> cut).astype(np.int64)]]
            found.append((np.unique(some[np.isin(some, again)]) | start).astype("<u8").tobytes())
        return pd.DataFrame({"block": group["block"], "keys": found})

    def meetings(block: pd.DataFrame, hits: pd.DataFrame) -> pd.DataFrame:
        if block.empty or hits.empty:
            return pd.DataFrame({"src": [], "dst": [], "value": []}).astype("int64")
        fp = block["fp"].to_numpy(dtype=np.int64)
        wanted = np.sort(np.concatenate([np.frombuffer(b, "<u8") for b in hits["keys"]]))
        slot = np.zeros(1 << min(bits, 24), bool)
        cut = np.uint64(max(0, bits - 24))
        slot[(wanted >> cut).astype(np.int64)] = True
        hit = []
        for a, some, keys in balls(fp):
            at = np.flatnonzero(slot[(keys >> cut).astype(np.int64)])
            at = at[np.isin(keys[at], wanted)]
            hit.append((some[at].view(np.int64), (a + at // len(masks)).astype(np.int32)))
        values, owner = np.concatenate([v for v, _ in hit]), np.concatenate([o for _, o in hit])
        del hit
        order = np.argsort(values, kind="stable")  # owners come in their order
        owner = owner[order]
        values = values[order]
        del order
        # Within the block: members that meet are joined, and a value goes on with one of them only.
        same = np.flatnonzero(values[1:] == values[:-1])
        top = _least_member(len(fp), np.unique(owner[same].astype(np.int64) * len(fp) + owner[same + 1]))
        del same
        joined = np.flatnonzero(top != np.arange(len(fp)))
        first = np.concatenate([[True], values[1:] != values[:-1]]) if len(values) else np.zeros(0, bool)
        v, o = values[first], top[owner[first]]
        return pd.DataFrame({
            "src": np.concatenate([fp[joined], fp[o]]), "dst": np.concatenate([fp[top[joined]], fp[o]]),
            "value": np.concatenate([np.zeros(len(joined), np.int64), v]),
        })

    hits = blocks.groupBy("block").applyInPandas(keys_of, "range int, block int, keys binary").groupBy("range").applyInPandas(repeated_keys, "block int, keys binary").where(F.length("keys") > 0)
    met = written(blocks.groupBy("block").cogroup(hits.groupBy("block")).applyInPandas(meetings, "src long, dst long, value long"), "simhash-met")
    across = met.where(F.col("src") == F.col("dst"))
    # At most one row for each block, and never more than the ball holds: no group is large.
    least = across.groupBy("value").agg(F.min("src").alias("dst"), F.count(F.lit(1)).alias("n")).where("n > 1")
    between = across.select("value", "src").join(least, "value").where(F.col("src") != F.col("dst")).select("src", "dst")
    return met.where(F.col("src") != F.col("dst")).select("src", "dst").unionByName(between).distinct()


def near_duplicate_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, half: int = 2) -> DataFrame:
    """``id_col``, ``fp`` (signed long) and ``component_id`` for every row.

    ``component_id`` is the smallest id reachable over links of at most ``2 * half`` differing bits,
    itself included. Rows that repeat stay; null ids are never smallest (null if a component has no
    other); equal fingerprints are one node, however many rows have it. An empty table gives no rows.
    """
    fps = written_from_texts(fingerprints(docs, id_col, text_col, width), "simhash-fps")
    labels = component_labels(linked_fingerprints(fps, half))
    least = fps.groupBy("fp").agg(F.min(id_col).alias("least"))
    linked = written(labels.join(least, labels["node"] == least["fp"]).select("node", "label", "least"), "simhash-linked")
    joined = linked.select("node", "label").join(linked.groupBy("label").agg(F.min("least").alias("together")), "label").select(F.col("node").alias("fp"), "together")
    ids = written(least.join(joined, "fp", "left").select("fp", F.coalesce("together", "least").alias("component_id")), "simhash-ids")
    return fps.join(ids, "fp").select(id_col, "fp", "component_id")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without their near-duplicates: of each component the row of the smallest id stays.

    Null ids come last and ties go by fingerprint and text, so every component keeps exactly one row, whether
    or not it has an id. Rows that repeat both id and text are one row. Columns are those of ``docs``.
    """
    number = F.col(id_col).cast("long")
    # An id has no line breaks: the key is one for each pair of id and text.
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.md5(F.concat(F.coalesce(number.cast("string"), F.lit("")), F.lit("\n"), text))
    name = F.concat_ws(":", key, number.cast("string")).alias("__name")
    fps = written_from_texts(fingerprints(docs.select(name, F.col(text_col).alias("__text")), "__name", "__text", id_type="string"), "simhash-fps")
    parts = F.split("__name", ":")
    least = fps.groupBy("fp").agg(F.min(F.struct(F.get(parts, F.lit(1)).isNull().alias("none"), F.get(parts, F.lit(1)).cast("long").alias("id"), F.col("fp").alias("of"), F.get(parts, F.lit(0)).alias("key"))).alias("first"))
    labels = component_labels(linked_fingerprints(fps))
    first = least.join(labels, least["fp"] == labels["node"], "left").groupBy(F.coalesce("label", "fp").alias("component")).agg(F.min("first").alias("first"))
    kept = written(first.select(F.col("first.key").alias("__kept")), "simhash-kept")
    rows = docs.select(F.struct("*").alias("__row"), key.alias("__key"))
    return rows.join(kept, rows["__key"] == kept["__kept"]).dropDuplicates(["__key"]).select("__row.*")
