"""Best-fit packing of token sequences with certified bin counts.

Pieces are packed by best-fit decreasing in partitions of a bounded number of pieces. Dual-feasible
functions give each partition a lower bound on the sequences that any packing of its pieces needs; a
partition that meets its bound is certified. The same bound over the length histogram of everything (at
most ``capacity`` rows) says whether the whole is. While it is not, partitions whose count exceeds their
bound before rounding hand over the pieces of sequences that are not full; those are dealt anew, so that
pieces of different partitions meet, and best-fit decreasing runs again on them.
"""

from __future__ import annotations

import math
import os
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.staging import written, written_from_texts

#: Pieces of one partition at first and, in the exchange rounds, at most; bytes of text that are tokenised at a time.
PARTITION, LARGEST, TEXT_BYTES = 8192, 1 << 19, 2 << 20
#: Words of a generation: a worker remembers the ids of up to two. Fewer take less memory and more time.
REMEMBERED = 150_000
#: A word whose last letter or digit is followed by marks: they are two token groups. Beyond Latin-1 normalisation
#: may take the letter apart, and its mark then belongs to the marks' group, so such words stay whole.
_STEM_AND_MARKS = r"(?s)^(?P<stem>.*[0-9A-Za-z\x{AA}\x{B2}\x{B3}\x{B5}\x{B9}\x{BA}\x{BC}-\x{BE}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}])(?P<marks>[,.!%*#&$|?;:]+)$"


class WordIds(dict):
    """Ids (little-endian unsigned 32-bit, as bytes) of words; each is tokenised once.

    A tokenizer that splits at white space gives a text the ids of its words, one after the other; this holds
    for the vocabulary file this is made for, unless the text holds an added token (:attr:`added`).
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.older: dict[bytes, bytes] = {}
        self.remembered = REMEMBERED
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, dtype="<u4") for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def keys(self, words: pa.Array) -> pa.Array:
        """Words with the same ids: A-Z have those of a-z, unless other letters (composed before lower-casing) or added tokens come of it."""
        low = pc.ascii_lower(words)
        keep = pc.invert(pc.string_is_ascii(words))
        for token in self.added:
            keep = pc.or_(keep, pc.match_substring(low, token))
        return pc.if_else(keep, words, low)

    def learn(self, words: list[bytes]) -> None:
        """Add the words that are not known yet."""
        if len(self) > self.remembered:  # what is asked for again comes back from the generation before
            self.older = dict(self)
            self.clear()
        self[b""] = b""  # white space at the ends of a text, and no marks
        new = [w for w in words if w not in self]
        self.update((w, self.older[w]) for w in new if w in self.older)
        new = [w for w in new if w not in self]
        plain = [w for w in new if (w if w.isascii() else w.decode("utf-8", "replace")).isalpha()]
        alone = list(set(new).difference(plain))
        for k in range(0, len(plain), 512):
            some = plain[k : k + 512]
            ids = self.encode([b" ".join(some).decode("utf-8", "replace")])[0]
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(some):  # a letter that normalisation takes apart
                alone += some
                continue
            raw = ids.tobytes()
            stops = (4 * ends).tolist()
            self.update(zip(some, (raw[a:b] for a, b in zip([0, *stops], stops))))
        for k in range(0, len(alone), 512):
            some = alone[k : k + 512]
            self.update(zip(some, (x.tobytes() for x in self.encode([w.decode("utf-8", "replace") for w in some]))))

    def ids(self, words: pa.Array) -> pa.Array:
        """The ids of distinct words, as bytes; each distinct one is learned."""
        coded = words.dictionary_encode()
        distinct = coded.dictionary.cast(pa.binary()).to_pylist()
        self.learn(distinct)
        return pa.array(map(self.__getitem__, distinct), pa.large_binary()).take(coded.indices)


_known: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """This process's memory of the tokenizer at ``path``."""
    if path not in _known:
        _known[path] = WordIds(path)
    return _known[path]


def token_ids(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts in one array, without special tokens, and where each text's begin and end; null is empty.

    Words are split and counted off by Arrow; Python sees each distinct word of the batch once. A text
    that holds one of the tokenizer's added tokens is encoded whole.
    """
    known = word_ids(path)
    texts = pc.fill_null(texts, "")
    whole = np.zeros(len(texts), bool)
    for token in known.added:
        whole |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
    if whole.any():
        ids, bounds = token_ids(pc.if_else(pa.array(whole), "", texts), path)
        parts = [ids[a:b] for a, b in zip(bounds, bounds[1:])]
        for i in np.flatnonzero(whole).tolist():
            parts[i] = known.encode([texts[i].as_py()])[0]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])
    words = pc.ascii_split_whitespace(texts)
    coded = words.flatten().dictionary_encode()
    keys = known.keys(coded.dictionary)
    split = pc.extract_regex(keys, _STEM_AND_MARKS)
    stems, marks = (pc.struct_field(split, name) for name in ("stem", "marks"))
    ids = pc.binary_join_element_wise(known.ids(pc.coalesce(stems, keys)), known.ids(pc.fill_null(marks, "")), pa.scalar(b"", pa.large_binary()))
    flat = ids.take(coded.indices)
    ends, data = (np.frombuffer(flat.buffers()[k] or b"", kind) for k, kind in ((1, "<i8"), (2, "<u4")))
    return data[: ends[len(flat)] // 4], ends[words.offsets.to_numpy()] // 4


def slices(batch: pa.RecordBatch, column: int, most: int = TEXT_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows whose text in ``column`` comes to about ``most`` bytes, one row at least."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        before = sizes[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, before + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", remembered: int = REMEMBERED) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: each document's ids and ``end_id``, cut only if longer than ``capacity``.

    Null and empty texts are one piece of one id. Rows that repeat give pieces that repeat. ``tokenizer``
    is the path of a tokenizer file that every executor can read.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], "<u4").tobytes()
        step = 4 * capacity
        word_ids(tokenizer).remembered = remembered
        for batch in batches:
            for part in slices(batch, 1):
                rows: dict[str, list] = defaultdict(list)
                ids, bounds = token_ids(part.column(1), tokenizer)
                for doc, a, b in zip(part.column(0).to_pylist(), bounds.tolist(), bounds[1:].tolist()):
                    raw = ids[a:b].tobytes() + end
                    for k in range(0, len(raw), step):
                        piece = raw[k : k + step]
                        for name, value in (("doc_id", doc), ("piece", k // step), ("start", k // 4), ("length", len(piece) // 4), ("ids_crc32", zlib.crc32(piece))):
                            rows[name].append(value)
                yield pa.RecordBatch.from_arrays([pa.array(rows["doc_id"], pa.int64()), pa.array(rows["piece"], pa.int32()), *(pa.array(rows[c], pa.int64()) for c in ("start", "length", "ids_crc32"))], names=["doc_id", "piece", "start", "length", "ids_crc32"])
                pa.default_memory_pool().release_unused()

    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("__text"))
    return kept.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def fractional_bound(counts: np.ndarray, capacity: int) -> float:
    """The best dual-feasible lower bound on bins, before rounding up; ``counts[x]`` items have length x.

    The functions: items above ``capacity - t`` count as whole and items below ``t`` as nothing, for every
    t up to half of the capacity; and the stepped function of order k, for k up to 16.
    """
    x = np.arange(capacity + 1, dtype=np.int64)
    counts = counts.astype(np.int64)
    number, volume = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(counts * x)])
    t = np.arange(capacity // 2 + 1, dtype=np.int64)
    whole = number[-1] - number[capacity - t + 1]
    best = float((whole + (volume[capacity - t + 1] - volume[t]) / capacity).max())
    for k in range(1, 17):
        stepped = np.where((k + 1) * x % capacity == 0, x * k, (k + 1) * x // capacity * capacity)
        best = max(best, float((counts * stepped).sum() / (k * capacity)))
    return best


def rounded(bound: float) -> int:
    """The whole bins that a fractional bound certifies (safe against the last digit)."""
    return math.ceil(bound - 1e-9)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and the fill of each bin. Longest first, into the fullest bin that has room."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    fill: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some bin has room r
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        fits = rooms >> need
        if fits:
            room = need + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, len(fill)
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += need
        by_room[room - need].append(b)
        rooms |= 1 << (room - need)
    return bins, offsets, np.array(fill, dtype=np.int64)


def pack(pieces: DataFrame, capacity: int = 2048, partition: int = PARTITION, rounds: int = 6) -> tuple[DataFrame, dict]:
    """Place every row of the written table ``pieces`` in a sequence; also what is certified about it.

    ``pieces`` has ``doc_id``, ``piece`` and ``length`` (1 to ``capacity``) and may have more columns. Added
    are ``sequence_id``, ``offset`` (gapless from 0 in each sequence) and ``fill`` (ids in the sequence).
    The dictionary has ``sequences``, ``bound`` (no packing of these pieces needs fewer), ``rounds``. Rows
    that repeat, and rows without an id, are placed one by one, and no id makes a partition larger than
    others; an empty table gives an empty one.
    """
    names = pieces.columns
    shape = pieces.schema.simpleString()[len("struct<") : -1] + ",sequence_id:bigint,offset:bigint,fill:bigint,certified:boolean,gap:boolean"
    histogram = np.zeros(capacity + 1, np.int64)
    for row in pieces.groupBy("length").count().collect():  # at most `capacity` rows
        histogram[row["length"]] = row["count"]
    bound = rounded(fractional_bound(histogram, capacity))

    def packed(rows: DataFrame, number: int, n: int, most: int) -> DataFrame:
        parts = max(1, math.ceil(n / most))

        def one(group: pa.Table) -> pa.Table:
            group = group.take(pc.sort_indices(group, sort_keys=[("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")]))
            lengths = group["length"].to_numpy()
            bins, offsets, fill = best_fit_decreasing(lengths, capacity)
            least = fractional_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
            start = (number << 58) + (group["__part"][0].as_py() << 24)
            every = lambda value: pa.array(np.full(len(lengths), value))
            added = {"sequence_id": pa.array(start + bins), "offset": pa.array(offsets), "fill": pa.array(fill[bins]), "certified": every(len(fill) == rounded(least)), "gap": every(len(fill) > least + 1e-9)}
            return pa.table({c: group[c] for c in names} | added)

        # Numbered rows: however many share an id, or have none, they are dealt to all partitions.
        part = F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id(), F.lit(number)), F.lit(parts)).cast("int")
        return written(rows.withColumn("__part", part).groupBy("__part").applyInArrow(one, shape), f"packing-{number}")

    def sequences(df: DataFrame) -> int:
        return df.where("offset = 0").count()

    placed = packed(pieces, 0, int(histogram.sum()), partition)
    kept, open_, total, done = [placed], placed, sequences(placed), 0
    for number in range(1, rounds + 1):
        if total <= bound:
            break
        pool = open_.where(F.col("gap") & (F.col("fill") < capacity))
        n, before = pool.count(), sequences(pool)
        if not n:
            break
        # What is left over is little; a larger part of it meets in each round.
        most = min(partition * 4**number, max(partition, LARGEST))
        again = packed(pool.select(*names), number, n, most)
        after = sequences(again)
        if after < before:
            kept[-1] = kept[-1].where(~(F.col("gap") & (F.col("fill") < capacity)))
            kept.append(again)
            open_, total, done = again, total - before + after, number
        if n <= most:
            break
    whole = kept[0]
    for more in kept[1:]:
        whole = whole.unionByName(more)
    return whole.drop("certified", "gap"), {"sequences": total, "bound": bound, "rounds": done}


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, remembered: int = REMEMBERED) -> DataFrame:
    """Tokenise and pack ``docs`` (``doc_id``, ``text``): a row for each piece with its place.

    ``fill`` are the ids of its sequence, ``sequences`` how many there are, and ``least_sequences`` the certificate: no
    packing of these pieces has fewer.
    """
    placed, proof = pack(written_from_texts(token_pieces(docs, tokenizer, capacity, end_id, remembered=remembered), "packing-pieces"), capacity)
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "fill", F.lit(proof["sequences"]).cast("long").alias("sequences"), F.lit(proof["bound"]).cast("long").alias("least_sequences"))
