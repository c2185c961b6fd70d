"""Alignment of two tokenizers' tokens over the bytes of every text.

Where tokens of both tokenizers end at the same byte, the text is cut into groups. A byte range of a text gives a
:class:`Fragment`: the tokens up to its first such cut (open prefix), the groups between its cuts (closed) and the tokens
after its last cut (open suffix). Fragments of neighbouring ranges compose, and composition is associative, so the
ranges of a very long text are aligned by different tasks and composed over a tree. A short text is one range.

Counts over the corpus go through blocks of texts: a block lists its distinct pairs of linked ids once, rows of
(block, pair) are counted and joined, and every text's links are small numbers into its block's list.
"""

from __future__ import annotations

import hashlib
import json
import math
import os
from collections.abc import Iterator
from functools import reduce
from itertools import chain
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.llm.packing import slices
from kerbside.staging import written

#: Bytes of a range of a very long text, ranges that one task composes, and bytes of text in a block.
CHUNK, FAN, BLOCK_BYTES = 1 << 15, 8, 4 << 20
#: Segments of a generation that a worker remembers; it remembers two.
REMEMBERED = 60_000
#: The last bytes of white space beyond ASCII, in UTF-8: fixed values.
_WIDE_SPACE = ["c285", "c2a0", "e19a80", *(f"e280{x:02x}" for x in range(0x80, 0x8B)), "e280a8", "e280a9", "e280af", "e2819f", "e38080"]
_CHUNKS = "doc_id long, row long, chunk int, chunks int, a binary, a_start long, b binary, b_start long"
_NODES = "doc_id long, row long, node int, cut boolean, a binary, a_ends binary, b binary, b_ends binary, n_a long, n_b long, n_groups long, text binary, links binary, last_a binary, last_a_ends binary, last_b binary, last_b_ends binary"
_BLOCKS = "block long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, sha array<string>, ends array<long>, codes binary, code_docs binary, links binary"


class Tokens(NamedTuple):
    """Ids of both tokenizers and the byte offsets at which their tokens end, each in order."""

    a: np.ndarray
    a_ends: np.ndarray
    b: np.ndarray
    b_ends: np.ndarray

    def __add__(self, other: Tokens) -> Tokens:
        return Tokens(*(np.concatenate(x) for x in zip(self, other)))

    def upto(self, low: int, high: int) -> Tokens:
        """The tokens that end after ``low`` and not after ``high``."""
        a, b = (slice(*np.searchsorted(ends, [low, high], side="right")) for ends in (self.a_ends, self.b_ends))
        return Tokens(self.a[a], self.a_ends[a], self.b[b], self.b_ends[b])

    def packed(self) -> tuple[bytes, ...]:
        return tuple(x.astype(kind).tobytes() for x, kind in zip(self, ("<u4", "<i8", "<u4", "<i8")))

    @staticmethod
    def read(*parts: bytes) -> Tokens:
        return Tokens(*(np.frombuffer(x, kind).astype(np.int64) for x, kind in zip(parts, ("<u4", "<i8", "<u4", "<i8"))))


NO_TOKENS = Tokens(*(np.zeros(0, np.int64),) * 4)


class Pair:
    """Two tokenizers: A a byte-level BPE (a ``tokenizers`` file), B a sentencepiece model that puts a space in front."""

    def __init__(self, a_path: str, b_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        byte_of = {chr(c): c for c in (*range(33, 127), *range(161, 173), *range(174, 256))}  # byte-level BPE spells these as they are
        byte_of |= {chr(256 + k): c for k, c in enumerate(c for c in range(256) if chr(c) not in byte_of)}  # and the others from 256 on
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (1 + max(vocabulary.values()))
        for token, k in vocabulary.items():
            self.a_bytes[k] = bytes(map(byte_of.__getitem__, token)) if set(token) <= byte_of.keys() else token.encode()
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array([len(x) for x in table], np.int64) for table in (self.a_bytes, self.b_bytes))
        # Between a character that is no white space and a space or line end, and between a letter and a mark, both
        # tokenizers end a token, whatever stands around, if A splits like byte-level BPE does and no piece of B goes over
        # such a place. Else texts stay whole.
        shape = json.loads(self.a.to_str())
        split = shape["pre_tokenizer"] or {}
        self.cuts = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and shape["normalizer"] is None
        self.cuts = self.cuts and not any("▁" in p.lstrip("▁") or "\n" in p for p in pieces)
        self.apart = np.zeros((256, 256), bool)  # a letter of Latin-1 and the mark of ASCII that follows
        marks = [c for c in range(33, 127) if not chr(c).isalnum()]
        for letter in filter(lambda c: chr(c).isalpha(), range(256)):
            self.apart[letter, marks] = True
        for p in pieces:
            for x, y in zip(map(ord, p), map(ord, p[1:])):
                if x < 256 and y < 256:
                    self.apart[x, y] = False
        # Every id's spelling in a list of groups, by what follows: more of its side, or the other side or group.
        self.spelled = pa.array([f"{k}{mark}".encode() for n, last in ((len(self.a_bytes), "|"), (len(self.b_bytes), ";")) for k in range(n) for mark in (",", last)], pa.large_binary())
        self.known: dict[bytes, tuple[bytes, bytes, bool]] = {}
        self.older: dict[bytes, tuple[bytes, bytes, bool]] = {}

    def learn(self, segments: list[bytes]) -> None:
        """Tokenise the segments that are not remembered."""
        if len(self.known) > REMEMBERED:
            self.older, self.known = self.known, {}
        new = [s for s in segments if s not in self.known]
        self.known.update((s, self.older[s]) for s in new if s in self.older)
        new = [s for s in new if s not in self.known]
        for at in range(0, len(new), 4096):
            some = new[at : at + 4096]
            texts = [s.decode("utf-8", "replace") for s in some]
            of_a = [x.ids for x in self.a.encode_batch_fast(texts, add_special_tokens=False)]
            # B puts a space in front. Where there is none, a line end, which joins with nothing, stands between.
            of_b = [b if t[:1] == " " != t else b[2:] for t, b in zip(texts, self.b.encode([t[1:] if t[:1] == " " != t else "\n" + t for t in texts], num_threads=1))]
            exact = [b"".join(map(self.a_bytes.__getitem__, a)) == s == b"".join(map(self.b_bytes.__getitem__, b)) for s, a, b in zip(some, of_a, of_b)]
            (a, a_to), (b, b_to) = map(_flat, (of_a, of_b))
            self.known.update(zip(some, zip((a[i:j] for i, j in zip(a_to, a_to[1:])), (b[i:j] for i, j in zip(b_to, b_to[1:])), exact)))

    def placed(self, a: bytes, a_start: int, b: bytes, b_start: int) -> Tokens:
        """Tokens that follow each other from a byte on."""
        a, b = (np.frombuffer(x, "<u4").astype(np.int64) for x in (a, b))
        return Tokens(a, a_start + np.cumsum(self.a_size[a]), b, b_start + np.cumsum(self.b_size[b]))

    def segments(self, joined: pa.LargeBinaryArray) -> tuple[pa.LargeBinaryArray, np.ndarray]:
        """The texts cut into segments, and each text's first segment, with the number of segments at the end."""
        at = np.frombuffer(joined.buffers()[1], "<i8")[joined.offset : joined.offset + len(joined) + 1]
        data = np.frombuffer(joined.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
        at = at - at[0]
        bounds = at
        if self.cuts and len(data):
            last = np.where(data[:-1] < 128, data[:-1], 0)  # the letter that ends here
            latin = (data[:-2] == 0xC3) & (data[1:-1] >= 128)
            last[1:][latin] = data[1:-1][latin] + 64
            cut = self.apart[last, data[1:]]
            space = ((data >= 9) & (data <= 13)) | ((data >= 28) & (data <= 32))  # bytes that end white space
            for end in map(bytes.fromhex, _WIDE_SPACE):
                here = np.flatnonzero(data[len(end) - 1 :] == end[-1]) + len(end) - 1
                for k in range(1, len(end)):
                    here = here[data[here - k] == end[-1 - k]]
                space[here] = True
            cut |= ((data[1:] == 32) | (data[1:] == 10)) & ~space[:-1]
            bounds = np.concatenate([np.flatnonzero(cut) + 1, at])
        bounds = np.sort(bounds)
        bounds = bounds[np.concatenate([[True], bounds[1:] != bounds[:-1]])]
        found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype("<i8").tobytes()), pa.py_buffer(data.tobytes())])
        return found, np.searchsorted(bounds, at)

    def tokens(self, segments: list[bytes]) -> tuple[Tokens, np.ndarray, np.ndarray, np.ndarray]:
        """Tokens of the segments laid end to end; how many of A and of B each has; and whether both spell it exactly (else it has none)."""
        self.learn(segments)
        rows = [self.known[s] for s in segments]
        exact = np.array([r[2] for r in rows], bool)
        a, b = (np.frombuffer(b"".join(r[k] for r in rows if r[2]), "<u4").astype(np.int64) for k in (0, 1))
        n_a, n_b = (np.array([len(r[k]) // 4 if r[2] else 0 for r in rows], np.int64) for k in (0, 1))
        return Tokens(a, np.cumsum(self.a_size[a]), b, np.cumsum(self.b_size[b])), n_a, n_b, exact


_pairs: dict[tuple[str, str], Pair] = {}


def pair_of(paths: tuple[str, str]) -> Pair:
    if paths not in _pairs:
        _pairs[paths] = Pair(*paths)
    return _pairs[paths]


class Aligned(NamedTuple):
    """Tokens in groups: a flag for each A and B token that ends one, the groups' text, and linked pairs of ids with the bytes where they end."""

    a_last: np.ndarray
    b_last: np.ndarray
    text: pa.LargeBinaryArray
    codes: np.ndarray
    code_ends: np.ndarray


def align(t: Tokens, pair: Pair) -> Aligned:
    """Align tokens that begin and end at a cut. A token overlaps another exactly where one of the two ends inside or with the other, so every distinct end is one link."""
    b_at, a_at = np.searchsorted(t.b_ends, t.a_ends), np.searchsorted(t.a_ends, t.b_ends)
    a_last, b_last = t.b_ends[b_at] == t.a_ends, t.a_ends[a_at] == t.b_ends
    cuts = t.a_ends[a_last]
    # In the list a group's A tokens come first: a token moves behind those of the other side that precede its group or stand in it.
    before = np.concatenate([[0], np.searchsorted(t.b_ends, cuts, side="right")])
    upto = np.concatenate([np.searchsorted(t.a_ends, cuts, side="right"), [len(t.a)]])
    order = np.empty(len(t.a) + len(t.b), np.int64)
    order[np.arange(len(t.a)) + before[np.searchsorted(cuts, t.a_ends)]] = 2 * t.a + a_last
    order[np.arange(len(t.b)) + upto[np.searchsorted(cuts, t.b_ends)]] = 2 * (len(pair.a_bytes) + t.b) + b_last
    codes = np.concatenate([t.a * len(pair.b_bytes) + t.b[b_at], (t.a[a_at] * len(pair.b_bytes) + t.b)[~b_last]])
    ends = np.concatenate([t.a_ends, t.b_ends[~b_last]])
    by_place = np.argsort(ends, kind="stable")
    return Aligned(a_last, b_last, pair.spelled.take(pa.array(order)), codes[by_place], ends[by_place])


class Fragment(NamedTuple):
    """What a byte range knows: tokens up to its first cut, or all if there is none (``cut`` false), closed groups, and tokens after the last cut."""

    first: Tokens = NO_TOKENS
    cut: bool = False
    n_a: int = 0
    n_b: int = 0
    n_groups: int = 0
    text: bytes = b""
    links: np.ndarray = NO_TOKENS.a
    last: Tokens = NO_TOKENS

    def closed(self, tokens: Tokens, pair: Pair) -> Fragment:
        """With whole groups added to the closed ones."""
        if not len(tokens.a):
            return self
        found = align(tokens, pair)
        return self._replace(n_a=self.n_a + len(tokens.a), n_b=self.n_b + len(tokens.b), n_groups=self.n_groups + int(found.a_last.sum()), text=self.text + _bytes(found.text), links=np.concatenate([self.links, found.codes]))


def _flat(ids: list[list[int]]) -> tuple[bytes, list[int]]:
    """All ids (little-endian unsigned 32-bit), and where each list begins and ends in the bytes."""
    ends = np.cumsum([0, *map(len, ids)]) * 4
    return np.fromiter(chain.from_iterable(ids), "<u4", int(ends[-1]) // 4).tobytes(), ends.tolist()


def _distinct(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in order, and each value's place among them."""
    place, found = pd.factorize(codes)
    order = np.argsort(found)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return found[order], rank[place]


def _bytes(texts: pa.LargeBinaryArray) -> bytes:
    """The texts of an array that owns its buffers, one after the other."""
    return (texts.buffers()[2] or pa.py_buffer(b"")).to_pybytes()[: int(np.frombuffer(texts.buffers()[1], "<i8")[len(texts)])]


def fragment(t: Tokens, pair: Pair) -> Fragment:
    """The fragment of one range's tokens."""
    cuts = np.intersect1d(t.a_ends, t.b_ends, assume_unique=True)
    if not len(cuts):
        return Fragment(first=t)
    lowest = min(t.a_ends[0], t.b_ends[0]) - 1
    return Fragment(first=t.upto(lowest, cuts[0]), cut=True, last=t.upto(cuts[-1], np.iinfo(np.int64).max)).closed(t.upto(cuts[0], cuts[-1]), pair)


def compose(x: Fragment, y: Fragment, pair: Pair) -> Fragment:
    """The fragment of two neighbouring ranges. Associative, and the empty fragment changes nothing."""
    if not x.cut:
        return y._replace(first=x.first + y.first)
    if not y.cut:
        return x._replace(last=x.last + y.first)
    joined = x.closed(x.last + y.first, pair)
    return Fragment(x.first, True, joined.n_a + y.n_a, joined.n_b + y.n_b, joined.n_groups + y.n_groups, joined.text + y.text, np.concatenate([joined.links, y.links]), y.last)


def _joined(texts: pa.Array) -> pa.LargeBinaryArray:
    """A space and the text, in bytes; null and empty texts are empty."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    spaced = pc.binary_join_element_wise(pa.scalar(b" ", pa.large_binary()), texts, pa.scalar(b"", pa.large_binary()))
    return pc.if_else(pc.equal(pc.binary_length(texts), 0), pa.scalar(b"", pa.large_binary()), spaced)


def _numbers() -> Iterator[int]:
    """Numbers that no other task of this job gives."""
    task = TaskContext.get()
    start = (task.partitionId() if task else 0) << 32
    return iter(range(start, start + (1 << 32)))


def _block(number: int, doc_ids: list, n_a, n_b, n_groups, shas: list, ends: np.ndarray, codes: np.ndarray, links: np.ndarray) -> pa.RecordBatch:
    """A block's row: its distinct pairs, in how many of its texts each is linked, and every text's links as places in that list."""
    links = links.astype(np.uint32)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    for a, b in zip(starts.tolist(), ends.tolist()):
        links[a:b].sort()
    fresh = np.ones(len(links), bool)
    fresh[1:] = links[1:] != links[:-1]
    fresh[starts[starts < len(links)]] = True
    docs = np.bincount(links[fresh], minlength=len(codes)).astype("<u4")
    steps = np.diff(links.astype(np.int64), prepend=0)
    steps = (steps << 1) ^ (steps >> 63)  # a text's links ascend; the next text steps back
    planes = np.ascontiguousarray(steps.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()
    packed = zstandard.ZstdCompressor(level=1).compress(planes)
    values = [[number], [doc_ids], [list(n_a)], [list(n_b)], [list(n_groups)], [shas], [ends.tolist()], [codes.astype("<u4").tobytes()], [docs.tobytes()], [packed]]
    kinds = [pa.int64(), *(pa.list_(pa.int64()),) * 4, pa.list_(pa.string()), pa.list_(pa.int64()), *(pa.binary(),) * 3]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], names=["block", "doc_id", "n_a", "n_b", "n_groups", "sha", "ends", "codes", "code_docs", "links"])


def _links(packed: bytes) -> np.ndarray:
    """What :func:`_block` packed."""
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(4, -1)
    steps = np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)
    return np.cumsum((steps >> 1) ^ -(steps & 1))


def short_blocks(docs: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """Blocks of texts that are one range each. A segment between certain cuts is aligned once for all its places in a block."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, numbers = pair_of(paths), _numbers()
        for batch in batches:
            for part in slices(batch, 1, BLOCK_BYTES):
                segments, first = pair.segments(_joined(part.column(1)))
                coded = segments.dictionary_encode()
                at = coded.indices.to_numpy()
                tokens, n_a, n_b, exact = pair.tokens(coded.dictionary.to_pylist())
                found = align(tokens, pair)
                a_to, b_to = np.cumsum(n_a), np.cumsum(n_b)
                n_groups = np.diff(np.concatenate([[0], np.cumsum(found.a_last)])[a_to], prepend=0)
                per_doc = lambda values: np.diff(np.concatenate([[0], np.cumsum(values[at])])[first])
                whole = per_doc(~exact) == 0
                keep = np.repeat(whole, np.diff(first))  # segments of texts that have tokens
                # The groups' text of each distinct segment, then of each text.
                offsets = np.frombuffer(found.text.buffers()[1], "<i8")[: len(found.text) + 1]
                text_to = np.concatenate([[0], offsets[a_to + b_to]])
                texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n_a), [None, pa.py_buffer(text_to.astype("<i8").tobytes()), found.text.buffers()[2]])
                laid = texts.take(pa.array(at))
                laid_to = np.frombuffer(laid.buffers()[1], "<i8")[: len(laid) + 1][first]
                every = memoryview(laid.buffers()[2] or b"")
                shas = [hashlib.sha256(every[a : b - 1]).hexdigest() if ok and b > a else "" for a, b, ok in zip(laid_to.tolist(), laid_to[1:].tolist(), whole.tolist())]
                # Links of each distinct segment as places among the block's distinct pairs, then of each text.
                codes, place = _distinct(found.codes)
                link_to = np.concatenate([[0], np.searchsorted(found.code_ends, np.concatenate([[0], tokens.a_ends])[a_to], side="right")])
                places = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n_a), [None, pa.py_buffer((4 * link_to).astype("<i8").tobytes()), pa.py_buffer(place.astype("<u4").tobytes())])
                links = np.frombuffer(_bytes(places.take(pa.array(at[keep]))), "<u4")
                n_links = n_a + n_b - n_groups
                sums = [np.where(whole, per_doc(x), 0) for x in (n_a, n_b, n_groups, n_links)]
                yield _block(next(numbers), part.column(0).to_pylist(), *(x.tolist() for x in sums[:3]), shas, np.cumsum(sums[3]), codes, links)

    return docs.mapInArrow(blocks, _BLOCKS)


def long_blocks(docs: DataFrame, paths: tuple[str, str], chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """Blocks of very long texts: tokens are dealt to tasks by byte range, and fragments are composed over a tree."""

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, numbers = pair_of(paths), _numbers()
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), *(pa.binary(), pa.int64()) * 2]
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                segments, _ = pair.segments(_joined(one.column(1)))
                coded = segments.dictionary_encode()
                tokens, n_a, n_b, exact = pair.tokens(coded.dictionary.to_pylist())
                at = coded.indices.to_numpy()
                rows = []
                if exact.all():
                    laid = []
                    for ids, n, sizes in ((tokens.a, n_a, pair.a_size), (tokens.b, n_b, pair.b_size)):
                        to = np.concatenate([[0], np.cumsum(n)])
                        lengths = n[at]
                        where = np.repeat(to[at] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
                        laid += [ids[where], np.cumsum(sizes[ids[where]])]
                    tokens = Tokens(*laid)
                    for low in range(0, int(tokens.a_ends[-1]), chunk):
                        some = tokens.upto(low, low + chunk)
                        start = [int(ends[0] - sizes[ids[0]]) if len(ids) else low for ids, ends, sizes in ((some.a, some.a_ends, pair.a_size), (some.b, some.b_ends, pair.b_size))]
                        rows.append((some.a.astype("<u4").tobytes(), start[0], some.b.astype("<u4").tobytes(), start[1]))
                rows = rows or [(b"", 0, b"", 0)]
                doc, number = one.column(0)[0].as_py(), next(numbers)
                columns = [[doc] * len(rows), [number] * len(rows), range(len(rows)), [len(rows)] * len(rows), *zip(*rows)]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(columns, kinds)], names=[c.split()[0] for c in _CHUNKS.split(", ")])

    def composed(group: pa.Table, node: int, fragments: list[Fragment], whole: bool) -> pa.Table:
        """The fragments' composition as a node of the tree, or as a block if it is the whole text."""
        pair, row = pair_of(paths), group["row"][0].as_py()
        f = reduce(lambda x, y: compose(x, y, pair), fragments, Fragment())
        if whole:
            # The text begins at a cut: what stood open before the first one is a group.
            f = compose(Fragment(cut=True), f, pair)
            f = f.closed(f.last, pair)
            codes, place = _distinct(f.links)
            sha = hashlib.sha256(f.text[:-1]).hexdigest() if f.text else ""
            return pa.Table.from_batches([_block(-1 - row, [group["doc_id"][0].as_py()], [f.n_a], [f.n_b], [f.n_groups], [sha], np.array([len(place)]), codes, place)])
        values = [group["doc_id"][0].as_py(), row, node, f.cut, *f.first.packed(), f.n_a, f.n_b, f.n_groups, f.text, f.links.astype("<u4").tobytes(), *f.last.packed()]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), *(pa.binary(),) * 4, *(pa.int64(),) * 3, *(pa.binary(),) * 6]
        return pa.table([pa.array([v], kind) for v, kind in zip(values, kinds)], names=[c.split()[0] for c in _NODES.split(", ")])

    def leaves(whole: bool):
        def one(group: pa.Table) -> pa.Table:
            pair, group = pair_of(paths), group.sort_by("chunk")
            found = [fragment(pair.placed(*(group[c][k].as_py() for c in ("a", "a_start", "b", "b_start"))), pair) for k in range(group.num_rows)]
            return composed(group, group["chunk"][0].as_py() // fan, found, whole)

        return one

    def branches(whole: bool):
        def one(group: pa.Table) -> pa.Table:
            group = group.sort_by("node")
            found = [Fragment(Tokens.read(r["a"], r["a_ends"], r["b"], r["b_ends"]), r["cut"], r["n_a"], r["n_b"], r["n_groups"], r["text"], np.frombuffer(r["links"], "<u4").astype(np.int64), Tokens.read(r["last_a"], r["last_a_ends"], r["last_b"], r["last_b_ends"])) for r in group.to_pylist()]
            return composed(group, group["node"][0].as_py() // fan, found, whole)

        return one

    chunks = written(docs.mapInArrow(ranges, _CHUNKS), "alignment-chunks")
    left = math.ceil((chunks.agg(F.max("chunks")).first()[0] or 1) / fan)
    nodes = chunks.groupBy("row", F.floor(F.col("chunk") / fan).alias("__up")).applyInArrow(leaves(left == 1), _BLOCKS if left == 1 else _NODES)
    while left > 1:
        left = math.ceil(left / fan)
        nodes = nodes.groupBy("row", F.floor(F.col("node") / fan).alias("__up")).applyInArrow(branches(left == 1), _BLOCKS if left == 1 else _NODES)
    return nodes


def align_tokenizers(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` for every row of ``docs``.

    A space and the text are tokenised by both tokenizers, without special tokens; their strings inside a text are
    plain text. Rows are documents: those that repeat, and those without an id, count one by one. Null and empty texts,
    and texts that the tokens' bytes do not spell exactly, have no tokens: zeros and an empty digest. A link is a pair of
    tokens whose bytes overlap; a pair of ids counts the documents that hold it linked; ``n_best`` are the links whose
    count is the highest of their A id, ties included. Texts of more than ``chunk`` bytes go by byte ranges. Other
    columns are not looked at; an empty table gives no rows.
    """
    paths = (a_path, b_path)
    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("__text"))
    is_long = F.coalesce(F.octet_length("__text") > chunk, F.lit(False))
    blocks = written(short_blocks(kept.where(~is_long), paths).unionByName(long_blocks(kept.where(is_long), paths, chunk)), "alignment-blocks")
    n_b = len(pair_of(paths).b_bytes)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, codes, docs_ in zip(*(batch.column(k).to_pylist() for k in range(3))):
                codes, docs_ = np.frombuffer(codes, "<u4").astype(np.int64), np.frombuffer(docs_, "<u4").astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), block)), pa.array(codes), pa.array(docs_)], names=["block", "code", "docs"])

    pairs = blocks.select("block", "codes", "code_docs").mapInArrow(listed, "block long, code long, docs long")
    counts = written(pairs.groupBy("code").agg(F.sum("docs").alias("n")), "alignment-counts")
    of_a = F.floor(F.col("code") / n_b)
    top = counts.groupBy(of_a.alias("of_a")).agg(F.max("n").alias("top"))
    judged = counts.withColumn("of_a", of_a).join(top, "of_a").select("code", "n", (F.col("n") == F.col("top")).alias("best"))
    found = pairs.select("block", "code").join(judged, "code")

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("code")
        n, best = right["n"].to_numpy(), right["best"].to_numpy().astype(np.int64)
        out = []
        for row in left.to_pylist():
            at, ends = _links(row["links"]), np.array(row["ends"], np.int64)
            starts = np.concatenate([[0], ends[:-1]])
            sums = [(total := np.concatenate([[0], np.cumsum(values[at])]))[ends] - total[starts] for values in (n, best)]
            out.append(pa.table({
                "doc_id": pa.array(row["doc_id"], pa.int64()), "n_a": row["n_a"], "n_b": row["n_b"], "n_groups": row["n_groups"], "n_links": ends - starts,
                "n_best": sums[1], "count_sum": sums[0], "groups_sha256": row["sha"],
            }))
        return pa.concat_tables(out)

    wanted = blocks.select("block", "doc_id", "n_a", "n_b", "n_groups", "sha", "ends", "links")
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return wanted.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(scored, schema)
