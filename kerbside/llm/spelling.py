"""Spelling variants by finite-state composition.

The vocabulary is a minimal acyclic acceptor V. Composed with a one-edit transducer E and V again, it accepts exactly
the pairs of words that differ by one inserted, deleted or replaced character. While nothing is edited both acceptors
are in one state, so the composition's states are (q, q) before the edit and (q, r) after it, where both must go on
alike; pairs of suffixes are therefore found once for each state, whatever leads to it.

The vocabulary never stands in one place. Words that begin alike share the state that their prefix leads to; each such
initial state, with the words behind it, is a partition of its own. That finds the pairs whose edit comes after
the prefix. The others end alike and are found on reversed words in the same way. Where a prefix or suffix is so common that
it has to be longer to keep a partition small, an edit may fall between the two; such pairs share all but the
edited place, which is then the initial state.
"""

from __future__ import annotations

import re
import sys
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.llm.packing import slices
from kerbside.staging import written

#: Letters of the shortest prefix and suffix that words are dealt by, words behind one initial state at most, words of a task, bytes of text counted at a time.
DEALT, STATE_WORDS, TASK_WORDS, TEXT_BYTES = 3, 20_000, 50_000, 16 << 20
_RUNS = "[A-Za-zÀ-ÿ]"


class Acceptor:
    """A minimal acyclic acceptor of sorted distinct words, built word by word: a finished branch is merged with an equal one.

    States are numbers; ``arcs[q]`` maps characters to states and ``final[q]`` says whether a word ends there.
    """

    def __init__(self, words: list[str]):
        self.longest = max(map(len, words), default=0)
        self.arcs: list[dict[str, int]] = [{}]
        self.final = [False]
        known: dict[tuple, int] = {}
        open_ = [0]  # states along the word before; none of them is merged yet
        before = ""
        for word in words:
            shared = 0
            for x, y in zip(word, before):
                if x != y:
                    break
                shared += 1
            self._merge(open_, before, shared, known)
            for c in word[shared:]:
                self.arcs.append({})
                self.final.append(False)
                self.arcs[open_[-1]][c] = len(self.arcs) - 1
                open_.append(len(self.arcs) - 1)
            self.final[open_[-1]] = True
            before = word
        self._merge(open_, before, 0, known)

    def _merge(self, open_: list[int], word: str, shared: int, known: dict[tuple, int]) -> None:
        while len(open_) > shared + 1:
            state = open_.pop()
            same = known.setdefault((self.final[state], *self.arcs[state].items()), state)
            self.arcs[open_[-1]][word[len(open_) - 1]] = same


def edit_pairs(v: Acceptor) -> Iterator[tuple[str, str]]:
    """The pairs that V o E o V accepts, each in one order, the edit being at the first place where the words differ."""
    arcs, final = v.arcs, v.final
    alike: dict[tuple[int, int], list[tuple | None]] = {}

    def both(q: int, r: int) -> list[tuple | None]:
        """Suffixes that lead from both states to a word's end: what is left of a pair after its edit. Each is a letter and its own rest."""
        key = (q, r) if q < r else (r, q)
        if key not in alike:
            found: list[tuple | None] = [None] if final[q] and final[r] else []
            mine, other = arcs[q], arcs[r]
            if len(other) < len(mine):
                mine, other = other, mine
            for c, to in mine.items():
                if c in other:
                    found += [(c, rest) for rest in both(to, other[c])]
            alike[key] = found
        return alike[key]

    def text(rest: tuple | None) -> str:
        letters = []
        while rest:
            letters.append(rest[0])
            rest = rest[1]
        return "".join(letters)

    here: list[list[tuple[str, str]] | None] = [None] * len(arcs)

    def edited(q: int) -> list[tuple[str, str]]:
        """Pairs of suffixes whose first difference is at this state."""
        found = here[q]
        if found is None:
            found = []
            each = list(arcs[q].items())
            for k, (c, to) in enumerate(each):
                for d, other in each[:k]:  # replaced
                    found += [(c + rest, d + rest) for rest in map(text, both(to, other))]
                if final[q] and final[to]:  # deleted at the end of a word
                    found.append((c, ""))
                for d, other in arcs[to].items():  # deleted; the shorter word goes on with another letter than it
                    if d != c and d in arcs[q]:
                        found += [(c + d + rest, d + rest) for rest in map(text, both(other, arcs[q][d]))]
            here[q] = found
        return found

    def paths(q: int, prefix: str) -> Iterator[tuple[str, str]]:
        """Every way from a state, with what is edited on it."""
        stack = [(q, prefix)]
        while stack:
            q, prefix = stack.pop()
            for x, y in edited(q):
                yield prefix + x, prefix + y
            stack += [(to, prefix + c) for c, to in arcs[q].items()]

    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(max(limit, v.longest + 1000))
    try:
        yield from paths(0, "")
    finally:
        sys.setrecursionlimit(limit)


def spelled(docs: DataFrame, shortest: int = 7, garble: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word`` and ``n``: distinct runs of letters (A-Z, a-z, U+00C0 to U+00FF) with A-Z in lower case, of ``shortest`` code points or more, counted over whole texts.

    With ``garble`` a run of a document loses a code point where ``garble`` divides the CRC-32 ``h`` of
    ``<doc_id>:<run>``, at ``h % length``: planted misspellings. Rows that repeat count again; a missing id
    is spelled as nothing.
    """
    runs = re.compile(f"{_RUNS}{{{shortest},}}")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, TEXT_BYTES):
                total: Counter[str] = Counter()
                ids = part.column(0).to_pylist()
                for doc, text in zip(ids, pc.ascii_lower(pc.fill_null(part.column(1), "")).to_pylist()):
                    found = runs.findall(text)
                    if not garble:
                        total.update(found)
                        continue
                    start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                    for run, n in Counter(found).items():
                        h = zlib.crc32(run.encode(), start)
                        if h % garble == 0:
                            at = h % len(run)
                            run = run[:at] + run[at + 1 :]
                            if len(run) < shortest:
                                continue
                        total[run] += n
                yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("__text"))
    return rows.mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _deal(words: DataFrame, side: str, begin: Column, most: int) -> DataFrame:
    """``words`` with the column ``side``: how many letters of ``begin`` (the word, or the word reversed) it is dealt by."""
    dealt, k = words.withColumn(side, F.lit(DEALT)), DEALT
    while True:
        begins = F.substring(begin, F.lit(1), F.lit(k))
        common = written(dealt.where(F.col(side) == k).groupBy(begins.alias("__begins")).count().where(F.col("count") > most).select("__begins"), "spelling-common")
        if not common.limit(1).count():
            return dealt
        longer = k + 1 if k < 8 else 2 * k
        hit = dealt.join(common, (F.col(side) == k) & (begins == common["__begins"]), "left")
        dealt = written(hit.withColumn(side, F.when(F.col("__begins").isNotNull(), F.lit(longer)).otherwise(F.col(side))).drop("__begins"), "spelling-dealt")
        k = longer


def near_words(words: DataFrame, state_words: int = STATE_WORDS) -> DataFrame:
    """``word``, ``near``, ``near_n``: every word with every word that differs from it by one edit, both ways.

    ``words`` is a written table of distinct ``word`` (none empty) and ``n``.
    """
    n_tasks = max(1, -(-words.count() // TASK_WORDS))
    dealt = _deal(_deal(words, "head", F.col("word"), state_words), "tail", F.reverse("word"), state_words)
    dealt = written(dealt, "spelling-words")
    shape = "word string, near string, near_n long"

    def alone(x: str, y: str, head: int) -> int:
        """The place of the first difference, or -1 if the words share the letters that they are dealt by."""
        at = 0
        for a, b in zip(x, y):
            if a != b:
                break
            at += 1
        return -1 if at >= head else at

    def rows(pairs: Iterator[tuple[str, str]], group: pa.Table) -> pa.Table:
        n = of(group, "n")
        found = [(x, y) for a, b in pairs for x, y in ((a, b), (b, a))]
        return pa.table({"word": pa.array([x for x, _ in found], pa.string()), "near": pa.array([y for _, y in found], pa.string()), "near_n": pa.array([n[y] for _, y in found], pa.int64())})

    def of(group: pa.Table, column: str) -> dict[str, int]:
        """A column by word."""
        return dict(zip(group["word"].to_pylist(), group[column].to_pylist()))

    def states(group: pa.Table) -> Iterator[tuple[str, list[str]]]:
        """Initial states of a task, with the words behind each."""
        behind = defaultdict(list)
        for begins, word in zip(group["begins"].to_pylist(), group["word"].to_pylist()):
            behind[begins].append(word)
        yield from behind.items()

    def begin_alike(group: pa.Table) -> pa.Table:
        def pairs():
            for begins, some in states(group):
                if len(some) > 1:
                    for x, y in edit_pairs(Acceptor(sorted(w[len(begins) :] for w in some))):
                        yield begins + x, begins + y

        return rows(pairs(), group)

    def end_alike(group: pa.Table) -> pa.Table:
        head = of(group, "head")

        def pairs():
            for begins, some in states(group):
                if len(some) > 1:
                    for x, y in edit_pairs(Acceptor(sorted(w[::-1][len(begins) :] for w in some))):
                        x, y = (begins + x)[::-1], (begins + y)[::-1]
                        if alone(x, y, head[x]) >= 0:
                            yield x, y

        return rows(pairs(), group)

    def meet_between(group: pa.Table) -> pa.Table:
        head, tail = of(group, "head"), of(group, "tail")

        def pairs():
            for begins, some in states(group):
                if len(some) > 1:
                    at = begins.index("\n")
                    for x, y in edit_pairs(Acceptor(sorted(w[at:] for w in some))):
                        x, y = begins[:at] + x, begins[:at] + y
                        if alone(x, y, head[x]) == at and alone(x[::-1], y[::-1], tail[x]) >= 0:
                            yield x, y

        return rows(pairs(), group)

    def task(*keys) -> Column:
        return F.pmod(F.xxhash64(*keys), F.lit(n_tasks)).cast("int").alias("task")

    def dealt_by(begins: Column) -> DataFrame:
        return dealt.select(begins.alias("begins"), "word", "n", "head").select(task("begins"), "begins", "word", "n", "head")

    first = dealt_by(F.substring("word", F.lit(1), F.col("head"))).groupBy("task").applyInArrow(begin_alike, shape)
    second = dealt_by(F.substring(F.reverse("word"), F.lit(1), F.col("tail"))).groupBy("task").applyInArrow(end_alike, shape)
    # Edited at a place that neither the common prefix nor the common suffix leaves out.
    size = F.char_length("word")
    places = dealt.where(F.col("head") + F.col("tail") > size).select("*", F.explode(F.sequence(F.greatest(size - F.col("tail"), F.lit(0)), F.least(F.col("head") - 1, size))).alias("at"))
    without = F.concat(F.substring("word", F.lit(1), F.col("at")), F.lit("\n"), F.substring("word", F.col("at") + 2, size))
    opened = F.concat(F.substring("word", F.lit(1), F.col("at")), F.lit("\n"), F.substring("word", F.col("at") + 1, size))
    between = places.select("word", "n", "head", "tail", F.explode(F.array(without, opened)).alias("begins"))
    third = between.select(task("begins"), "begins", "word", "n", "head", "tail").groupBy("task").applyInArrow(meet_between, shape)
    return first.unionByName(second).unionByName(third)


def variant_groups(words: DataFrame, times: int = 10, state_words: int = STATE_WORDS) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` for every row of ``words`` (distinct ``word`` and its count ``n``; null and empty words take no part).

    Near words differ by one inserted, deleted or replaced code point. A word's form is its near word of
    largest ``n`` (ties: the smallest in code-point order) if that is at least ``times`` (2 or more) the
    word's own, else null; ``root`` is reached over forms, a word without one is its own. Forms grow, so there are no
    cycles and at most a few rounds. Without words there are no rows.
    """
    words = written(words.select("word", F.col("n").cast("long").alias("n")).where("word <> ''"), "spelling-vocabulary")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best")
    near = near_words(words, state_words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    judged = words.join(near, "word", "left").withColumn("ok", F.coalesce(-F.col("best.less") >= F.lit(times) * F.col("n"), F.lit(False)))
    judged = written(judged.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("ok"), F.col("best.near")).alias("form"), F.when(F.col("ok"), -F.col("best.less")).alias("form_n")), "spelling-forms")
    forms = judged.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:  # every round doubles the steps taken
        on = forms.select(F.col("word").alias("root"), F.col("root").alias("further"))
        forms = written(forms.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        if not forms.where("moved").limit(1).count():
            break
        forms = forms.select("word", "root")
    return judged.join(forms.select("word", "root"), "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
