"""Chat formatting as relational expressions: sort, merge, concatenate, and read back.

Every conversation becomes one text. Neighbouring turns of one role share a block; inside it a mark keeps
the turns apart, so that nothing is lost::

    <|turn|>user<|text|>Hello<|next|>Are you there?<|end|>
    <|turn|>assistant<|text|>Yes<|end|>

Marks begin with ``<|``. In roles and texts a backslash is doubled and ``<|`` becomes ``<\\|``, so that no
text can look like a mark and every text can be restored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.llm.words import once

TURN, TEXT, NEXT, END = "<|turn|>", "<|text|>", "<|next|>", "<|end|>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_conversations(turns: DataFrame, learn_from: str = "assistant") -> DataFrame:
    """``conv_id``, ``formatted`` and ``loss_spans`` for every conversation; without turns there are none.

    ``turns`` has ``conv_id``, ``turn``, ``role``, ``text``. Turns are sorted by number (null last), then role
    and text; null roles and texts are empty; a null ``conv_id`` is a conversation of its own; rows that
    repeat are turns that repeat. ``loss_spans`` are the ``start`` and ``length`` (code points of
    ``formatted``) of the texts whose role is ``learn_from``, one for each turn, in order. Other columns, also
    ``formatted`` or ``loss_spans`` of ``turns``, are not looked at. A conversation is one row, so all its texts
    must fit a task's memory; time is in proportion to its turns.
    """
    row = F.struct(F.col("turn").isNull().alias("last"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), escape(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"))
    sorted_turns = turns.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(row)).alias("turns"))
    # Neighbouring turns of one role are merged: a block begins where the role changes.
    role = lambda i: F.get("turns", i)["role"]
    begins = F.filter(F.sequence(F.lit(0), F.size("turns") - 1), lambda i: (i == 0) | (role(i) != role(i - 1)))
    begun = sorted_turns.select("conv_id", "turns", once(begins).alias("begins"))
    upto = lambda k: F.coalesce(F.get("begins", k + 1), F.size("turns"))
    texts = lambda at, k: F.transform(F.slice("turns", at + 1, upto(k) - at), lambda x: x["text"])
    head = lambda r: F.concat(F.lit(TURN), escape(r), F.lit(TEXT))
    block = lambda at, k: F.struct(role(at).alias("role"), texts(at, k).alias("texts"))
    merged = begun.select("conv_id", once(F.transform("begins", block)).alias("blocks"))
    formatted = F.array_join(F.transform("blocks", lambda b: F.concat(head(b["role"]), F.array_join(b["texts"], NEXT), F.lit(END))), "")
    # A text begins after all that stands before it: other texts, marks between them, heads and ends of blocks.
    part = lambda first, last, r, x: F.struct(first.alias("head"), F.length(x).cast("long").alias("length"), (first + F.length(x) + F.when(last, len(END)).otherwise(len(NEXT))).cast("long").alias("all"), (r == learn_from).alias("learn"))
    parts = F.flatten(F.transform("blocks", lambda b: F.transform(b["texts"], lambda x, i: part(F.when(i == 0, F.length(head(b["role"]))).otherwise(0), i == F.size(b["texts"]) - 1, b["role"], x))))
    placed = merged.select("conv_id", formatted.alias("formatted"), once(parts).alias("parts")).select("*", once(_sums_within(F.transform("parts", lambda x: x["all"]))).alias("local"))
    placed = placed.select("*", once(_sums(F.transform("local", lambda x: x["at"]))["sums"]).alias("before"))
    starts = placed.select("conv_id", "formatted", "parts", once(F.flatten(F.transform("local", lambda x, k: F.transform(x["sums"], lambda s: s + F.get("before", k))))).alias("starts"))
    spans = F.filter(F.transform("parts", lambda x, i: F.struct((F.get("starts", i) + x["head"]).cast("int").alias("start"), x["length"].cast("int").alias("length"), x["learn"].alias("learn"))), lambda x: x["learn"])
    return starts.select("conv_id", "formatted", F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length"))).alias("loss_spans"))


#: Numbers that are added up one by one; an array of more is added up in runs of so many.
RUN = 512


def _sums(values: Column) -> Column:
    """``sums`` (of what stands before each value) and ``at`` (of all) of an array of longs; for short arrays, as the sums are appended one by one."""
    state = lambda sums, at: F.struct(sums.alias("sums"), at.alias("at"))
    return F.aggregate(values, state(F.array().cast("array<bigint>"), F.lit(0).cast("long")), lambda a, x: state(F.array_append(a["sums"], a["at"]), a["at"] + x))


def _sums_within(values: Column) -> Column:
    """:func:`_sums` of each run of ``RUN`` values."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / RUN).cast("int")), lambda k: _sums(F.slice(values, k * RUN + 1, F.lit(RUN))))


#: Code points of a piece of a formatted conversation, out of which spans are cut.
PIECE = 4096


def read_back(formatted: DataFrame) -> DataFrame:
    """``formatted`` with ``turns`` (``role``, ``text``) and ``learned`` (the texts under the loss mask), read from its text, in order.

    The text is split once by turn and once into pieces of ``PIECE`` code points; a span is cut from the pieces that it touches.
    """
    rows = formatted.select("*", once(F.struct(F.split("formatted", r"<\|turn\|>").alias("blocks"), F.regexp_extract_all("formatted", F.lit(f"(?s).{{1,{PIECE}}}"), 0).alias("pieces"))).alias("__s"))
    split = F.transform(F.filter("__s.blocks", lambda b, i: i > 0), lambda b: F.split(b, r"<\|text\|>|<\|next\|>|<\|end\|>\n"))
    turns = F.flatten(F.transform(split, lambda p: F.transform(F.slice(p, F.lit(2), F.size(p) - 2), lambda x: F.struct(unescape(F.get(p, F.lit(0))).alias("role"), unescape(x).alias("text")))))
    piece = lambda at: F.floor(at / PIECE).cast("int")
    touched = lambda s: F.array_join(F.slice(F.col("__s.pieces"), piece(s["start"]) + 1, piece(s["start"] + s["length"]) - piece(s["start"]) + 1), "")
    learned = F.transform("loss_spans", lambda s: unescape(F.substring(touched(s), s["start"] % PIECE + 1, s["length"])))
    return rows.select(*formatted.columns, once(F.struct(turns.alias("turns"), learned.alias("learned"))).alias("__r")).select(*formatted.columns, "__r.turns", "__r.learned")
