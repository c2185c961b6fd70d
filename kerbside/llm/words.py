"""Words and other native text expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space that separates words: space and U+0009 to U+000D.
SPACE = " \t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text as an array; null and blank texts give an empty array."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+"))


def n_words(text: Column) -> Column:
    """The number of words, as a long."""
    return F.size(words(text)).cast("long")


def once(value: Column) -> Column:
    """A value that is computed once for a row, whatever reads it: no expression or filter moves through an explode."""
    return F.explode(F.array(value))
