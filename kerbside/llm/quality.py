"""Quality rules with risk-controlled cutoffs, in DataFrame functions only.

Five signals of a text are compared with cutoffs. The cutoffs come from labelled documents: the grids of
all signals are walked together, from the mildest step on, and a document is rejected at a step if any of
its signals reaches that step's cutoff. For each stratum the most severe step is taken for which an exact
binomial test shows that it rejects at most the allowed rate of good documents. The level of a test is
corrected for the number of strata (Bonferroni); along the steps the tests stop at the first that fails
(fixed sequence), which needs no further correction. So with a chance of at least ``1 - delta`` no
stratum's rules reject more than ``alpha`` of its good documents. A stratum whose labels are too few to
show it gets no rule: with four strata about 217 good labels are needed, none of them rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.llm.words import once, words
from kerbside.staging import broadcast_if_small, written

#: Signal name to the grid of cutoffs; a document is rejected if its signal is at least the cutoff.
GRIDS = {
    "symbol_rate": [k / 20 for k in range(1, 21)],
    "dup_line_share": [k / 20 for k in range(1, 21)],
    "repeat_share": [k / 40 for k in range(1, 21)],
    "capital_share": [k / 20 for k in range(1, 21)],
    "bar_rate": [k / 20 for k in range(1, 21)],
}
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def with_signals(docs: DataFrame, *keep: Column, text_col: str = "text") -> DataFrame:
    """The columns ``keep`` of ``docs`` and a struct ``__q`` with the base counts and the signals of each whole text.

    Null and empty texts count 0 everywhere. ``n_repeat_words`` counts the words inside 3-word windows that
    occur twice or more in the text: windows are ordered by their 64-bit hash, those beside an equal one
    are repeats, and the lengths their positions cover are summed up. All of it stays within a row; only
    the hash of a window is compared.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(*keep, text.alias("__text"), once(words(text)).alias("__words"))
    kept = [c for c in rows.columns if c not in ("__text", "__words")]
    w, n = F.col("__words"), F.size("__words")
    starts = F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
    windows = F.sort_array(F.transform(starts, lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i"))))
    rows = rows.select(*kept, "__text", w, once(windows).alias("__windows"))
    s = F.col("__windows")
    repeats = F.filter(s, lambda e, i: F.equal_null(F.get(s, i - 1)["h"], e["h"]) | F.equal_null(F.get(s, i + 1)["h"], e["h"]))
    at = F.sort_array(F.transform(repeats, lambda e: e["i"]))
    # A repeat covers three words from its position, less what the next one covers too.
    covered = F.aggregate(at, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), lambda a, x: F.struct((a["n"] + F.least(F.lit(3), x - a["last"])).alias("n"), x.alias("last")), lambda a: a["n"])
    lines = F.filter(F.split("__text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    counts = F.struct(
        n.cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        (F.length("__text") - F.length(F.regexp_replace("__text", "[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"), covered.cast("long").alias("n_repeat_words"), F.size(F.filter(w, lambda x: x == "|")).alias("bars"),
        F.length(F.regexp_replace("__text", "[^\\p{Lu}]+", "")).alias("capitals"),
    )
    c = F.col("__counts")
    counted = rows.select(*kept, once(counts).alias("__counts")).select(*kept, c, F.size(c["lines"]).alias("__lines"), (F.size(c["lines"]) - F.size(F.array_distinct(c["lines"]))).cast("long").alias("n_dup_lines"))
    per = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    signals = [
        per(c["n_symbols"], c["n_words"]).alias("symbol_rate"), per(F.col("n_dup_lines"), F.col("__lines")).alias("dup_line_share"),
        per(c["n_repeat_words"], c["n_words"]).alias("repeat_share"), per(c["capitals"], c["word_chars"]).alias("capital_share"), per(c["bars"], c["n_words"]).alias("bar_rate"),
    ]
    base = [F.col(name) if name == "n_dup_lines" else c[name].alias(name) for name in BASE]
    return counted.select(*kept, once(F.struct(*base, *signals)).alias("__q"))


def base_failed(q: Column) -> Column:
    """Fewer than 50 words, or more than half of them in repeated windows."""
    return (q["n_words"] < 50) | (100 * q["n_repeat_words"] > 50 * q["n_words"])


def log_gamma(x: Column) -> Column:
    """The logarithm of the gamma function for x >= 1 (shifted by 8, then Stirling's series)."""
    z = x + 8
    shift = F.log(x)
    for k in range(1, 8):
        shift = shift + F.log(x + k)
    z2 = z * z
    return (z - 0.5) * F.log(z) - z + 0.9189385332046727 + (1 / 12 - (1 / 360 - (1 / 1260 - 1 / (1680 * z2)) / z2) / z2) / z - shift


def binomial_tail(x: Column, n: Column, p: float) -> Column:
    """P(at most x of n) for chance ``p``, if x <= n p; 1 above it. Terms beyond double precision are left out."""
    n_, x_ = n.cast("double"), x.cast("double")
    first = F.exp(log_gamma(n_ + 1) - log_gamma(x_ + 1) - log_gamma(n_ - x_ + 1) + x_ * F.log(F.lit(p)) + (n_ - x_) * F.log(F.lit(1 - p)))
    # Downwards from x each term is the one before times k (1-p) / ((n-k+1) p), which is below 1 here.
    steps = F.sequence(F.lit(0), F.least(x, (60 * F.sqrt(n_) + 60).cast("long")).cast("int"))
    tail = F.aggregate(
        steps, F.struct(F.lit(0.0).alias("sum"), F.lit(1.0).alias("term")),
        lambda a, k: F.struct((a["sum"] + a["term"]).alias("sum"), (a["term"] * (x_ - k) * F.lit(1 - p) / ((n_ - x_ + k + 1) * F.lit(p))).alias("term")), lambda a: a["sum"],
    )
    return F.when(x_ > n_ * p, 1.0).otherwise(F.least(F.lit(1.0), first * tail))


def _level(name: str) -> Column:
    """How many cutoffs of its grid a signal reaches."""
    return F.size(F.filter(F.array(*[F.lit(c) for c in GRIDS[name]]), lambda c: F.col("__q")[name] >= c))


def _shown(binned: DataFrame, rate: float, delta: float) -> DataFrame:
    """The most severe level shown to reject at most ``rate``, by ``__stratum`` (null: none).

    ``binned`` has a row for each good document, with the highest ``level`` that one of its signals reaches.
    """
    counts = binned.groupBy("__stratum", "level").agg(F.count(F.lit(1)).alias("n"))
    by_level = counts.groupBy("__stratum").agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("level", "n"))).alias("at"))
    grid = F.explode(F.sequence(F.lit(1), F.lit(max(map(len, GRIDS.values()))))).alias("level")
    tests = by_level.select("__stratum", "n", "at", grid)
    rejected = F.aggregate(F.map_values(F.map_filter("at", lambda k, v: k >= F.col("level"))), F.lit(0).cast("long"), lambda a, v: a + v)
    strata = written(tests.select("__stratum", "level", "n", rejected.alias("x")), "quality-tests")
    number = strata.agg(F.count_distinct("__stratum").alias("s")).first()["s"]
    # A milder cutoff never rejects more, so whatever is shown at one level is shown at all milder ones.
    shown = binomial_tail(F.col("x"), F.col("n"), rate) <= delta / max(1, number)
    return strata.groupBy("__stratum").agg(F.min(F.when(shown, F.col("level"))).alias("level"))


def _cutoff(name: str) -> Column:
    return F.get(F.array(*[F.lit(c) for c in GRIDS[name]]), F.col("level") - 1)


def cutoffs(labelled: DataFrame, alpha: float = 0.02, delta: float = 0.05) -> DataFrame:
    """``__stratum`` and one cutoff for each signal (null: no rule) from labelled signals, all of one step of the grids.

    ``labelled`` has ``__stratum`` (never null), ``__q`` and ``good`` (boolean). Documents that fail the base
    rules count neither way. Every label counts; groups hold one row for each grid point only.
    """
    steps = labelled.where(F.col("good") & ~base_failed(F.col("__q"))).select("__stratum", F.greatest(*map(_level, GRIDS)).alias("level"))
    return _shown(steps, alpha, delta).select("__stratum", *[_cutoff(name).alias(name) for name in GRIDS])


def stratum(column: Column) -> Column:
    """A stratum's name that is never null."""
    return F.concat(F.when(column.isNull(), "-").otherwise("="), F.coalesce(column.cast("string"), F.lit("")))


def fit_cutoffs(signals: DataFrame, labels: DataFrame, alpha: float = 0.02, delta: float = 0.05) -> DataFrame:
    """Written cutoffs from ``signals`` (``doc_id``, ``__stratum``, ``__q``) and ``labels`` (``doc_id``, ``quality``).

    Labels whose quality is null are left out; documents without labels take no part.
    """
    known = labels.where(F.col("quality").isNotNull()).select(F.col("doc_id").alias("__doc"), (F.col("quality") == 1).alias("good"))
    return written(cutoffs(signals.join(known, F.col("doc_id") == F.col("__doc")), alpha, delta), "quality-cutoffs")


def verdicts(signals: DataFrame, fitted: DataFrame) -> DataFrame:
    """``signals`` with ``base_failed`` and ``kept``; a stratum without fitted cutoffs keeps what passes the base rules."""
    rules = fitted.select(F.col("__stratum").alias("__of"), F.struct(*GRIDS).alias("__cut"))
    joined = signals.join(broadcast_if_small(rules), F.col("__stratum") == F.col("__of"), "left").drop("__of")
    failed = base_failed(F.col("__q"))
    hit = F.lit(False)
    for name in GRIDS:
        hit = hit | F.coalesce(F.col("__q")[name] >= F.col("__cut")[name], F.lit(False))
    return joined.withColumn("base_failed", failed).withColumn("kept", ~failed & ~hit).drop("__cut")


def assess(docs: DataFrame, labels: DataFrame, alpha: float = 0.02, delta: float = 0.05) -> DataFrame:
    """``doc_id``, the base counts and signals, ``base_failed`` and ``kept`` for every row of ``docs``.

    Strata are languages; null is one of its own. Signals are computed once and written. Rows that
    repeat stay. Labels are for documents by ``doc_id``; an id with several labels counts with each.
    """
    signals = written(with_signals(docs, F.col("doc_id"), stratum(F.col("lang")).alias("__stratum")), "quality-signals")
    return verdicts(signals, fit_cutoffs(signals, labels, alpha, delta)).select("doc_id", "__q.*", "base_failed", "kept")


def keep_good(docs: DataFrame, labels: DataFrame, alpha: float = 0.02, delta: float = 0.05) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns; verdicts are those of :func:`assess`.

    Every text's signals are computed once: rows are written beside them, and fitting reads the signals only.
    No text is shuffled.
    """
    signals = written(with_signals(docs, F.struct("*").alias("__row"), F.col("doc_id"), stratum(F.col("lang")).alias("__stratum")), "quality-signals")
    fitted = fit_cutoffs(signals.select("doc_id", "__stratum", "__q"), labels, alpha, delta)
    return verdicts(signals, fitted).where("kept").select("__row.*")
