"""Line deduplication over levelled sorted runs of line hashes.

Documents are taken in batches, largest ids first. A batch's line hashes are one sorted run: distinct, bucketed by
hash, with the number of documents that hold each. Anti-joined with the runs of the batches before, it gives the
hashes that are new, and with them the document that keeps the line, the largest id of all; then it is added
to the runs itself. Whenever a level has ``FAN_OUT`` runs they are merged into one of the next level, so a hash is
rewritten once a level. Runs and batches are bucketed alike, so that no anti-join shuffles a run; merging runs does.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.llm.words import SPACE
from kerbside.staging import fresh_dir, written

#: Batches that documents are taken in, and runs of a level that are merged into one.
BATCHES, FAN_OUT = 6, 3
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HASH = ["h1", "h2"]


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends and with A-Z in lower case."""
    bare = F.btrim(line, F.lit(SPACE))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def text_lines(text: Column) -> Column:
    """The lines of a text; null and empty texts are one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


class LineRuns:
    """An index of line hashes in levels of sorted runs (tables bucketed and sorted by hash, in the shared folder).

    A run has ``h1``, ``h2`` and ``n``, the documents that hold the line. The number of buckets is the session's number of
    shuffle partitions, so an aggregate by hash is dealt as the runs are.
    """

    def __init__(self, spark: SparkSession, fan_out: int = FAN_OUT):
        self.spark, self.fan_out = spark, fan_out
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.tables: list[str] = []
        self.paths: dict[str, str] = {}

    def sorted_run(self, rows: DataFrame) -> str:
        """Write rows as a table bucketed and sorted by hash; its name."""
        name = f"kerbside_run_{uuid.uuid4().hex}"
        self.paths[name] = fresh_dir(self.spark, "line-run")
        rows.write.bucketBy(self.buckets, *HASH).sortBy(*HASH).option("path", self.paths[name]).saveAsTable(name)
        self.tables.append(name)
        return name

    def unseen(self, run: str) -> DataFrame:
        """The rows of a run whose hash is in no run of the index: a merge-anti-join with each."""
        rows = self.spark.table(run)
        for name in (name for level in self.levels for name in level):
            rows = rows.join(self.spark.table(name).select(*HASH).hint("merge"), HASH, "left_anti")
        return rows

    def add(self, run: str) -> None:
        """Add a run at the lowest level, and merge every level that is full into the next."""
        level = 0
        while True:
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(run)
            if len(self.levels[level]) < self.fan_out:
                return
            run = self.sorted_run(self.merged(self.levels[level]))
            self.levels[level] = []
            level += 1

    def merged(self, names: list[str]) -> DataFrame:
        # Read as files, not as buckets: a union of bucketed scans is not trusted to be dealt by hash.
        rows = self.spark.read.schema("h1 long, h2 long, n long").parquet(*[self.paths[name] for name in names])
        return rows.groupBy(*HASH).agg(F.sum("n").alias("n"))

    def totals(self) -> DataFrame:
        """Every hash with the number of documents of all batches that hold it."""
        return self.merged([name for level in self.levels for name in level])

    def forget(self) -> None:
        """Drop the catalog's entries; the files stay until the shared folder is cleared."""
        for name in self.tables:
            self.spark.sql(f"DROP TABLE {name}")
        self.tables = []


def long_lines(docs: DataFrame, id_col: str, text_col: str, least_chars: int) -> DataFrame:
    """``doc_id``, ``text_key``, ``h1``, ``h2``, ``pos`` for every line whose key has ``least_chars`` code points or more."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("__text"))
    lines = rows.select("doc_id", F.xxhash64("__text").alias("text_key"), F.posexplode(text_lines(F.col("__text"))).alias("pos", "line"))
    keys = lines.select("doc_id", "text_key", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= least_chars)
    return keys.select("doc_id", "text_key", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "pos")


def dedup_lines(docs: DataFrame, least_chars: int = 20, least_docs: int = 3, batches: int = BATCHES, fan_out: int = FAN_OUT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_lines``, ``n_dropped`` and ``kept_text`` for every row of ``docs``.

    A line's key is the line without ASCII white space at its ends and with A-Z in lower case. Keys of ``least_chars`` code
    points that at least ``least_docs`` documents hold lose all their lines but those in the largest id that holds them;
    the other lines stay, joined by a line end. A document is an id: rows that share one count once and keep or
    lose their lines together; rows without an id are one document, before all others. Null and empty texts are one empty line.
    Keys are compared by 128 bits of hash. Other columns are not looked at; an empty table gives no rows. A text
    must fit a task's memory; a line's copies never meet in one task. Batches are cut by id at approximate
    quantiles, which decide their sizes only, not the result.
    """
    spark = docs.sparkSession
    cuts = docs.agg(F.percentile_approx(F.col(id_col).cast("long"), [k / batches for k in range(1, batches)], 1000)).first()[0] or []
    batch = sum((F.coalesce(F.col("doc_id") <= cut, F.lit(True)).cast("int") for cut in sorted(set(cuts))), F.lit(0))
    path = fresh_dir(spark, "line-hashes")
    long_lines(docs, id_col, text_col, least_chars).withColumn("batch", batch).write.partitionBy("batch").parquet(path)
    lines = spark.read.schema("doc_id long, text_key long, h1 long, h2 long, pos int, batch int").parquet(path)

    runs = LineRuns(spark, fan_out)
    keepers = []
    for k in range(len(set(cuts)) + 1):  # 0: the largest ids
        some = lines.where(F.col("batch") == k).groupBy(*HASH, "doc_id").agg(F.lit(1).alias("one"))
        run = runs.sorted_run(some.groupBy(*HASH).agg(F.count("one").alias("n"), F.max("doc_id").alias("keeper")))
        keepers.append(runs.sorted_run(runs.unseen(run).select(*HASH, "keeper")))
        runs.add(run)
    often = runs.totals().where(F.col("n") >= least_docs)
    kept_by = None
    for name in keepers:
        found = often.join(spark.table(name), HASH).select(*HASH, "keeper")
        kept_by = found if kept_by is None else kept_by.unionByName(found)
    repeated = written(kept_by, "line-keepers")
    runs.forget()

    lost = lines.join(repeated, HASH).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    places = written(lost.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set("pos")).alias("lost")), "line-places")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.xxhash64(F.col(text_col).cast("string")).alias("text_key"))
    mine = places.select(F.col("doc_id").alias("of"), F.col("text_key").alias("key"), "lost")
    joined = rows.join(mine, rows["doc_id"].eqNullSafe(mine["of"]) & (rows["text_key"] == mine["key"]), "left").select("doc_id", "text", F.coalesce("lost", F.array().cast("array<int>")).alias("lost"))
    split = joined.select("doc_id", "lost", "text", text_lines(F.col("text")).alias("lines"))
    # The lines that stay are runs between lost ones.
    edges = F.concat(F.array(F.lit(-1)), F.col("lost"), F.array(F.size("lines")))
    between = split.select("doc_id", "lost", "text", "lines", edges.alias("edges"))
    stay = F.transform(F.sequence(F.lit(1), F.size("edges") - 1), lambda k: F.slice("lines", F.get("edges", k - 1) + 2, F.get("edges", k) - F.get("edges", k - 1) - 1))
    kept = F.when(F.size("lost") == 0, F.col("text")).otherwise(F.array_join(F.flatten(stay), "\n"))
    return between.select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.size("lost").cast("long").alias("n_dropped"), kept.alias("kept_text"))
