"""Strict readers: declared schemas, bad rows kept and named, nothing inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt"


def read_strict_csv(spark: SparkSession, path: str, columns: list[str], encoding: str = "UTF-8") -> DataFrame:
    """SRC-1: all-text rows of a CSV with exactly this header; ``reason_code`` is ``row_width_invalid`` for a wrong number of fields.

    All fields are parsed, whichever are asked for (Spark wants one of them beside the reason). One file's header is checked at once, that of every other file when it is read: Spark fails there.
    UTF-16 cannot be split, so such files are read one task each and should be written as Parquet once.
    """
    first = spark.read.option("encoding", encoding).option("header", "false").option("multiLine", str(encoding.upper().startswith("UTF-16")).lower()).csv(path).limit(1).first()
    header = [x.lstrip("﻿").strip() for x in first if x is not None] if first else []
    if header != columns:
        raise ValueError(f"header is {header}, not {columns}")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*columns, CORRUPT]])
    rows = spark.read.schema(schema).option("encoding", encoding).option("header", "true").option("enforceSchema", "false").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).option("columnPruning", "false").option("multiLine", str(encoding.upper().startswith("UTF-16")).lower()).csv(path)
    return rows.withColumn("reason_code", F.when(F.col(CORRUPT).isNotNull(), "row_width_invalid")).drop(CORRUPT)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """SRC-2: JSON lines with nested fields, and ``reason_code``: ``blank_line``, ``json_invalid`` (no object of the schema), or ``columns_invalid`` (an empty or repeated name).

    Lines are read as text, so that none is passed over.
    """
    parsed = F.from_json("value", T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    names = F.json_object_keys("value")
    blank = F.trim("value") == ""
    rows = spark.read.text(path).select("value", F.when(~blank, parsed).alias("__r"), names.alias("__n"))
    bad = F.col("__r").isNull() | F.col(f"__r.{CORRUPT}").isNotNull() | F.col("__n").isNull()
    reason = F.when(F.trim("value") == "", "blank_line").when(bad, "json_invalid").when(F.array_contains("__n", "") | (F.size(F.array_distinct("__n")) < F.size("__n")), "columns_invalid")
    return rows.select(*[F.col(f"__r.`{f.name}`") for f in schema.fields], reason.alias("reason_code"))


def read_snapshots(spark: SparkSession, paths: list[str], schema: T.StructType) -> DataFrame:
    """SRC-3: Parquet snapshots of one schema with the name of the file or of its folder as ``snapshot``; a file with another type fails."""
    return spark.read.schema(schema).parquet(*paths).select("*", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.parquet(/[^/]*)?$", 1).alias("snapshot"))


def snapshot_counts(rows: DataFrame, expected: DataFrame) -> DataFrame:
    """SRC-3: ``snapshot, n, expected, ok`` against a table ``snapshot, expected``; a missing or extra file is not ok."""
    found = rows.groupBy("snapshot").agg(F.count(F.lit(1)).alias("n"))
    return found.join(expected, "snapshot", "full_outer").withColumn("ok", F.col("n").eqNullSafe(F.col("expected")))
