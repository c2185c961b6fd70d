"""Publishing accepted and quarantined rows with a manifest, and verifying what was published."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.operators.integrity import table_fingerprint


def _manifest(accepted: DataFrame, rejected: DataFrame) -> DataFrame:
    parts = [table_fingerprint(df).select(F.lit(name).alias("part"), "*") for name, df in (("accepted", accepted), ("rejected", rejected))]
    return parts[0].unionByName(parts[1])


def publish(accepted: DataFrame, rejected: DataFrame, path: str) -> None:
    """SNK-1: both tables, and the manifest last: readers that find none take the set as unfinished."""
    spark = accepted.sparkSession
    for name, df in (("accepted", accepted), ("rejected", rejected)):
        df.write.mode("errorifexists").parquet(f"{path}/{name}")
    _manifest(spark.read.parquet(f"{path}/accepted"), spark.read.parquet(f"{path}/rejected")).write.mode("errorifexists").parquet(f"{path}/manifest")


def verify_published(spark: SparkSession, path: str) -> DataFrame:
    """SNK-2: ``part, n, ok``: the tables' fingerprints against the manifest's."""
    now = _manifest(spark.read.parquet(f"{path}/accepted"), spark.read.parquet(f"{path}/rejected"))
    said = spark.read.parquet(f"{path}/manifest").select("part", F.struct("n", "sum", "xor").alias("__said"))
    return now.join(said, "part", "left").select("part", "n", F.struct("n", "sum", "xor").eqNullSafe(F.col("__said")).alias("ok"))
