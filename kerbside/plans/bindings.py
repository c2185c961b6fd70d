"""The driver's tables as inputs of the operators, in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register a query, with SQL for the same rows where there is some."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded(df: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})


def status() -> Column:
    """A line item's status as a listing."""
    return F.when(F.col("l_returnflag") == "A", "Certified").when(F.col("l_returnflag") == "N", "New").otherwise("Used").alias("status")


def mileage() -> Column:
    return F.when(F.col("l_returnflag") != "N", (F.col("l_quantity") * 1000).cast("int")).alias("mileage")


def model() -> Column:
    return F.concat_ws(" ", "p_type", "p_name").alias("model")


def listings(spark: SparkSession, sf: str) -> DataFrame:
    """One listing for each line item. Every line has its order and part."""
    line = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus", "l_shipdate")
    part = table(spark, sf, "part").select("p_partkey", "p_brand", "p_type", "p_name", "p_retailprice")
    order = table(spark, sf, "orders").select("o_orderkey", F.year("o_orderdate").alias("o_year"))
    c = F.col
    # The parts come last, so that their texts are not shuffled with the lines.
    return line.join(order, c("l_orderkey") == c("o_orderkey")).join(part, c("l_partkey") == c("p_partkey")).select(
        F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("row_id"), c("p_brand").alias("make"), model(), c("p_type").alias("body"),
        c("o_year").alias("year"), status(),
        mileage(), c("l_extendedprice").alias("price"), (c("l_quantity") * c("p_retailprice")).alias("prediction"),
        c("l_shipdate").cast("date").alias("sold_on"), c("l_orderkey").alias("private_key"), c("l_suppkey").alias("seller"), c("l_linestatus").alias("source"), F.pmod("l_orderkey", F.lit(5)).cast("int").alias("fold"),
    )


LISTINGS = """listings AS (
  SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS row_id, p_brand AS make, p_type || ' ' || p_name AS model, p_type AS body,
    CAST(year(o_orderdate) AS INTEGER) AS year, CASE l_returnflag WHEN 'A' THEN 'Certified' WHEN 'N' THEN 'New' ELSE 'Used' END AS status,
    CASE WHEN l_returnflag <> 'N' THEN CAST(l_quantity * 1000 AS INTEGER) END AS mileage, l_extendedprice AS price, l_quantity * p_retailprice AS prediction,
    CAST(l_shipdate AS DATE) AS sold_on, l_orderkey AS private_key, l_suppkey AS seller, l_linestatus AS source, CAST(l_orderkey % 5 AS INTEGER) AS fold,
    l_extendedprice AS y, l_quantity * p_retailprice AS p, abs(l_quantity * p_retailprice - l_extendedprice) AS score
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey)"""


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Listings with ``y``, ``p`` and ``score`` (the absolute error)."""
    rows = listings(spark, sf).withColumn("y", F.col("price")).withColumn("p", F.col("prediction"))
    return rows.withColumn("score", F.abs(F.col("p") - F.col("y")))


def raw_listings(spark: SparkSession, sf: str) -> DataFrame:
    """Listings as text, one in 17 of each kind of mistake."""
    c, k = F.col, F.pmod(F.col("l_orderkey") + F.col("l_linenumber") * 3, F.lit(17))
    broken = lambda n, bad, good: F.when(F.col("k") == n, F.lit(bad)).otherwise(good)
    line = table(spark, sf, "lineitem").withColumn("k", k)
    return line.select(
        F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("row_id"), c("k").cast("int").alias("k"), c("l_orderkey").alias("private_key"),
        broken(1, "", F.concat(F.lit("Make#"), F.pmod("l_suppkey", F.lit(25)).cast("string"))).alias("brand"), broken(2, "=cmd()", F.concat(F.lit("Model "), F.pmod("l_partkey", F.lit(100)).cast("string"))).alias("model"),
        broken(3, "20x1", F.year("l_shipdate").cast("string")).alias("year"), broken(4, "Unknown", F.when(c("l_returnflag") == "A", "Certified").when(c("l_returnflag") == "N", "New").otherwise("Used")).alias("status"),
        broken(5, "-5", F.when(c("l_returnflag") == "N", "").otherwise(F.concat((c("l_quantity") * 1000).cast("long").cast("string"), F.lit(".0")))).alias("mileage"),
        broken(6, "0", F.when(c("k") == 7, "12.345").otherwise(c("l_extendedprice").cast("decimal(18,2)").cast("string"))).alias("price"),
        F.get(F.array(*[F.lit(s) for s in ("CA", "TX", "ca", "ON", "NY1")]), F.pmod("k", F.lit(5)).cast("int")).alias("state"), (c("l_orderkey") * 8 + c("l_linenumber")).alias("number"),
    )


RAW = """raw AS (
  SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS row_id, CAST((l_orderkey + l_linenumber * 3) % 17 AS INTEGER) AS k, l_orderkey AS private_key,
    CASE WHEN (l_orderkey + l_linenumber * 3) % 17 = 1 THEN '' ELSE 'Make#' || (l_suppkey % 25) END AS brand,
    CASE WHEN (l_orderkey + l_linenumber * 3) % 17 = 2 THEN '=cmd()' ELSE 'Model ' || (l_partkey % 100) END AS model,
    CASE WHEN (l_orderkey + l_linenumber * 3) % 17 = 3 THEN '20x1' ELSE CAST(year(l_shipdate) AS VARCHAR) END AS year,
    CASE WHEN (l_orderkey + l_linenumber * 3) % 17 = 4 THEN 'Unknown' WHEN l_returnflag = 'A' THEN 'Certified' WHEN l_returnflag = 'N' THEN 'New' ELSE 'Used' END AS status,
    CASE WHEN (l_orderkey + l_linenumber * 3) % 17 = 5 THEN '-5' WHEN l_returnflag = 'N' THEN '' ELSE CAST(CAST(l_quantity * 1000 AS BIGINT) AS VARCHAR) || '.0' END AS mileage,
    CASE WHEN (l_orderkey + l_linenumber * 3) % 17 = 6 THEN '0' WHEN (l_orderkey + l_linenumber * 3) % 17 = 7 THEN '12.345' ELSE CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) END AS price,
    ['CA', 'TX', 'ca', 'ON', 'NY1'][CAST((l_orderkey + l_linenumber * 3) % 17 % 5 + 1 AS INTEGER)] AS state, l_orderkey * 8 + l_linenumber AS number
  FROM lineitem)"""


def reason_rules() -> list[tuple[str, Column]]:
    """The retail order of rejection reasons over raw listings."""
    from kerbside.functions import scalars as S

    c = F.col
    return [
        ("status_invalid", ~c("status").isin("New", "Used", "Certified")), ("brand_missing", S.text_reason(c("brand"), 100).isNotNull()), ("model_missing", S.text_reason(c("model"), 200).isNotNull()),
        ("year_invalid", ~F.coalesce(S.integral(c("year")).between(1886, 2025), F.lit(False))), ("mileage_invalid", ~S.is_missing(c("mileage")) & S.integral(c("mileage")).isNull()), ("price_invalid", S.decimal_cents(c("price")).isNull()),
    ]


JUDGED = RAW + """, judged AS (SELECT *, CASE WHEN k = 4 THEN 'status_invalid' WHEN k = 1 THEN 'brand_missing' WHEN k = 3 THEN 'year_invalid' WHEN k = 5 THEN 'mileage_invalid'
  WHEN k IN (6, 7) THEN 'price_invalid' END AS reason_code FROM raw)"""
