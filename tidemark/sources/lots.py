"""Lot sources: hive-partitioned Parquet, and a view of lots over the supplied star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import schemas


def read_lots(spark: SparkSession, root: str, start: str | None = None, end: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """Lots of a hive-partitioned folder (year=/month=); a date range prunes partitions as well as rows.

    trade_date is stored as yyyy.MM.dd; empty strings of nullable columns read as null.
    """
    keys = [T.StructField("year", T.IntegerType()), T.StructField("month", T.IntegerType())]
    df = spark.read.schema(T.StructType([*schemas.LOTS.fields, *keys])).parquet(root)
    df = within(df, start, end)
    day = F.to_date("trade_date", "yyyy.MM.dd")
    nullable = ["state", "origin", "spec", "packaging"]
    df = df.withColumns({"trade_date": day} | {c: F.nullif(c, F.lit("")) for c in nullable})
    return df.select(*columns) if columns else df


def within(df: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """Bounds on trade_date with the bounds on year and month that follow from them, so folders are pruned."""
    for bound, op in ((start, "__ge__"), (end, "__le__")):
        if bound:
            y, m, _ = bound.split("-")
            month = getattr(F.col("month"), op)(int(m))
            beyond = F.col("year") > int(y) if op == "__ge__" else F.col("year") < int(y)
            df = df.where(beyond | ((F.col("year") == int(y)) & month)).where(getattr(F.col("trade_date"), op)(bound.replace("-", ".")))
    return df


def star_lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lots over lineitem, part, supplier and nation; the dimensions join as Spark's size statistics decide."""
    read = lambda t, *c: spark.read.parquet(f"{sf_dir}/{t}.parquet").select(*c)
    item = read("lineitem", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_shipdate")
    dims = read("supplier", "s_suppkey", "s_nationkey").join(read("nation", "n_nationkey", "n_name"), F.col("s_nationkey") == F.col("n_nationkey"))
    avg = F.round(F.col("l_extendedprice") / F.col("l_quantity")).cast("long")
    lots = item.join(read("part", "p_partkey", "p_brand", "p_type", "p_size"), F.col("l_partkey") == F.col("p_partkey")).join(dims, F.col("l_suppkey") == F.col("s_suppkey"))
    lots = lots.withColumn("price_avg", avg)
    return lots.select(
        F.to_date("l_shipdate").alias("trade_date"), F.col("p_brand").alias("species"), F.nullif("l_returnflag", F.lit("N")).alias("state"),
        F.col("n_name").alias("origin"), F.concat(F.col("p_size").cast("string"), F.lit("미")).alias("spec"), F.col("p_type").alias("packaging"),
        F.col("l_quantity").alias("quantity"), (F.col("price_avg") + F.floor(F.col("price_avg") * F.col("l_discount"))).cast("long").alias("price_high"),
        (F.col("price_avg") - F.floor(F.col("price_avg") * F.col("l_tax"))).cast("long").alias("price_low"), "price_avg")


#: The same lots in SQL, as the head of every check query.
LOTS_SQL = """lots AS (
  SELECT CAST(l_shipdate AS DATE) AS trade_date, p_brand AS species, nullif(l_returnflag, 'N') AS state, n_name AS origin,
         CAST(p_size AS VARCHAR) || '미' AS spec, p_type AS packaging, l_quantity AS quantity,
         CAST(price_avg + floor(price_avg * l_discount) AS BIGINT) AS price_high, CAST(price_avg - floor(price_avg * l_tax) AS BIGINT) AS price_low, price_avg
  FROM (SELECT *, CAST(round(l_extendedprice / l_quantity) AS BIGINT) AS price_avg FROM lineitem)
  JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)"""
