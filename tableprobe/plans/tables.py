"""The driver tables, and views of them that the queries and their SQL share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXACT = 2  # decimals of the money and measure columns


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def gapped_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with nulls in four columns; the tables themselves have none."""
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") != "F", F.col("o_custkey")).alias("o_custkey"),
        F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("o_orderstatus"),
        F.when(F.col("o_totalprice") >= 50000, F.col("o_totalprice")).alias("o_totalprice"),
        "o_orderdate",
        F.nullif(F.col("o_orderpriority"), F.lit("1-URGENT")).alias("o_orderpriority"),
    )


GAPPED_ORDERS_SQL = """gapped AS (
    SELECT o_orderkey,
           CASE WHEN o_orderstatus <> 'F' THEN o_custkey END AS o_custkey,
           nullif(o_orderstatus, 'P') AS o_orderstatus,
           CASE WHEN o_totalprice >= 50000 THEN o_totalprice END AS o_totalprice,
           o_orderdate,
           nullif(o_orderpriority, '1-URGENT') AS o_orderpriority
    FROM orders)"""

# Column name -> Spark type, in schema order.
ORDERS_TYPES = {
    "o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double",
    "o_orderdate": "timestamp_ntz", "o_orderpriority": "string",
}
LINEITEM_TYPES = {
    "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int",
    "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double",
    "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp_ntz",
}
PART_TYPES = {
    "p_partkey": "bigint", "p_name": "string", "p_brand": "string", "p_type": "string", "p_size": "int",
    "p_retailprice": "double",
}
NUMERIC = ("bigint", "int", "double")


def exact_mean_sql(column: str) -> str:
    return f"sum({column}::DECIMAL(18,2))::DOUBLE / nullif(count({column}), 0)"
