"""SRC-19: table scans: the shared tables, and the grant facts that queries stand on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


#: Schemas by application and path, so that a table's footers are read for it once and not for each query.
_SCHEMAS: dict[tuple[str, str], StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A shared table.  Files are listed anew each time; the schema of a path is taken to stay as it is while the application runs."""
    path = f"{sf_dir}/{name}.parquet"
    key = (spark.sparkContext.applicationId, path)
    if key not in _SCHEMAS:
        _SCHEMAS[key] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[key]).parquet(path)


def grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order line: funder (supplier), recipient (customer), program (part), amount, fiscal year."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        F.col("l_suppkey").alias("funder_id"), F.col("o_custkey").alias("recipient_id"), F.col("l_partkey").alias("program_id"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("amount"), F.year("o_orderdate").alias("fy"), F.col("o_orderdate").cast("date").alias("event_date"),
        F.col("l_returnflag").alias("flag"), F.col("o_orderstatus").alias("status"), F.col("l_orderkey").alias("filing_id"), F.col("l_linenumber").alias("line_no"),
    )


#: The same facts for an oracle: a common table expression to start with.
GRANTS_SQL = """WITH grants AS (
  SELECT l_suppkey AS funder_id, o_custkey AS recipient_id, l_partkey AS program_id, CAST(l_extendedprice AS DECIMAL(18,2)) AS amount,
         CAST(year(o_orderdate) AS INT) AS fy, CAST(o_orderdate AS DATE) AS event_date, l_returnflag AS flag, o_orderstatus AS status,
         l_orderkey AS filing_id, l_linenumber AS line_no
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
"""
