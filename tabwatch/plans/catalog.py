"""Registry of the test-table bindings: query name -> (Spark callable, DuckDB oracle SQL).

Each callable takes (spark, sf_dir) and returns a DataFrame built from the driver's tables.
Oracle SQL runs on the same parquet tables (views named like the tables).
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwatch.functions.columns import round_half_away

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        @functools.wraps(fn)
        def run(spark: SparkSession, sf: str) -> DataFrame:
            # Event times are timestamp_ntz; step / day arithmetic goes through the session time
            # zone, which the library fixes to UTC (as the stored data is UTC wall-clock time).
            if spark.conf.get("spark.sql.session.timeZone") != "UTC":
                spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf)

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def r6(c, digits: int = 6):
    """Round a double result for cross-engine comparison (last-bit differences), the way SQL
    ``round`` does on the binary value (see ``round_half_away``)."""
    return round_half_away(c, digits)


# lineitem with some NULLs made (the test data has none): l_tax is NULL when l_orderkey % 17 = 0
LI_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LI_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def lineitem_frame(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.withColumn("l_tax", F.when(F.col("l_orderkey") % 17 != 0, F.col("l_tax")))


LI_SQL = ("(SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, "
          "CASE WHEN l_orderkey % 17 = 0 THEN NULL ELSE l_tax END AS l_tax, l_returnflag, l_linestatus, "
          "l_shipdate FROM lineitem)")
TRAIN_CUT = "2000-01-01"
