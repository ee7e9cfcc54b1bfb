"""Registration of named queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, so that sums in another order compare equal."""
    return df.select(*(F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def holes(spark: SparkSession, d: str) -> DataFrame:
    """lineitem with nulls put into quantity, discount and return flag."""
    return table(spark, d, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        F.when(F.col("l_linenumber") != 3, F.col("l_quantity")).alias("q"),
        F.when(F.col("l_partkey") % 5 != 0, F.col("l_discount")).alias("d"),
        F.when(F.col("l_orderkey") % 7 != 0, F.col("l_returnflag")).alias("f"),
        "l_linestatus",
    )


HOLES = """(SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber <> 3 THEN l_quantity END AS q,
  CASE WHEN l_partkey % 5 <> 0 THEN l_discount END AS d, CASE WHEN l_orderkey % 7 <> 0 THEN l_returnflag END AS f, l_linestatus FROM lineitem)"""
