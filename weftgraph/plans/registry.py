"""Where queries and their SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
NONTERMINALS = ["R"]

#: order_graph in SQL.
ORDERS = """
n AS (SELECT l_orderkey AS g, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS i, l_returnflag AS lab FROM lineitem),
e AS (SELECT a.g, a.i AS src, b.i AS dst, a.lab AS sl, b.lab AS dl FROM n a JOIN n b ON a.g = b.g AND (b.i = a.i + 1 OR b.i = a.i + 2 AND a.lab = b.lab))
"""


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = lambda spark, sf_dir: _plain(f(spark, sf_dir))
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _plain(df: DataFrame) -> DataFrame:
    """Integers as BIGINT, as in the SQL."""
    return df.select(*[F.col(f.name).cast("long").alias(f.name) if f.dataType.simpleString() in ("int", "smallint", "tinyint") else F.col(f.name) for f in df.schema])
