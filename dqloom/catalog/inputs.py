"""Test tables, and the same tables with known dirt.

The driver's tables are clean, so rules and text checks would pass trivially. Each
`DIRTY_*` map rewrites some cells of every row range by plain SQL expressions that
both engines read the same way. No row is dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


DIRTY_CUSTOMER = {
    "c_custkey": "c_custkey",
    "c_name": "CASE WHEN c_custkey % 97 = 0 THEN '' WHEN c_custkey % 89 = 0 THEN '   ' "
              "WHEN c_custkey % 83 = 0 THEN NULL WHEN c_custkey % 79 = 0 THEN '  ' || c_name || ' ' "
              "WHEN c_custkey % 31 = 0 THEN 'Customer#000000001' ELSE c_name END",
    "c_email": "CASE WHEN c_custkey % 53 = 0 THEN 'bad-email' WHEN c_custkey % 59 = 0 THEN NULL "
               "WHEN c_custkey % 47 = 0 THEN ' ' "
               "ELSE 'user' || CAST(c_custkey AS VARCHAR(20)) || '@example.com' END",
    "c_phone": "CASE WHEN c_custkey % 7 = 0 THEN '0' || CAST(c_custkey AS VARCHAR(20)) "
               "ELSE '+1 (555) ' || CAST(c_custkey % 900 + 100 AS VARCHAR(20)) || '-' "
               "|| CAST(c_custkey % 9000 + 1000 AS VARCHAR(20)) END",
    "c_mktsegment": "CASE WHEN c_custkey % 61 = 0 THEN lower(c_mktsegment) "
                    "WHEN c_custkey % 67 = 0 THEN 'N/A' WHEN c_custkey % 71 = 0 THEN '-' "
                    "WHEN c_custkey % 73 = 0 THEN ' unknown ' ELSE c_mktsegment END",
    "c_nationkey": "CASE WHEN c_custkey % 73 = 0 THEN c_nationkey + 100 "
                   "WHEN c_custkey % 101 = 0 THEN NULL ELSE c_nationkey END",
    "c_acctbal": "CASE WHEN c_custkey % 103 = 0 THEN NULL WHEN c_custkey % 19 = 0 THEN -9999.0 "
                 "ELSE c_acctbal END",
    "c_rating": "CASE WHEN c_custkey % 113 = 0 THEN 'abc' WHEN c_custkey % 29 = 0 THEN NULL "
                "ELSE CAST(c_custkey % 50 AS VARCHAR(20)) END",
    "c_since": "CASE WHEN c_custkey % 109 = 0 THEN '2024-04-31' WHEN c_custkey % 37 = 0 THEN NULL "
               "ELSE CAST(2000 + c_custkey % 20 AS VARCHAR(20)) || '-' "
               "|| lpad(CAST(1 + c_custkey % 12 AS VARCHAR(20)), 2, '0') || '-' "
               "|| lpad(CAST(1 + c_custkey % 28 AS VARCHAR(20)), 2, '0') END",
    "c_renewal": "lpad(CAST(1 + c_custkey % 28 AS VARCHAR(20)), 2, '0') || '/' "
                 "|| lpad(CAST(1 + c_custkey % 12 AS VARCHAR(20)), 2, '0') || '/' "
                 "|| CAST(2005 + c_custkey % 25 AS VARCHAR(20))",
}

DIRTY_ORDERS = {
    "o_orderkey": "o_orderkey",
    "o_custkey": "CASE WHEN o_orderkey % 211 = 0 THEN o_custkey + 10000000 "
                 "WHEN o_orderkey % 223 = 0 THEN NULL ELSE o_custkey END",
    "o_orderstatus": "CASE WHEN o_orderkey % 101 = 0 THEN 'X' WHEN o_orderkey % 103 = 0 THEN ' f' "
                     "WHEN o_orderkey % 107 = 0 THEN NULL ELSE o_orderstatus END",
    "o_totalprice": "CASE WHEN o_orderkey % 127 = 0 THEN NULL WHEN o_orderkey % 131 = 0 "
                    "THEN -o_totalprice ELSE o_totalprice END",
    "o_orderdate": "o_orderdate",
    "o_shipdate": "CASE WHEN o_orderkey % 41 = 0 THEN o_orderdate - INTERVAL '3' DAY "
                  "WHEN o_orderkey % 43 = 0 THEN NULL ELSE o_orderdate + INTERVAL '5' DAY END",
    "o_orderpriority": "o_orderpriority",
    "o_urgent": "CASE WHEN o_orderkey % 149 = 0 THEN 'maybe' WHEN o_orderpriority = '1-URGENT' "
                "THEN 'Yes' ELSE 'no' END",
}

DIRTY_LINEITEM = {
    "l_orderkey": "l_orderkey",
    "l_partkey": "l_partkey",
    "l_linenumber": "l_linenumber",
    "l_quantity": "CASE WHEN l_partkey % 157 = 0 THEN NULL ELSE l_quantity END",
    "l_price": "CASE WHEN l_partkey % 163 = 0 THEN NULL ELSE 2.0 END",
    "l_amount": "CASE WHEN l_partkey % 167 = 0 THEN l_quantity * 2.0 + 7.5 ELSE l_quantity * 2.0 END",
    "l_discount": "CASE WHEN l_orderkey % 151 = 0 THEN NULL ELSE l_discount END",
    "l_returnflag": "CASE WHEN l_orderkey % 151 = 0 THEN NULL WHEN l_orderkey % 173 = 0 THEN NULL "
                    "ELSE l_returnflag END",
    "l_linestatus": "CASE WHEN l_orderkey % 173 = 0 THEN NULL ELSE l_linestatus END",
}

# The same part twice as often as the rest in a later version of the table.
DIRTY_PART = {
    "p_partkey": "p_partkey",
    "p_brand": "p_brand",
    "p_type": "p_type",
    "p_group": "CASE WHEN p_partkey % 997 = 0 THEN 'other' ELSE 'group ' || p_type END",
    "p_size": "p_size",
}

DIRTY = {
    "customer": DIRTY_CUSTOMER, "orders": DIRTY_ORDERS, "lineitem": DIRTY_LINEITEM,
    "part": DIRTY_PART,
}


def dirty(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    columns = [F.expr(expression).alias(c) for c, expression in DIRTY[name].items()]
    return table(spark, sf_dir, name).select(*columns)


def dirty_sql(*names: str) -> str:
    """WITH items `dirty_<table>` for the other engine."""
    parts = []
    for name in names:
        columns = ", ".join(f"{e} AS {c}" for c, e in DIRTY[name].items())
        parts.append(f"dirty_{name} AS (SELECT {columns} FROM {name})")
    return ", ".join(parts)


def tall_sql(source: str, columns: list[str], cast: str | None = None) -> str:
    """(column_name, value) rows of the non-null cells of some columns."""
    def cell(c: str) -> str:
        return f"CAST({c} AS {cast})" if cast else c

    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, {cell(c)} AS value FROM {source} WHERE {c} IS NOT NULL"
        for c in columns
    )
