"""The driver's tables as a property graph: nodes (id, type, name, properties) and edges
(id, type, source_id, target_id, weight)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: type, table, id prefix, key, name and kind, as SQL that both engines read alike.
NODES = [
    ("Region", "region", "region:", "r_regionkey", "r_name", "NULL"),
    ("Nation", "nation", "nation:", "n_nationkey", "n_name", "NULL"),
    ("Customer", "customer", "customer:", "c_custkey", "c_name", "c_mktsegment"),
    ("Supplier", "supplier", "supplier:", "s_suppkey", "s_name", "NULL"),
    ("Part", "part", "part:", "p_partkey", "p_name", "p_brand"),
    ("Order", "orders", "order:", "o_orderkey", "o_orderpriority", "o_orderstatus"),
    ("User", "(SELECT DISTINCT user_id FROM events)", "user:", "user_id", "concat('User ', CAST(user_id AS STRING))", "NULL"),
    ("EventType", "(SELECT DISTINCT event_type FROM events)", "event:", "event_type", "event_type", "NULL"),
    ("Document", "documents", "document:", "doc_id", "source", "lang"),
    ("Page", "pages", "page:", "page_id", "url", "NULL"),
    ("Conversation", "(SELECT DISTINCT conv_id FROM conversations)", "conversation:", "conv_id", "concat('Conversation ', CAST(conv_id AS STRING))", "NULL"),
]
#: type, the ends' prefixes and columns, table.
EDGES = [
    ("DEFINES", "region:", "n_regionkey", "nation:", "n_nationkey", "nation"),
    ("DEFINES", "nation:", "c_nationkey", "customer:", "c_custkey", "customer"),
    ("DEFINES", "nation:", "s_nationkey", "supplier:", "s_suppkey", "supplier"),
    ("DEFINES", "customer:", "o_custkey", "order:", "o_orderkey", "orders"),
    ("CALLS", "order:", "l_orderkey", "part:", "l_partkey", "lineitem"),
    ("DEPENDS_ON", "part:", "l_partkey", "supplier:", "l_suppkey", "lineitem"),
    ("CALLS", "user:", "user_id", "event:", "event_type", "events"),
]


def _node_sql(kind: str, table: str, prefix: str, key: str, name: str, sub: str) -> str:
    return f"SELECT concat('{prefix}', CAST({key} AS STRING)) AS id, '{kind}' AS type, {name} AS name, CAST({sub} AS STRING) AS kind FROM {table}"


def _edge_sql(kind: str, a: str, ka: str, b: str, kb: str, table: str) -> str:
    return f"SELECT concat('{a}', CAST({ka} AS STRING), '->{kind}->{b}', CAST({kb} AS STRING)) AS id, '{kind}' AS type, concat('{a}', CAST({ka} AS STRING)) AS source_id, concat('{b}', CAST({kb} AS STRING)) AS target_id, CAST(count(*) AS BIGINT) AS weight FROM {table} GROUP BY {ka}, {kb}"


#: The same graph for the SQL side: ``WITH nodes AS (...), edges AS (...)`` without the WITH.
GRAPH_SQL = "nodes AS (" + " UNION ALL ".join(_node_sql(*x) for x in NODES).replace("STRING", "VARCHAR") + "),\nedges AS (" + " UNION ALL ".join(_edge_sql(*x) for x in EDGES).replace("STRING", "VARCHAR") + ")"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties are JSON: the kind, where there is one."""
    parts = []
    for kind, source, prefix, key, name, sub in NODES:
        base = source.strip("()").split("FROM ")[-1]
        df = table(spark, sf_dir, base)
        if source.startswith("("):
            df = df.select(key).distinct()
        parts.append(df.select(F.concat(F.lit(prefix), F.col(key).cast("string")).alias("id"), F.lit(kind).alias("type"), F.expr(name).cast("string").alias("name"), F.expr(sub).cast("string").alias("kind")))
    every = reduce(DataFrame.unionByName, parts)
    return every.select("id", "type", "name", F.to_json(F.struct("kind")).alias("properties"))


#: Rows of a table that one task groups into edges.
GROUPED = 500_000


def grouped(rows: DataFrame, *keys: str, most: int = GROUPED) -> DataFrame:
    """rows counted by keys: keys, weight. Nearly all keys of a table of links are distinct, so counting them before they
    are sent saves nothing and holds a task's whole split; rows are sent first, to as many tasks as their number asks for."""
    rows = rows.select(*keys)
    parts = -(-rows.count() // most)  # of the files' footers
    return (rows.repartition(parts, *keys) if parts > 1 else rows).groupBy(*keys).agg(F.count(F.lit(1)).alias("weight"))


def link_parts(spark: SparkSession, sf_dir: str, most: int = GROUPED) -> int:
    """Tasks of at most so many links that the tables of links ask for; their rows are counted in the files' footers."""
    return -(-sum(table(spark, sf_dir, source).count() for *_, source in EDGES) // most)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = []
    for kind, a, ka, b, kb, source in EDGES:
        df = grouped(table(spark, sf_dir, source), ka, kb)
        one, two = F.concat(F.lit(a), F.col(ka).cast("string")), F.concat(F.lit(b), F.col(kb).cast("string"))
        parts.append(df.select(F.concat(one, F.lit(f"->{kind}->"), two).alias("id"), F.lit(kind).alias("type"), one.alias("source_id"), two.alias("target_id"), "weight"))
    return reduce(DataFrame.unionByName, parts)
