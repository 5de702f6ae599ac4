"""Queries that once left a part of their tables or of their steps out, on the smallest tables."""

from pyspark.sql import functions as F

from graphloom.operators import graph
from graphloom.plans import registry
from graphloom.sources.tables import edges

SF = "/root/testdata/sf0.001"


def test_all_edges_are_collapsed(spark):
    """Calls too: the weights add up to all edges between two nodes."""
    got = registry.weighted_edge_collapse(spark, SF)
    assert got.agg(F.sum("weight")).first()[0] == edges(spark, SF).where("source_id <> target_id").count()
    assert not got.where("a LIKE 'order:%' AND b LIKE 'part:%'").isEmpty()


def test_impact_goes_two_steps_back(spark):
    """Of a supplier: the parts that depend on it, and the orders that call those."""
    rows = spark.read.parquet(f"{SF}/lineitem.parquet")
    parts = rows.select(F.concat(F.lit("supplier:"), "l_suppkey").alias("key"), "l_partkey").distinct()
    orders = parts.join(rows.select("l_partkey", "l_orderkey"), "l_partkey").select("key", "l_orderkey").distinct()
    want = {r["key"]: r["n"] for r in parts.select("key").unionAll(orders.select("key")).groupBy("key").agg(F.count("key").alias("n")).collect()}
    assert {r["key"]: r["n"] for r in registry.impact_blast_radius(spark, SF).collect()} == want


def test_packed_searches_find_the_same(spark):
    """Cycles, steps that several edges make, and keys of which one node has many."""
    rows = [(f"e{i}", "CALLS" if i % 3 else "DEFINES", f"n{i % 11}", f"n{(i * 7 + i // 11) % 13}") for i in range(80)]
    links = spark.createDataFrame(rows, "id string, type string, source_id string, target_id string")
    starts = spark.createDataFrame([(f"k{i}", f"n{i % 3}") for i in range(9)], "key string, id string")
    every = lambda df: sorted(map(tuple, df.select("key", "id", "depth", "parent_id", "edge_id", "edge_type").collect()))
    for depth in (0, 1, 3):
        for parts in (None, 99):
            assert every(graph.bfs(links, starts, "incoming", depth)) == every(graph.bfs(links, starts, "incoming", depth, parts=parts, packed=True))
