"""Steps whose work must grow with their input and not with its square."""

import time
from functools import reduce

from pyspark.sql import functions as F

from graphloom.operators import graph, resolve
from graphloom.operators.communities import louvain
from graphloom.operators.fulltext import FullText
from graphloom.operators.graph import modularity
from graphloom.sources.tables import grouped
from graphloom.streaming import state


def test_calls_of_a_name_that_many_symbols_have(spark):
    """40,000 calls of a name that 40,000 symbols of other files have: 1.6 thousand million pairs, none of which is needed."""
    n, none = 40_000, F.lit(None).cast("string")
    ids = spark.range(n).select(F.col("id").cast("string").alias("k"))
    symbols = ids.select(F.concat(F.lit("t"), "k").alias("node_id"), F.lit("run").alias("name"), F.lit("function").alias("kind"), F.concat(F.lit("g"), "k").alias("file_id"), none.alias("parent_id"), none.alias("receiver_type"), F.lit(1).cast("long").alias("seq"))
    lone = spark.createDataFrame([("only", "stop", "function", "g1", None, None, 1)], symbols.schema)
    calls = ids.select(
        F.concat(F.lit("c"), "k").alias("caller_id"), F.lit("main").alias("caller_name"), F.lit("f").alias("file_id"), F.lit(1).alias("ord"), F.when(F.col("k") == "7", "stop").otherwise("run").alias("name"), none.alias("receiver"),
        F.lit("bare").alias("kind"), none.alias("receiver_var"), none.alias("receiver_type"), F.lit(None).cast("map<string,string>").alias("param_types"),
    )
    imports = spark.createDataFrame([], "file_id string, alias string, target_file_id string")
    began = time.perf_counter()
    found = resolve.resolve_calls(calls, symbols.unionByName(lone), imports).collect()
    assert [tuple(r) for r in found] == [("c7", "only", 0.8)]
    assert time.perf_counter() - began < 60


def test_early_calls_of_many_names(spark, tmp_path):
    """60,000 names with a call and a symbol each, half of the calls a batch before their symbols."""
    n = 60_000
    rows = spark.range(2 * n).select(F.when(F.col("id") % 2 == 0, "call").otherwise("symbol").alias("kind"), F.col("id").cast("string").alias("id"), F.floor(F.col("id") / 2).cast("string").alias("name"))
    late = (F.col("kind") == "symbol") == (F.col("name").cast("int") % 2 == 0)
    for part, when in (("a", ~late), ("b", late)):
        rows.where(when).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{part}")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    log, began = str(tmp_path / "log"), time.perf_counter()
    state.resolve_early_calls(stream, log, str(tmp_path / "checkpoint")).awaitTermination()
    got = state.latest(state.read_log(spark, log, "call_id string, name string, symbol_id string"), "call_id", "name")
    assert got.count() == n == got.where("int(symbol_id) = int(call_id) + 1 AND int(call_id) = 2 * int(name)").count()
    assert time.perf_counter() - began < 60


def test_leaves_need_no_rounds(spark):
    """Stars and single edges are settled by folding; what hangs on a triangle goes with the node it hangs on."""
    pairs = [("hub", f"leaf{i:03}") for i in range(300)] + [("x", "y")]
    edges = lambda rows: spark.createDataFrame([(f"e{i}", "T", a, b) for i, (a, b) in enumerate(rows)], "id string, type string, source_id string, target_id string")
    found = louvain(edges(pairs), passes=1)
    assert found.rounds == 0 and found.settled
    want = {x: "hub" for p in pairs[:-1] for x in p} | {"x": "x", "y": "x"}
    assert {r["id"]: r["community"] for r in found.labels.collect()} == want
    assert abs(found.modularity - modularity(edges(pairs), found.labels)) < 1e-9


def _of_many_tables(spark):
    """A graph whose nodes and edges come from six tables each."""
    nodes = reduce(lambda a, b: a.unionByName(b), [spark.range(50).select(F.concat(F.lit(f"{t}:"), "id").alias("id"), F.lit(t).alias("type")) for t in "abcdef"])
    links = [spark.range(40).select(F.concat(F.lit(f"{t}"), "id").alias("id"), F.lit("T").alias("type"), F.concat(F.lit(f"{t}:"), "id").alias("source_id"), F.concat(F.lit(f"{t}:"), F.col("id") % 3).alias("target_id")) for t in "abcdex"]
    return nodes, reduce(lambda a, b: a.unionByName(b), links)


def _joins(df) -> int:
    return sum("Join" in line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines())


def test_orphans_meet_the_ends_once(spark):
    """One join, not one for each table that the nodes come from."""
    nodes, edges = _of_many_tables(spark)
    found = graph.orphans(nodes, edges)
    assert _joins(found) == 1
    assert sorted(r["id"] for r in found.collect()) == sorted([f"{t}:{i}" for t in "abcde" for i in range(40, 50)] + [f"f:{i}" for i in range(50)])


def test_links_are_counted_in_parts_of_bounded_size(spark):
    """Rows are dealt by their keys to as many tasks as their number asks for, then counted where they are."""
    rows = spark.range(10_000).select((F.col("id") % 4_000).alias("a"), (F.col("id") % 2).alias("b"))
    counted = grouped(rows, "a", "b", most=1_000)
    assert counted.rdd.getNumPartitions() == 10 and counted.count() == 4_000 and counted.agg(F.sum("weight")).first()[0] == 10_000
    assert max(counted.groupBy(F.spark_partition_id()).count().toPandas()["count"]) < 1_000


def test_hops_work_out_once_what_is_shown(spark, monkeypatch):
    """The search gets a table, not the joins of all nodes with all edges, which each of its levels would do again."""
    (nodes, edges), joins, search = _of_many_tables(spark), [], graph.bfs
    monkeypatch.setattr(graph, "bfs", lambda links, *rest, **more: joins.append(_joins(links)) or search(links, *rest, **more))
    found = graph.hop_map(nodes, edges, spark.createDataFrame([("a:0",)], "id string"), 2, ["f"])
    assert joins == [0] and found.count() == 1 + 13 and found.where("depth = 1").count() == 13


def test_ends_meet_the_nodes_once(spark):
    """Two joins, one for each end, however many tables the edges come from."""
    nodes, edges = _of_many_tables(spark)
    found = graph.induced_edges(edges, nodes)
    assert _joins(found) == 2
    assert found.columns == edges.columns and found.count() == 5 * 40


def test_a_term_of_every_document_is_cut(spark):
    """Its postings go to several tasks."""
    docs = spark.range(4_000).select("id", F.concat(F.lit("alpha beta alpha x"), "id").alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        index = FullText.build(docs)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    hot = index.postings.where("term = 'alpha'")
    assert hot.count() == 4_000 == hot.where("tf = 2").count() and hot.select(F.input_file_name()).distinct().count() > 1


def test_ends_meet_in_as_many_tasks_as_asked_for(spark):
    """A join's tasks follow the number of links and not the session's shuffles; fewer than those are left alone."""
    nodes, edges = _of_many_tables(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = graph.induced_edges(edges, nodes, 16)
        assert found.rdd.getNumPartitions() == 16 and found.count() == 5 * 40
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert graph.dealt(edges, 2, "id") is edges and graph.dealt(edges, None, "id") is edges


def test_stop_words_are_one_look_into_a_set(spark):
    """Not a comparison with each of them for every word."""
    from graphloom.operators import fulltext

    assert "array_contains" not in str(fulltext.words(F.col("t")))
    rows = spark.createDataFrame([("The cat, AND the  dog2 of", ), (None,)], "t string").select(fulltext.words(F.col("t")).alias("w"))
    assert [r["w"] for r in rows.collect()] == [["cat", "dog2"], []]


def test_links_are_dealt_as_their_number_asks(spark):
    """Sums over links go to as many tasks as asked for, not to the session's shuffles, and are the same."""
    rows = [(f"e{i}", "DEFINES" if i % 3 else "CALLS", f"n{i % 7}", f"n{i % 5 + 4}") for i in range(60)]
    edges = spark.createDataFrame(rows, "id string, type string, source_id string, target_id string")
    starts = edges.select(F.col("target_id").alias("id")).distinct()
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    many = int(spark.conf.get("spark.sql.shuffle.partitions")) + 33
    for run in (graph.degrees, graph.collapsed):
        assert run(edges, parts=many).rdd.getNumPartitions() == many
        assert same(run(edges), run(edges, parts=many))
    assert same(graph.impact(edges, starts, 2, ["DEFINES"]), graph.impact(edges, starts, 2, ["DEFINES"], parts=many))
    assert same(graph.communities(edges), graph.communities(edges, parts=many))
