"""Snapshots of a graph: what is replaced, what stays where it is, and who may write."""

import os
import random

import pytest
from pyspark.sql import functions as F

from graphloom.streaming import snapshots

NODES = "id string, type string, name string"
EDGES = "id string, type string, source_id string, target_id string"


def nodes(spark, *ids, name="n"):
    return spark.createDataFrame([(i, "File", name) for i in ids], NODES)


def edges(spark, *pairs):
    return spark.createDataFrame([(f"{a}->{b}", "E", a, b) for a, b in pairs], EDGES)


def ids(df):
    return sorted(r["id"] for r in df.collect())


def files(root):
    """Files of data under a folder with the time of their last change."""
    return {os.path.join(at, n): os.path.getmtime(os.path.join(at, n)) for at, _, names in os.walk(f"{root}/data") for n in names if n.endswith(".parquet")}


def test_snapshots_replace_a_repository(spark, tmp_path):
    store = snapshots.SnapshotStore(spark, str(tmp_path / "store"))
    assert store.read() is None and store.current() is None
    store.replace("r", nodes(spark, "r/a", "r/b"), edges(spark, ("r/a", "r/b")))
    store.replace("s", nodes(spark, "s/x"), edges(spark))
    before = files(tmp_path / "store")
    store.replace("r", nodes(spark, "r/c"), edges(spark))
    assert ids(store.read()[0]) == ["r/c", "s/x"] and store.read()[1].count() == 0
    after = files(tmp_path / "store")
    assert {f: t for f, t in after.items() if f in before} == before and len(after) == len(before) + 1  # one new file of one node
    assert {p.folder.split("/")[0] for p in store.manifest() if p.owner == "s"} == {p.folder.split("/")[0] for p in store.manifest("0000000002-" + store._commit(2)["name"][11:]) if p.owner == "s"}


def test_snapshot_stream(spark, tmp_path):
    spark.createDataFrame([("q", "q/a", "File", "a"), ("p", "p/b", "File", "b")], "repo string, id string, type string, name string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("repo string, id string, type string, name string").parquet(str(tmp_path / "in"))
    store = snapshots.SnapshotStore(spark, str(tmp_path / "store"))
    none = spark.createDataFrame([("1", "E", "q/a", "q/a")], "id string, type string, source_id string, target_id string")
    snapshots.ingest(store, stream, lambda repos: none.withColumn("repo", F.split("source_id", "/")[0]).join(repos, "repo", "left_semi").drop("repo"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r["id"] for r in store.read()[0].collect()) == ["p/b", "q/a"]
    assert store.current().startswith("0000000001-")  # both repositories of the batch in one snapshot


def test_any_order_of_replacements_equals_the_whole_graph_rewritten(spark, tmp_path):
    store = snapshots.SnapshotStore(spark, str(tmp_path / "store"))
    rng = random.Random(3)
    repos = ["a", "b", "b/in", "c"]
    have_nodes, have_edges = {}, {}
    within = lambda i, r: i == r or i.startswith(f"{r}/") or i == f"_meta:index:{r}"
    for step in range(9):
        gone = rng.sample(repos, rng.choice([1, 1, 2]))
        name = f"v{step}"
        new = {f"{r}/{rng.randrange(5)}" for r in gone for _ in range(4)} | {f"_meta:index:{gone[0]}", gone[0], "pkg:npm:@x/y", f"pkg:pypi:{rng.randrange(3)}", f"{rng.choice(repos)}/far"}
        old = {i for i in have_nodes if not any(within(i, r) for r in gone)}
        have_nodes = {i: have_nodes[i] for i in old} | {i: name for i in new if i not in old}
        pairs = {(rng.choice(sorted(new)), rng.choice(sorted(have_nodes))) for _ in range(8)}
        have_edges = {k: p for k, p in have_edges.items() if not any(within(i, r) for i in p for r in gone)} | {f"{a}->{b}": (a, b) for a, b in pairs}
        store.replace(spark.createDataFrame([(r,) for r in gone], "repo string"), nodes(spark, *sorted(new), name=name), edges(spark, *sorted(pairs)))
        got_nodes, got_edges = store.read()
        assert sorted((r["id"], r["name"]) for r in got_nodes.collect()) == sorted(have_nodes.items()), step
        assert ids(got_edges) == sorted(have_edges), step
    store.compact()
    assert sorted((r["id"], r["name"]) for r in store.read()[0].collect()) == sorted(have_nodes.items()) and ids(store.read()[1]) == sorted(have_edges)
    assert len({(p.kind, p.owner, p.other) for p in store.manifest()}) == len(store.manifest())
    assert store.clean() > 0 and ids(store.read()[1]) == sorted(have_edges)
    named = {f"{tmp_path}/store/data/{p.folder}" for p in store.manifest()}
    assert {os.path.dirname(f) for f in files(tmp_path / "store")} == named


def test_writers_exclude_each_other(spark, tmp_path, monkeypatch):
    one, two = (snapshots.SnapshotStore(spark, str(tmp_path / "store")) for _ in range(2))
    one.publish(nodes(spark, "r/a"), edges(spark), ["r"])
    with one.lock(), pytest.raises(snapshots.Locked):
        two.replace("r", nodes(spark, "r/b"), edges(spark))
    assert ids(two.read()[0]) == ["r/a"]
    # a lock broken too early: the second commit fails and leaves nothing
    write = one._write

    def late(rows, kind, name):
        if kind == "edges":
            one.break_lock()
            two.replace("r", nodes(spark, "r/two"), edges(spark))
        return write(rows, kind, name)

    monkeypatch.setattr(one, "_write", late)
    with pytest.raises(snapshots.Conflict):
        one.replace("r", nodes(spark, "r/one"), edges(spark))
    assert ids(two.read()[0]) == ["r/two"] and len(os.listdir(tmp_path / "store" / "data")) == 2 and not os.path.exists(tmp_path / "store" / "_LOCK")


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    store = snapshots.SnapshotStore(spark, str(tmp_path / "store"))
    store.publish(nodes(spark, "r/a"), edges(spark), ["r"])
    bad = nodes(spark, "r/b").withColumn("name", F.raise_error(F.lit("unreadable")).cast("string"))
    with pytest.raises(Exception, match="unreadable"):
        store.replace("r", bad, edges(spark))
    assert ids(store.read()[0]) == ["r/a"] and len(os.listdir(tmp_path / "store" / "data")) == 1
    store.replace("r", nodes(spark, "r/c"), edges(spark))  # the lock is free
    assert ids(store.read()[0]) == ["r/c"]


def test_nulls_repeats_new_columns_and_reads_by_repository(spark, tmp_path):
    store = snapshots.SnapshotStore(spark, str(tmp_path / "store"))
    odd = spark.createDataFrame([(None, "File", "x"), ("r/a", "File", "a"), ("r/a", "File", "a"), ("s/b", None, None)], NODES)
    store.publish(odd, edges(spark, ("r/a", "s/b"), ("s/b", "pkg:go:z")), ["r", "s"])
    store.replace("t", nodes(spark, "t/c").withColumn("extra", F.lit(7)), edges(spark))
    rows = store.read()[0].collect()
    assert sorted((r["id"] or "", r["extra"]) for r in rows) == [("", None), ("r/a", None), ("r/a", None), ("s/b", None), ("t/c", 7)]
    assert ids(store.read(repos=["r"])[0]) == ["r/a", "r/a"] and ids(store.read(repos=["r"])[1]) == ["r/a->s/b"]
    store.replace("r", nodes(spark), edges(spark))
    assert ids(store.read()[1]) == ["s/b->pkg:go:z"] and store.read()[0].count() == 3
