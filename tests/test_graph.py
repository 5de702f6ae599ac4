"""The store and the graph operators on small graphs."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import graph, search, store_ops
from graphloom.store import GraphStore


def ids(df):
    return sorted(r["id"] for r in df.collect())


def edge_table(spark, pairs):
    return spark.createDataFrame([(f"{a}->{b}#{i}", "E", a, b) for i, (a, b) in enumerate(pairs)], "id string, type string, source_id string, target_id string")


def test_stats_leave_metadata_out(seeded):
    assert {r["what"]: r["n"] for r in seeded.stats().collect()} == {"nodes": 6, "edges": 7, "nodes.Service": 1, "nodes.Database": 1, "nodes.Function": 3, "nodes.Class": 1}


def test_lookup_and_list(seeded):
    assert ids(seeded.get_node("ledger")) == ["ledger"] and ids(seeded.get_node("no")) == []
    assert [r["id"] for r in seeded.get_nodes(["weigh", "nothing", "depot"]).collect()] == ["weigh", "depot"]
    assert ids(seeded.list_nodes("Function", {"language": "python"})) == ["pack", "weigh"]
    assert ids(seeded.list_nodes("Function", {"slots": 12, "cold": True})) == ["pack"]
    assert ids(seeded.list_nodes("Function", limit=2)) == ["label", "pack"]


def test_traversal(seeded):
    assert ids(seeded.traverse("depot", max_depth=1)) == ["ledger", "pack"]
    assert {r["id"]: r["depth"] for r in seeded.traverse("depot", max_depth=3).collect()} == {"ledger": 1, "pack": 1, "weigh": 2, "parcel": 2, "label": 3}
    assert ids(seeded.traverse("depot", max_depth=1, relationship_type="CALLS")) == []
    assert ids(seeded.traverse("ledger", "incoming", 2)) == ["depot", "label", "weigh"]
    assert ids(seeded.traverse("label", "both", 1)) == ["ledger", "pack", "weigh"]
    with pytest.raises(KeyError):
        seeded.traverse("nobody")
    with pytest.raises(ValueError):
        seeded.traverse("depot", "sideways").collect()


def test_bfs_on_cycles_and_random_graphs(spark):
    draw = random.Random(4)
    pairs = [(f"n{draw.randint(0, 30)}", f"n{draw.randint(0, 30)}") for _ in range(80)]
    depth, frontier = {"n0": 0}, ["n0"]
    for d in (1, 2, 3):
        frontier = sorted({b for a, b in pairs if a in frontier} - set(depth))
        depth |= {x: d for x in frontier}
    got = graph.bfs(edge_table(spark, pairs), spark.createDataFrame([("n0",)], "id string"), "outgoing", 3, keep_starts=True)
    assert {r["id"]: r["depth"] for r in got.collect()} == depth


def test_search_and_expand(seeded):
    assert ids(seeded.search_nodes("sealed")) == ["parcel"]
    assert ids(seeded.search_nodes("weig")) == ["weigh"]  # no such token: expanded to those that start so
    assert ids(seeded.search_nodes("weig", ["Class"])) == []
    nodes, edges = seeded.search_graph("type:Class", hops=1)
    assert ids(nodes) == ["pack", "parcel"] and ids(edges) == ["e5"]
    assert ids(seeded.search_graph("ledger", hops=0)[0]) == ["ledger"]


def test_impact_by_lines(spark):
    nodes = [("r/a.py", "File", "a.py", '{"path": "a.py"}'), ("f", "Function", "f", '{"start_line": 1, "end_line": 5}'), ("g", "Function", "g", '{"start_line": 9, "end_line": 12}'), ("h", "Function", "h", "{}"), ("x", "Function", "x", "{}"), ("y", "Function", "y", "{}")]
    edges = [("1", "DEFINES", "r/a.py", "f"), ("2", "DEFINES", "r/a.py", "g"), ("3", "CALLS", "x", "f"), ("4", "CALLS", "y", "g"), ("5", "CALLS", "h", "x"), ("6", "MENTIONS", "y", "f")]
    store = GraphStore(spark.createDataFrame(nodes, "id string, type string, name string, properties string"), spark.createDataFrame(edges, "id string, type string, source_id string, target_id string"))
    assert {(r["key"], r["id"]) for r in store.impact("a.py", "2-3").collect()} == {("f", "x"), ("f", "h")}
    assert {(r["key"], r["id"]) for r in store.impact("/somewhere/a.py").collect()} == {("f", "x"), ("f", "h"), ("g", "y")}
    assert graph.parse_lines("10-25,40,x") == [(10, 25), (40, 40)]


def test_import_and_delete(spark, seeded):
    new = spark.createDataFrame([("label", "Function", "renamed", "{}"), ("r/x", "File", "x", "{}")], "id string, type string, name string, properties string")
    edges = spark.createDataFrame([("e1", "CALLS", "pack", "r/x"), ("bad", "CALLS", "pack", "nowhere")], "id string, type string, source_id string, target_id string")
    store = seeded.import_batch(new, edges)
    assert store.get_node("label").first()["name"] == "renamed" and store.nodes.count() == 7
    assert ids(store.edges) == [f"e{i}" for i in range(1, 8)]
    gone = store.delete_repo("r")
    assert "r/x" not in ids(gone.nodes) and ids(gone.edges) == [f"e{i}" for i in range(2, 8)]


def test_merge_and_diff(spark):
    rows = spark.createDataFrame([("a", "T", "one", {"x": "1", "y": "1"}, 1), ("a", "U", "two", {"y": "2"}, 2), ("b", "T", "b", None, 3)], "id string, type string, name string, properties map<string,string>, seq int")
    got = {r["id"]: (r["type"], r["name"], r["properties"]) for r in store_ops.merge_properties(rows).collect()}
    assert got == {"a": ("T", "one", {"x": "1", "y": "2"}), "b": ("T", "b", {})}
    assert {r["id"]: r["name"] for r in store_ops.keep_latest(rows).collect()} == {"a": "two", "b": "b"}
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string")
    assert {(r["id"], r["change"]) for r in store_ops.snapshot_diff(old, new).collect()} == {(1, "removed"), (2, "changed"), (3, "added")}


def test_attribution_takes_the_longest_prefix(spark):
    names = spark.createDataFrame([("acme/widget/a.py::f",), ("acme/other",), ("acme",), ("zoo/x",)], "id string")
    repos = spark.createDataFrame([("acme",), ("acme/widget",)], "id string")
    assert {r["id"]: r["repo"] for r in store_ops.attribute(names, repos).collect()} == {"acme/widget/a.py::f": "acme/widget", "acme/other": "acme", "acme": "acme", "zoo/x": "zoo"}


def test_visibility_rules(spark):
    rows = spark.createDataFrame([("1", "A", "x", 1), ("2", "A", None, 1), ("3", "B", None, 1), ("4", "C", None, 9)], "id string, type string, sub_type string, community int")
    assert ids(graph.visible(rows, ["B"], [], [9])) == ["1", "2"]
    assert ids(graph.visible(rows, [], ["A:x"])) == ["3", "4"]


def test_communities_beat_chance(spark):
    draw = random.Random(2)
    pairs = [(f"{c}{draw.randint(0, 9)}", f"{c}{draw.randint(0, 9)}") for c in "ab" for _ in range(60)] + [("a0", "b0")]
    edges = edge_table(spark, pairs)
    labels = graph.communities(edges)
    found = {r["id"]: r["community"] for r in labels.collect()}
    assert len({v for k, v in found.items() if k[0] == "a"}) == len({v for k, v in found.items() if k[0] == "b"}) == 1
    assert graph.modularity(edges, labels) > 0.4
    nodes = spark.createDataFrame([(x, "Class" if x == "a0" else "Function", f"src/{x[0]}/{x}", "{}") for x in found], "id string, type string, name string, properties string")
    assert {r["name"] for r in graph.community_names(labels, nodes).collect()} == {"src/a/a0", "src/b"}


def test_incident_and_capped(seeded):
    got = {(r["direction"], r["other_id"]) for r in graph.incident(seeded.nodes, seeded.edges, "pack").collect()}
    assert got == {("outgoing", "weigh"), ("outgoing", "parcel"), ("incoming", "depot"), ("incoming", "label")}
    nodes, edges = graph.whole_graph(seeded.nodes, seeded.edges, 3, 2)
    assert nodes.count() == 3 and edges.count() <= 2
    assert ids(graph.orphans(seeded.nodes, seeded.edges.where("target_id <> 'ledger'"))) == ["ledger"]
    assert {r["id"]: r["degree"] for r in graph.degrees(seeded.edges).collect()}["pack"] == 4


@pytest.fixture
def shop(spark):
    """Two repositories with a file of the same name, symbols and sources."""
    nodes = [
        ("shop", "Repository", "shop", '{"path": "/work/shop"}'), ("till", "Repository", "till", '{"path": "/work/till/"}'),
        ("shop/src/cash.py", "File", "cash.py", '{"path": "src/cash.py"}'), ("till/cash.py", "File", "cash.py", '{"path": "cash.py"}'), ("till/coin.py", "File", "coin.py", '{"path": "coin.py"}'),
        ("shop/src/cash.py::change", "Function", "change", '{"start_line": 2, "end_line": 3, "summary": "gives coins back"}'),
        ("till/coin.py::count", "Function", "count", '{"start_line": 1, "end_line": 1, "summary": "counts coins"}'),
    ]
    edges = [("1", "DEFINES", "shop/src/cash.py", "shop/src/cash.py::change"), ("2", "CALLS", "shop/src/cash.py::change", "till/coin.py::count"), ("3", "IMPORTS", "shop/src/cash.py", "till/coin.py"), ("4", "MENTIONS", "till/cash.py", "till/coin.py")]
    sources = [("shop/src/cash.py", "src/cash.py", "import coin\ndef change():\n    return coin.count()\n"), ("till/coin.py", "coin.py", "def count(): return 1")]
    make = spark.createDataFrame
    return GraphStore(make(nodes, "id string, type string, name string, properties string"), make(edges, "id string, type string, source_id string, target_id string"), make(sources, "id string, path string, content string"))


def test_source_search_is_scoped_and_says_what_it_left_out(shop):
    both = shop.source_search("coins", types=["Function"])
    assert {(r["id"], r["truncated"]) for r in both.collect()} == {("shop/src/cash.py::change", False), ("till/coin.py::count", False)}
    assert [r["truncated"] for r in shop.source_search("coins", types=["Function"], limit=1).collect()] == [True]
    assert ids(shop.source_search("coins", "till", ["Function"])) == ["till/coin.py::count"]
    with pytest.raises(LookupError, match="shop, till"):
        shop.source_search("coins", "til")


def test_files_are_resolved_below_their_repositories(shop):
    assert shop.path_candidates("/work/till/coin.py") == ["/work/till/coin.py", "coin.py"]
    assert shop.resolve_file("/work/shop/src/cash.py") == "shop/src/cash.py" and shop.resolve_file("elsewhere/coin.py") == "till/coin.py"
    assert shop.resolve_file("nothing.py") is None
    with pytest.raises(LookupError, match="shop/src/cash.py, till/cash.py"):
        shop.resolve_file("other/cash.py")
    assert [(r["repo_id"], r["path"]) for r in shop.repo_paths().collect()] == [("shop", "/work/shop"), ("till", "/work/till/")]


def test_read_source_explore_and_file_impact(shop):
    content = lambda **k: shop.read_source(**k).first()["content"]
    assert content(path="src/cash.py", lines="2") == "def change():" and content(path="src/cash.py", lines="2-") == "def change():\n    return coin.count()\n"
    assert content(node_id="till/coin.py::count") == "def count(): return 1" and content(path="/work/shop/src/cash.py", lines="1-2") == "import coin\ndef change():"
    for bad in ("x", "0", "3-2", "1-2-3"):
        with pytest.raises(ValueError):
            shop.read_source(path="src/cash.py", lines=bad)
    with pytest.raises(LookupError):
        shop.read_source(path="nothing.py")
    node, near, source = shop.explore("shop/src/cash.py::change", 2)
    assert ids(node) == ["shop/src/cash.py::change"] and source.first()["line_count"] == 4
    assert {r["id"]: r["depth"] for r in near.collect()} == {"shop/src/cash.py": 1, "till/coin.py::count": 1, "till/coin.py": 2}
    assert [r["neighbor_id"] for r in shop.file_impact("coin.py").collect()] == ["shop/src/cash.py"]


def test_index_update_and_remove(spark):
    docs = spark.createDataFrame([("a", "one", "red apple"), ("b", "two", "green apple tree"), ("c", "three", "blue sea")], "id string, name string, text string")
    index = search.Index.build(docs)
    assert ids(search.bm25(index, "apple")) == ["a", "b"]
    newer = index.update(spark.createDataFrame([("a", "one", "red brick"), ("d", "four", "apple pie")], docs.schema))
    same = search.Index.build(spark.createDataFrame([("a", "one", "red brick"), ("b", "two", "green apple tree"), ("c", "three", "blue sea"), ("d", "four", "apple pie")], docs.schema))
    assert search.bm25(newer, "apple red").collect() == search.bm25(same, "apple red").collect()
    less = newer.remove(spark.createDataFrame([("b",), ("zzz",)], "id string"))
    assert ids(search.bm25(less, "apple")) == ["d"] and less.sizes.count() == 3


def test_segments_of_an_index_equal_one_built_anew(spark, monkeypatch):
    monkeypatch.setattr(search.Index, "MERGED", 3)
    rng = random.Random(5)
    schema = "id string, name string, text string"
    word = lambda: rng.choice(["oak", "elm", "fir", "ash", "yew", "birch", "maple"])
    have = {f"d{i}": (f"d{i}", word(), " ".join(word() for _ in range(rng.randrange(6)))) for i in range(30)}
    index = search.Index.build(spark.createDataFrame(list(have.values()), schema))
    sizes = []
    for step in range(7):
        if step % 3 == 2:
            gone = rng.sample(sorted(have), 3)
            have = {k: v for k, v in have.items() if k not in gone}
            index = index.remove(spark.createDataFrame([(g,) for g in [*gone, "never"]], "id string"))
        else:
            new = {i: (i, word(), f"{word()} {word()}") for i in [f"d{rng.randrange(40)}", f"d{rng.randrange(40)}"]}
            have |= new
            old = index.segments
            index = index.update(spark.createDataFrame(list(new.values()), schema))
            if len(index.segments) > len(old):  # nothing but the new documents was written
                assert index.segments[:-1] == old and index.segments[-1].documents.count() == len(new)
        sizes.append(len(index.segments))
        if step in (1, 4, 6):
            anew = search.Index.build(spark.createDataFrame(list(have.values()), schema))
            assert (index.n_docs, index.avg_len) == (anew.n_docs, anew.avg_len) and sorted(index.vocabulary.collect()) == sorted(anew.vocabulary.collect())
            assert sorted(index.sizes.collect()) == sorted(anew.sizes.collect()) and sorted(index.postings.collect()) == sorted(anew.postings.collect())
            got, want = (search.bm25(i, "oak yew map", None).orderBy("id").collect() for i in (index, anew))
            assert [r["id"] for r in got] == [r["id"] for r in want] and all(abs(a["score"] - b["score"]) < 1e-9 for a, b in zip(got, want, strict=True))
    assert max(sizes) <= 4 and any(b < a for a, b in zip(sizes, sizes[1:], strict=False))  # segments were merged


def test_imports_are_counted_and_bad_rows_told(spark, seeded):
    nodes = spark.createDataFrame([("pack", "Function", "p", "{}"), ("new", "File", "n", "{}"), (None, "File", "x", "{}"), ("untyped", None, "x", "{}")], "id string, type string, name string, properties string")
    edges = spark.createDataFrame([("e1", "CALLS", "pack", "new"), ("e9", "CALLS", "new", "label"), ("lost", "CALLS", "new", "nowhere"), ("gone", "CALLS", "nowhere", "new")], "id string, type string, source_id string, target_id string")
    counts, errors = seeded.import_report(nodes, edges)
    assert {r["what"]: r["n"] for r in counts.collect()} == {"nodes_created": 1, "nodes_updated": 1, "edges_created": 1, "edges_updated": 1, "errors": 4}
    assert {(r["id"], r["error"]) for r in errors.collect()} == {(None, "no id"), ("untyped", "no type"), ("lost", "no target"), ("gone", "no source")}
    again = nodes.union(spark.createDataFrame([("new", "File", "z", None), ("new", "File", "a", "{}")], nodes.schema))
    after, seen, bad = seeded.import_counted(again, edges)
    assert seen == {"nodes_created": 1, "nodes_updated": 1, "edges_created": 1, "edges_updated": 1, "errors": 4}
    assert sorted(map(str, bad.collect())) == sorted(map(str, errors.collect()))
    names = {r["id"]: r["name"] for r in after.nodes.collect()}
    assert names["new"] == "z" and names["pack"] == "p" and names["weigh"] == "weigh" and len(names) == 7 and after.nodes.count() == 7
    assert {r["id"]: r["target_id"] for r in after.edges.collect()} == {**{r["id"]: r["target_id"] for r in seeded.edges.collect()}, "e1": "new", "e9": "label"}
    same, seen, bad = seeded.import_counted(nodes.where("false"), edges.where("false"))
    assert set(seen.values()) == {0} and bad.count() == 0 and same.edges.count() == 7
    vectors = spark.createDataFrame([("a", [1.0]), ("b", [2.0])], "id string, vec array<double>")
    more = seeded.add_vectors(vectors).add_vectors(spark.createDataFrame([("b", [3.0])], vectors.schema))
    assert {r["id"]: r["vec"] for r in more.vectors.collect()} == {"a": [1.0], "b": [3.0]}
    assert more.cleared().nodes.count() == 0 and more.cleared().vectors.columns == ["id", "vec"]


def test_properties_literals_and_references(spark):
    rows = spark.createDataFrame([("{a: 1, b: 'x, y', \"c d\": z, a: 2}",), ("{}",), ("none",)], "s string")
    assert [r["m"] for r in rows.select(store_ops.parse_map_literal(F.col("s")).alias("m")).collect()] == [{"a": "2", "b": "x, y", "c d": "z"}, {}, None]
    variables = spark.createDataFrame([("f", "x", 3, ["c"]), ("f", "x", 1, ["a", "b"]), ("f", "y", 2, [])], "scope_id string, name string, seq int, refs array<string>")
    assert {(r["name"], r["seq"], tuple(r["refs"])) for r in store_ops.merge_refs(variables).collect()} == {("x", 1, ("a", "b", "c")), ("y", 2, ())}
    fresh = store_ops.insert_missing(rows.select(F.col("s").alias("id"), F.lit(1).alias("n")), spark.createDataFrame([("q", 9), ("q", 4), ("{}", 0)], "id string, n int"))
    assert {(r["id"], r["n"]) for r in fresh.collect()} >= {("q", 4), ("{}", 1)} and fresh.count() == 4


def test_hidden_types_sweep_and_pull_requests(spark, seeded):
    shown = {(r["id"], r["depth"]) for r in graph.hop_map(seeded.nodes, seeded.edges, spark.createDataFrame([("depot",)], "id string"), 2, ["Class"], ["CALLS"]).collect()}
    assert shown == {("depot", 0), ("pack", 1), ("ledger", 1), ("label", 2)}
    assert {r["id"] for r in graph.hop_map(seeded.nodes, seeded.edges, spark.createDataFrame([("depot",)], "id string"), 1).collect()} == {"depot", "pack", "ledger"}

    more = [("r/pr/7", "PullRequest", "#7 heavier", "{}"), ("r/a.py", "File", "a.py", "{}"), ("r/b.py", "File", "b.py", "{}"), ("pkg:used", "Dependency", "used", "{}"), ("pkg:idle", "Dependency", "idle", "{}"), ("odd", None, "odd", "{}")]
    links = [("p1", "CHANGES", "r/pr/7", "r/a.py", '{"status": "added"}'), ("p2", "CHANGES", "r/pr/7", "r/b.py", "{}"), ("p3", "IMPORTS", "r/b.py", "r/a.py", "{}"), ("p4", "IMPORTS", "r/b.py", "pkg:used", "{}"), ("p5", "IMPORTS", "pkg:idle", "pkg:used", "{}")]
    store = GraphStore(spark.createDataFrame(more, seeded.nodes.schema), spark.createDataFrame(links, "id string, type string, source_id string, target_id string, properties string"))
    kept = GraphStore(graph.sweep_orphans(spark.createDataFrame(more, seeded.nodes.schema), store.edges), store.edges)
    assert kept.nodes.count() == 4  # the one without a type is no node of the store
    assert {r["id"] for r in graph.sweep_orphans(spark.createDataFrame(more, seeded.nodes.schema), store.edges).collect()} == {x[0] for x in more} - {"pkg:idle"}
    swept = store.swept()
    assert {r["id"] for r in swept.edges.collect()} == {"p1", "p2", "p3", "p4"}

    node, changed = store.pull_request("r/pr/7")
    assert node.count() == 1 and {(r["id"], r["change"]) for r in changed.collect()} == {("r/a.py", '{"status": "added"}'), ("r/b.py", "{}")}
    radius = {(r["file_id"], r["id"], r["depth"]) for r in store.pull_request_radius("r/pr/7").collect()}
    assert radius == {("r/a.py", "r/pr/7", 1), ("r/a.py", "r/b.py", 1), ("r/b.py", "r/pr/7", 1)}
    with pytest.raises(LookupError):
        store.pull_request("r/pr/8")

    told = seeded.augment("pack", told=1).collect()
    pack = [r for r in told if r["id"] == "pack"]
    assert [(r["edge_type"], r["position"], r["more"]) for r in pack] == [("CALLS", 1, 1)] and pack[0]["neighbor_name"] in ("weigh", "label")
    assert seeded.augment("nothing of the kind qqq").count() == 0
