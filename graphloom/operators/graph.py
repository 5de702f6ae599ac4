"""Traversal and graph analytics over nodes (id, type, name, properties) and edges
(id, type, source_id, target_id, properties)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import common_prefix, pluralize
from graphloom.session import written

INTERNAL_TYPES = ("IndexMetadata",)
MAX_DEPTH = 10


def oriented(edges: DataFrame, direction: str, types: Sequence[str] | None = None) -> DataFrame:
    """Edges as steps: here, there, and the edge with its own ends."""
    if types:
        edges = edges.where(F.col("type").isin(list(types)))
    cols = [F.col("id").alias("edge_id"), F.col("type").alias("edge_type"), "source_id", "target_id"]
    out = edges.select(F.col("source_id").alias("here"), F.col("target_id").alias("there"), *cols)
    back = edges.select(F.col("target_id").alias("here"), F.col("source_id").alias("there"), *cols)
    if direction not in ("outgoing", "incoming", "both"):
        raise ValueError(f"direction {direction!r} is not outgoing, incoming or both")
    return {"outgoing": out, "incoming": back, "both": out.unionByName(back)}[direction]


def among(rows: DataFrame, ids: DataFrame, on: str, parts: int | None = None) -> DataFrame:
    """rows whose column ``on`` is one of ids (a column id). An inner join with distinct ids: Spark moves semi joins below
    unions, and a graph is one of many tables, each of which would meet all ids. ``parts`` as in dealt(): both sides are
    sent, as the number of tasks of the ids' own distinct would rule otherwise."""
    return dealt(rows, parts, on).join(dealt(ids.select(F.col("id").alias(on)), parts, on).distinct(), on).select(*rows.columns)


def without(rows: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """rows whose column ``on`` is none of ids (a column id), by an outer join for the same reason."""
    met = ids.select(F.col("id").alias(on)).distinct().withColumn("_met", F.lit(True))
    return rows.join(met, on, "left").where("_met IS NULL").select(*rows.columns)


def neighbors(edges: DataFrame, ids: DataFrame, direction: str = "both", types: Sequence[str] | None = None) -> DataFrame:
    """One row for each step from ``ids`` (a column id): id, neighbor_id, the edge and its direction seen from id."""
    steps = oriented(edges, direction, types)
    found = among(steps, ids, "here")
    way = F.when(F.col("source_id") == F.col("here"), "outgoing").otherwise("incoming")
    return found.select(F.col("here").alias("id"), F.col("there").alias("neighbor_id"), "edge_id", "edge_type", way.alias("direction"))


def _at(reached: DataFrame, depth: int) -> DataFrame:
    return reached.select("key", "id", F.lit(depth).alias("depth"), "by.parent_id", "by.edge_id", "by.edge_type")


#: Rows that a task unpacks on average, as a multiple of what ``parts`` is made for.
UNPACKED = 4


def _packed_step(frontier: DataFrame, seen: DataFrame, steps: DataFrame, parts: int | None) -> DataFrame:
    """id, key, by of one level: a row for each step, with the keys that take it, is sent by id and unpacked where it
    arrives. What is seen comes along the same way, as a join would send all that is found once more."""
    pack = lambda rows, name: rows.groupBy(F.col("id").alias(name)).agg(F.collect_list("key").alias("keys"))
    lists = written(pack(frontier, "here"), "bfs-keys")
    found = lists.join(steps, "here").select(F.col("there").alias("id"), "keys", F.struct(F.col("here").alias("parent_id"), "edge_type", "edge_id").alias("by"))
    rows = found.unionByName(pack(seen, "id").withColumn("by", F.lit(None).cast(found.schema["by"].dataType)))
    # keys of a list times steps are rows; both are counted in footers
    n = -(-parts * frontier.count() // (UNPACKED * max(1, lists.count()))) if parts else 0
    few = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = (rows.repartition(n, "id") if n > few else rows.repartition("id")).select("id", F.explode("keys").alias("key"), "by")
    return rows.groupBy("id", "key").agg(F.min("by").alias("by"), F.max(F.col("by").isNull()).alias("_known")).where("NOT _known")


def bfs(edges: DataFrame, starts: DataFrame, direction: str = "outgoing", max_depth: int = 3, types: Sequence[str] | None = None, keep_starts: bool = False, parts: int | None = None, packed: bool = False) -> DataFrame:
    """Nodes reached from ``starts``, each once at its least depth: id, depth, parent_id,
    edge_id, edge_type. If starts has a column key, each key is a search of its own.
    Among the edges that find a node at the same depth, the smallest
    (parent_id, edge_type, edge_id) counts. ``types`` limits the paths, not the result;
    ``parts`` as in dealt(). ``packed`` is for many searches that meet in most nodes: the keys that reach a node go along
    its steps as one list, and the last level is left to who reads it, once, instead of being written."""
    keyed = "key" in starts.columns
    if not keyed:
        starts = starts.withColumn("key", F.lit(0))
    steps = oriented(edges, direction, types)
    none = F.lit(None).cast("string")
    seen = written(starts.select("key", "id").distinct().select("key", "id", F.lit(0).alias("depth"), none.alias("parent_id"), none.alias("edge_id"), none.alias("edge_type")), "bfs")
    frontier, levels = seen, [seen]
    last = min(max_depth, MAX_DEPTH)
    for depth in range(1, last + 1):
        if packed:
            level = _at(_packed_step(frontier, seen, steps, parts), depth)
            if depth == last:
                levels.append(level)
                break
            frontier = written(level, "bfs")
            if frontier.isEmpty():
                break
            levels.append(frontier)
            seen = seen.unionByName(frontier)
            continue
        found = frontier.select("key", F.col("id").alias("here")).join(steps, "here").withColumnRenamed("there", "id")
        reached = (
            dealt(found, parts, "key", "id")
            .groupBy("key", "id")
            .agg(F.min(F.struct(F.col("here").alias("parent_id"), "edge_type", "edge_id")).alias("by"))
            .join(seen.select("key", "id"), ["key", "id"], "left_anti")
        )
        frontier = written(_at(reached, depth), "bfs")
        if frontier.isEmpty():
            break
        levels.append(frontier)
        seen = seen.unionByName(frontier)
    rows = levels[0] if keep_starts else levels[0].where("false")
    for level in levels[1:]:
        rows = rows.unionByName(level)
    return rows if keyed else rows.drop("key")


def traverse(nodes: DataFrame, edges: DataFrame, start: str, direction: str = "outgoing", max_depth: int = 3, relationship_type: str | None = None) -> DataFrame:
    """bfs() from one node, with the nodes' own columns. An unknown start is an error."""
    one = nodes.where(F.col("id") == start).select("id")
    if one.isEmpty():
        raise KeyError(f"no node {start!r}")
    reached = bfs(edges, one, direction, max_depth, [relationship_type] if relationship_type else None)
    return reached.join(nodes, "id")


def dealt(rows: DataFrame, parts: int | None, *keys: str) -> DataFrame:
    """rows sent by keys to ``parts`` tasks, where that is more than the session's shuffles have, so that a
    task's share does not grow with a table whose rows set ``parts``."""
    return rows.repartition(parts, *keys) if parts and parts > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows


def induced_edges(edges: DataFrame, ids: DataFrame, parts: int | None = None) -> DataFrame:
    """Edges with both ends in ids; ``parts`` as in dealt()."""
    return among(among(edges, ids, "source_id", parts), ids, "target_id", parts)


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without any edge. Each end is met once, however many edges it has."""
    return without(nodes, edges.select(F.explode(F.array("source_id", "target_id")).alias("id")), "id")


def sweep_orphans(nodes: DataFrame, edges: DataFrame, kind: str = "Dependency") -> DataFrame:
    """nodes without those of a type that no edge leads to. Other types, and nodes without one, stay."""
    mine = F.coalesce(F.col("type") == kind, F.lit(False))
    used = edges.select(F.col("target_id").alias("id"))
    return nodes.where(~mine).unionByName(among(nodes.where(mine), used, "id"))


def shown_edges(nodes: DataFrame, edges: DataFrame, hidden_types: Sequence[str] = (), hidden_links: Sequence[str] = ()) -> DataFrame:
    """Edges of types that are not hidden, both ends of which are nodes of types that are not hidden."""
    links = edges.where(~F.col("type").isin(*hidden_links)) if hidden_links else edges
    return induced_edges(links, nodes.where(~F.col("type").isin(*hidden_types)) if hidden_types else nodes)


def hop_map(nodes: DataFrame, edges: DataFrame, starts: DataFrame, hops: int, hidden_types: Sequence[str] = (), hidden_links: Sequence[str] = ()) -> DataFrame:
    """id, depth of what lies within so many steps of ``starts`` (a column id), whichever way, over what is shown; the starts at depth 0."""
    shown = written(shown_edges(nodes, edges, hidden_types, hidden_links).select("id", "type", "source_id", "target_id"), "shown")  # once, not in each level
    return bfs(shown, starts.select("id"), "both", hops, keep_starts=True).select("id", "depth")


def valid_pairs(nodes: DataFrame, edges: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Edges whose ends exist and have types that may be connected."""
    kind = nodes.select("id", "type")
    joined = edges.join(kind.select(F.col("id").alias("source_id"), F.col("type").alias("source_type")), "source_id").join(kind.select(F.col("id").alias("target_id"), F.col("type").alias("target_type")), "target_id")
    allowed = F.struct("source_type", "target_type").isin([F.struct(F.lit(a).alias("source_type"), F.lit(b).alias("target_type")) for a, b in pairs])
    return joined.where(allowed).select(*edges.columns, "source_type", "target_type")


def expand(edges: DataFrame, seeds: DataFrame, hops: int = 2, max_nodes: int | None = None) -> DataFrame:
    """Ids within ``hops`` undirected steps of the seeds, nearest first where ``max_nodes`` limits them."""
    reached = bfs(edges, seeds, "both", max(0, min(hops, 5)), keep_starts=True).select("id", "depth")
    return reached.orderBy("depth", "id").limit(max_nodes) if max_nodes else reached


def type_seeds(nodes: DataFrame, query: str) -> DataFrame:
    """Seeds of a query ``type:X``."""
    return nodes.where(F.lower("type") == query.split(":", 1)[1].strip().lower()).select("id")


def whole_graph(nodes: DataFrame, edges: DataFrame, max_nodes: int, max_edges: int) -> tuple[DataFrame, DataFrame]:
    """The graph, or at most that many edges (by id), their ends (by id) and the edges among them."""
    if nodes.count() <= max_nodes and edges.count() <= max_edges:
        return nodes, edges
    some = edges.orderBy("id").limit(max_edges)
    ids = some.select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct().orderBy("id").limit(max_nodes)
    return among(nodes, ids, "id"), induced_edges(some, ids)


def degrees(edges: DataFrame, parts: int | None = None) -> DataFrame:
    """id, degree (in and out); ``parts`` as in dealt()."""
    return dealt(edges.select(F.explode(F.array("source_id", "target_id")).alias("id")), parts, "id").groupBy("id").agg(F.count("id").alias("degree"))


def node_size(degree: Column) -> Column:
    return F.least(F.greatest(4 + 1.8 * F.sqrt(degree), F.lit(4.0)), F.lit(20.0))


def collapsed(edges: DataFrame, parts: int | None = None) -> DataFrame:
    """Undirected edges a < b with weight, parallel ones summed, loops left out; ``parts`` as in dealt()."""
    ends = edges.where("source_id <> target_id").select(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b"), "id")
    return dealt(ends, parts, "a", "b").groupBy("a", "b").agg(F.count("id").alias("weight"))


def canonical(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with both ends present, one of each source, type and target."""
    return induced_edges(edges, nodes).groupBy("source_id", "type", "target_id").agg(F.min("id").alias("id"))


def incident(nodes: DataFrame, edges: DataFrame, node_id: str) -> DataFrame:
    """All edges at a node with their direction and the other end, duplicates kept."""
    at = edges.where((F.col("source_id") == node_id) | (F.col("target_id") == node_id))
    out = F.col("source_id") == node_id
    rows = at.select(F.when(out, "outgoing").otherwise("incoming").alias("direction"), F.coalesce("type", F.lit("unknown")).alias("label"), F.when(out, F.col("target_id")).otherwise(F.col("source_id")).alias("other_id"))
    names = nodes.select(F.col("id").alias("other_id"), F.col("name").alias("other_name"), F.col("type").alias("other_type"))
    return rows.join(names, "other_id", "left").withColumn("other_name", F.coalesce("other_name", "other_id"))


# fixed values: the types that a short account of a node tells of
TOLD_TYPES = ("CALLS", "IMPORTS", "DEPENDS_ON", "CONTAINS", "EXTENDS", "IMPLEMENTS")
IMPACT_TYPES = ("CALLS", "IMPORTS", "DEPENDS_ON", "EXTENDS", "IMPLEMENTS")


def impact(edges: DataFrame, symbols: DataFrame, depth: int = 2, types: Sequence[str] = IMPACT_TYPES, parts: int | None = None) -> DataFrame:
    """What depends on the symbols: incoming searches, one for each symbol (key), whose
    finding edge is of a dependency type. The types limit the result, not the paths."""
    starts = symbols.select(F.col("id").alias("key"), "id")
    return bfs(edges, starts, "incoming", depth, parts=parts, packed=True).where(F.col("edge_type").isin(list(types)))


def file_impact(edges: DataFrame, files: DataFrame, limit: int = 10) -> DataFrame:
    """The first neighbors of files, whatever the direction, over edges of dependency types."""
    return neighbors(edges, files, "both", IMPACT_TYPES).orderBy("neighbor_id", "edge_id").limit(limit)


def around(nodes: DataFrame, edges: DataFrame, node_id: str, depth: int = 1) -> DataFrame:
    """id, depth, type and name of what lies within ``depth`` steps, three at most, in both directions."""
    start = nodes.where(F.col("id") == node_id).select("id")
    return bfs(edges, start, "both", max(1, min(depth, 3))).select("id", "depth").join(nodes.select("id", "type", "name"), "id")


def overlaps(start: Column, end: Column, ranges: Sequence[tuple[int, int]]) -> Column:
    """Whether lines start..end touch one of the ranges; unknown starts and no ranges do."""
    if not ranges:
        return F.lit(True)
    hit = F.lit(False)
    for low, high in ranges:
        hit = hit | ((start <= high) & (F.coalesce(end, start) >= low))
    return start.isNull() | hit


def discover(nodes: DataFrame, edges: DataFrame, roots: DataFrame, rank: Column, types: Sequence[str], depth: int = 3) -> DataFrame:
    """The tree below the roots (id): parent_id, position, id, type, name, level, down to ``depth`` levels;
    only nodes of the ``types`` are opened."""
    level, open_at = [], roots.select("id").join(nodes.select("id", "type"), "id").where(F.col("type").isin(list(types)))
    for n in range(1, min(depth, MAX_DEPTH) + 1):
        below = children(nodes, edges, open_at, rank)
        level.append(below.select("*", F.lit(n).alias("level")))
        open_at = below.where(F.col("type").isin(list(types))).select("id")
    return reduce(DataFrame.unionByName, level)


def parse_lines(spec: str) -> list[tuple[int, int]]:
    """``10-25,40`` as ranges; parts that are no numbers are left out."""
    out = []
    for part in spec.split(","):
        low, _, high = part.strip().partition("-")
        if low.isdigit() and (not high or high.isdigit()):
            out.append((int(low), int(high or low)))
    return out


def parse_span(spec: str | None) -> tuple[int | None, int | None]:
    """First and last line of N, N-M or N- (to the end); what is none of them is an error."""
    if not spec:
        return None, None
    low, dash, high = spec.strip().partition("-")
    if not low.isdigit() or int(low) < 1 or (high and (not high.isdigit() or int(high) < int(low))):
        raise ValueError(f"lines are N, N-M or N-, not {spec!r}")
    return int(low), int(high) if high else (2**31 - 1 if dash else int(low))


def usages(nodes: DataFrame, edges: DataFrame, symbol: str, depth: int = 2) -> DataFrame:
    """Count of what reaches a node, by the id's first part and type."""
    found = bfs(edges, nodes.where(F.col("id") == symbol).select("id"), "incoming", max(1, min(depth, 5))).join(nodes.select("id", "type"), "id")
    return found.groupBy(F.substring_index("id", ":", 1).alias("scope"), "type").agg(F.count("id").alias("n"))


def children(nodes: DataFrame, edges: DataFrame, parents: DataFrame, rank: Column) -> DataFrame:
    """Contained nodes of the parents in display order: parent_id, position, id, type, name."""
    steps = edges.where("type = 'DEFINES'").select(F.col("source_id").alias("parent_id"), F.col("target_id").alias("id")).distinct()
    rows = among(steps, parents, "parent_id").join(nodes.select("id", "type", "name"), "id")
    order = Window.partitionBy("parent_id").orderBy(rank, "name", "id")
    return rows.select("parent_id", F.row_number().over(order).alias("position"), "id", "type", "name")


def ancestors(edges: DataFrame, ids: DataFrame, most: int = 10) -> DataFrame:
    """The chain of containers of each id: key, id, depth."""
    return bfs(edges.where("type = 'DEFINES'"), ids.select(F.col("id").alias("key"), "id"), "incoming", most).select("key", "id", "depth")


def visible(nodes: DataFrame, hidden_types: Sequence[str] = (), hidden_sub_types: Sequence[str] = (), hidden_communities: Sequence[int] = ()) -> DataFrame:
    """Nodes (id, type, sub_type, community) that no filter hides. Where a type has
    sub-types, those rule: a node without one is hidden only if all of them are."""
    kinds = nodes.where("sub_type IS NOT NULL").groupBy(F.col("type").alias("_type")).agg(F.collect_set(F.concat_ws(":", "type", "sub_type")).alias("_all"))
    joined = nodes.join(kinds, nodes["type"] == kinds["_type"], "left")
    hidden = F.array(*map(F.lit, hidden_sub_types)).cast("array<string>")
    by_sub = F.when(F.col("sub_type").isNotNull(), F.array_contains(hidden, F.concat_ws(":", "type", "sub_type"))).otherwise(F.size(F.array_except("_all", hidden)) == 0)
    hide = F.when(F.col("community").isin(list(hidden_communities)), True).when(F.col("_all").isNotNull(), by_sub).otherwise(F.col("type").isin(list(hidden_types)))
    return joined.where(~F.coalesce(hide, F.lit(False))).select(*nodes.columns)


def communities(edges: DataFrame, rounds: int = 8, parts: int | None = None) -> DataFrame:
    """id, community: label propagation over the collapsed graph. In each round a node
    takes the label with the largest weight among its neighbours and itself, the
    smallest of several; rounds end when nothing changes. Deterministic. ``parts`` as in dealt()."""
    flat = collapsed(edges, parts)
    both = written(flat.select("a", "b", "weight").union(flat.select("b", "a", "weight")).toDF("id", "other", "weight"), "community-edges")
    labels = both.select("id").distinct().withColumn("community", F.col("id"))
    for _ in range(rounds):
        votes = both.join(labels.withColumnRenamed("id", "other"), "other").select("id", "community", "weight").union(labels.select("id", "community", F.lit(1)))
        sums = dealt(votes, parts, "id").groupBy("id", "community").agg(F.sum("weight").alias("w"))
        best = sums.groupBy("id").agg(F.min(F.struct((-F.col("w")).alias("w"), "community")).alias("best")).select("id", F.col("best.community").alias("new"))
        moved = written(labels.join(best, "id").select("id", F.col("new").alias("community"), (F.col("new") != F.col("community")).alias("moved")), "communities")
        labels = moved.select("id", "community")
        if moved.where("moved").isEmpty():
            break
    return labels


def modularity(edges: DataFrame, labels: DataFrame) -> float:
    """Of a partition of the collapsed graph."""
    flat = collapsed(edges)
    own = labels.select(F.col("id").alias("a"), F.col("community").alias("ca"))
    other = labels.select(F.col("id").alias("b"), F.col("community").alias("cb"))
    joined = flat.join(own, "a").join(other, "b")
    per = joined.select(F.explode(F.array(F.struct(F.col("ca").alias("c"), "weight", (F.col("ca") == F.col("cb")).alias("inside")), F.struct(F.col("cb").alias("c"), "weight", F.lit(False).alias("inside")))).alias("x")).groupBy("x.c").agg(F.sum("x.weight").alias("degree"), F.sum(F.when(F.col("x.inside"), F.col("x.weight")).otherwise(0)).alias("inside"))
    total = flat.agg(F.sum("weight").alias("m")).first()["m"] or 1
    return per.agg(F.sum(F.col("inside") / total - (F.col("degree") / (2.0 * total)) ** 2).alias("q")).first()["q"] or 0.0


CONTAINERS = ("Repository", "Repo", "Service", "Module", "Package", "Directory", "Class")


def community_names(labels: DataFrame, nodes: DataFrame, containers: Sequence[str] = CONTAINERS) -> DataFrame:
    """community, name: its first container by type, else the common prefix of its names,
    else the name that most others contain, else its main type in the plural. Names that several
    communities would share get their hub, and a number if they still do."""
    members = nodes.select("id", "type", "name").join(labels, "id")
    priority = F.array_position(F.array(*map(F.lit, containers)), F.col("type"))
    per = members.groupBy("community").agg(
        F.min(F.when(priority > 0, F.struct(priority.alias("p"), F.col("id"), F.col("name")))).alias("container"),
        F.min("name").alias("low"),
        F.max("name").alias("high"),
    )
    from graphloom.operators.communities import hubs as contained  # which needs this module

    hubs = contained(members).select("community", "hub")
    types = members.groupBy("community", "type").agg(F.count("id").alias("n")).groupBy("community").agg(F.min(F.struct((-F.col("n")).alias("n"), "type")).alias("main")).select("community", F.col("main.type").alias("main"))
    prefix = common_prefix(F.col("low"), F.col("high"))
    trimmed = F.when(prefix.contains("/"), F.regexp_replace(prefix, "/[^/]*$", "")).when(prefix.contains("."), F.regexp_replace(prefix, r"[^.]*$", "")).otherwise(prefix)
    named = per.join(hubs, "community", "left").join(types, "community").select(
        "community", F.coalesce(F.col("container.name"), F.when(F.length(trimmed) > 1, trimmed), F.col("hub"), pluralize(F.col("main"))).alias("name")
    )
    shared = named.groupBy("name").agg((F.count(F.lit(1)) > 1).alias("_shared"))
    named = named.join(hubs, "community", "left").join(shared, "name")
    apart = F.col("_shared") & F.col("hub").isNotNull() & ~F.col("name").contains(F.col("hub"))
    named = named.select("community", F.when(apart, F.concat("name", F.lit(" · "), "hub")).otherwise(F.col("name")).alias("name"))
    own = Window.partitionBy("name")
    at, many = F.row_number().over(own.orderBy("community")), F.count(F.lit(1)).over(own)
    named = named.withColumns({"_n": at, "_many": many})
    return named.select("community", F.when(F.col("_many") > 1, F.concat("name", F.lit(" ("), F.col("_n").cast("string"), F.lit(")"))).otherwise(F.col("name")).alias("name"))
