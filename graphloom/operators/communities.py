"""Louvain communities and the names that stand for them.

A level moves nodes between communities in rounds. In a round each node sees the weight of its edges into each
neighboring community and picks the one with the largest gain in modularity. A hashed half of those
that gain by a move make it, for two neighbors that move at once may spoil each other's gain; a round
that lowers the modularity is taken back and a smaller share moves next. When no node gains by a
move, communities become the nodes of a smaller graph and the next level begins. When levels end,
the nodes of the whole graph may move once more from where they are, and levels follow again.

Everything is joins and sums. The state of a round is a written table, so lineages stay short, and only
counts and the modularity come to the driver. Deterministic: ties go to the smaller community.
Nodes of one neighbor are first folded into it, which loses no modularity, so that rounds run over the others only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.graph import collapsed, induced_edges
from graphloom.session import written

#: Gains below this are none.
EPSILON = 1e-9
#: The smallest share of nodes that may move in a round is one of so many.
SMALLEST_SHARE = 64


@dataclass
class Louvain:
    """labels: id, community (the smallest member's id). ``rounds`` and ``levels`` say how many there
    were; ``settled`` is false if the last level was stopped before its nodes stood still."""

    labels: DataFrame
    modularity: float
    levels: int
    rounds: int
    settled: bool


def _toward(links: DataFrame, labels: DataFrame) -> DataFrame:
    """id, community, w: the weight of a node's edges into each community that it touches, itself left out."""
    ends = labels.select(F.col("id").alias("other"), "community")
    return written(links.join(ends, "other").groupBy("id", "community").agg(F.sum("weight").alias("w")), "louvain-toward")


def _quality(nodes: DataFrame, toward: DataFrame, labels: DataFrame, whole: float, resolution: float) -> float:
    """Modularity; ``whole`` is twice the weight of all edges."""
    inside = toward.join(labels, ["id", "community"]).agg(F.sum("w").alias("w")).select(F.coalesce("w", F.lit(0)).cast("double").alias("w")).first()["w"]
    per = nodes.join(labels, "id").groupBy("community").agg(F.sum("k").alias("k"), F.sum("loop").alias("loop"))
    loops, squares = per.agg(F.sum("loop").cast("double"), F.sum((F.col("k") / whole) ** 2)).first()
    return (inside + loops) / whole - resolution * squares


def _wishes(nodes: DataFrame, toward: DataFrame, labels: DataFrame, whole: float, resolution: float) -> DataFrame:
    """id, community, wish: the own community and the best one, null where no move gains."""
    placed = nodes.join(labels, "id")
    totals = placed.groupBy("community").agg(F.sum("k").alias("total"))
    own = placed.select("id", "k", F.col("community").alias("own"))
    options = toward.unionByName(labels.withColumn("w", F.lit(0).cast(toward.schema["w"].dataType))).groupBy("id", "community").agg(F.sum("w").alias("w"))
    options = options.join(totals, "community").join(own, "id")
    here = F.col("community") == F.col("own")
    gain = F.col("w") - resolution * F.col("k") * (F.col("total") - F.when(here, F.col("k")).otherwise(0)) / whole
    options = options.select("id", "own", "community", F.round(gain, 9).alias("gain"), here.alias("here"))
    best = options.groupBy("id", "own").agg(F.min(F.struct((-F.col("gain")).alias("loss"), "community")).alias("best"), F.max(F.when(F.col("here"), F.col("gain"))).alias("stay"))
    better = -F.col("best.loss") > F.col("stay") + EPSILON
    return best.select("id", F.col("own").alias("community"), F.when(better, F.col("best.community")).alias("wish"))


def _settle(nodes: DataFrame, links: DataFrame, labels: DataFrame, whole: float, resolution: float, most: int) -> tuple[DataFrame, float, int, bool]:
    """Move nodes until none gains: labels, modularity, rounds, and whether they stand still."""
    toward = _toward(links, labels)
    quality, share = _quality(nodes, toward, labels, whole, resolution), 2
    for n in range(most):
        wishes = written(_wishes(nodes, toward, labels, whole, resolution), "louvain-wishes")
        turn = F.pmod(F.xxhash64("id", F.lit(n)), F.lit(share)) == 0
        moves = turn & F.col("wish").isNotNull()
        wished, moving = wishes.agg(F.count("wish"), F.count_if(moves)).first()
        if not wished:
            return labels, quality, n, True
        if not moving:
            continue
        tried = written(wishes.select("id", F.when(moves, F.col("wish")).otherwise(F.col("community")).alias("community")), "louvain-labels")
        seen = _toward(links, tried)
        q = _quality(nodes, seen, tried, whole, resolution)
        if q > quality + EPSILON / 1000:
            labels, toward, quality, share = tried, seen, q, max(2, share // 2)
        elif share < SMALLEST_SHARE:
            share *= 2
    return labels, quality, most, False


def _contracted(nodes: DataFrame, links: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Communities as nodes: what lies inside becomes a loop, edges between two are summed."""
    ends = links.join(labels, "id").select("other", F.col("community").alias("a"), "weight")
    ends = written(ends.join(labels.select(F.col("id").alias("other"), F.col("community").alias("b")), "other").groupBy("a", "b").agg(F.sum("weight").alias("weight")), "louvain-between")
    inner = ends.where("a = b").select(F.col("a").alias("community"), F.col("weight").alias("_inner"))
    loops = nodes.join(labels, "id").groupBy("community").agg(F.sum("k").alias("k"), F.sum("loop").alias("loop")).join(inner, "community", "left")
    smaller = written(loops.select(F.col("community").alias("id"), "k", (F.col("loop") + F.coalesce("_inner", F.lit(0))).alias("loop")), "louvain-nodes")
    return smaller, ends.where("a <> b").select(F.col("a").alias("id"), F.col("b").alias("other"), "weight")


def _folded(links: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Leaves (id, host), the other nodes (id, k, loop) and the links among these. A leaf has one neighbor, whose community no
    partition of the largest modularity parts it from: leaving it gains nothing at a resolution of 1 or less. So leaves are
    loops of their hosts. Of two nodes that have each other only, the smaller is the host."""
    # a node's neighbor goes with it, so that the smaller of two leaves is known without another look at the links
    ends = links.groupBy("id").agg(F.sum("weight").alias("k"), F.count("other").alias("n"), F.min("other").alias("host"))
    ends = written(ends, "louvain-ends")
    lone = ends.where("n = 1").select("id", "host", "k")
    pairs = lone.select(F.col("host").alias("id"), F.col("id").alias("host"))
    leaves = written(lone.join(pairs, ["id", "host"], "left_anti").unionByName(lone.join(pairs, ["id", "host"], "left_semi").where("host < id")), "louvain-leaves")
    taken = leaves.groupBy(F.col("host").alias("id")).agg(F.sum("k").alias("_k"))
    rest = ends.select("id", "k").join(leaves.select("id"), "id", "left_anti").join(taken, "id", "left")
    more = F.coalesce("_k", F.lit(0))
    nodes = written(rest.select("id", (F.col("k") + more).alias("k"), (2 * more).alias("loop")), "louvain-nodes")
    gone = leaves.select("id")
    # the link to a leaf goes as the leaf's own does: its other end is the leaf
    kept = links.join(gone, "id", "left_anti").join(gone.withColumnRenamed("id", "other"), "other", "left_anti").select("id", "other", "weight")
    return leaves.select("id", "host"), nodes, written(kept, "louvain-links")


def louvain(edges: DataFrame, nodes: DataFrame | None = None, resolution: float = 1.0, rounds: int = 40, levels: int = 12, passes: int = 2) -> Louvain:
    """Communities of the undirected simple graph: parallel edges are summed, loops dropped, and, where nodes
    (id) are given, edges without both ends too, while nodes without edges are alone. ``rounds`` bounds a level, ``levels``
    a pass; a pass goes from single nodes up, and later passes start from the communities of the one before."""
    flat = collapsed(induced_edges(edges, nodes) if nodes is not None else edges)
    links = written(flat.select("a", "b", "weight").union(flat.select("b", "a", "weight")).toDF("id", "other", "weight"), "louvain-links")
    leaves = None
    if resolution <= 1:
        leaves, base, links = _folded(links)
    else:
        base = written(links.groupBy("id").agg(F.sum("weight").alias("k")).withColumn("loop", F.lit(0).cast("long")), "louvain-nodes")
    whole = float(base.agg(F.sum("k")).first()[0] or 0)
    found = base.select("id", F.col("id").alias("community"))
    quality, spent, height, still = 0.0, 0, 0, True
    if whole:
        quality = -1.0
        for _ in range(passes):
            labels, q, n, still = _settle(base, links, found, whole, resolution, rounds)
            spent, height = spent + n, height + 1
            level_nodes, level_links = base, links
            steps, current = labels, labels
            for _ in range(levels):
                level_nodes, level_links = _contracted(level_nodes, level_links, current)
                current, better, n, still = _settle(level_nodes, level_links, level_nodes.select("id", F.col("id").alias("community")), whole, resolution, rounds)
                spent, height = spent + n, height + 1
                if better <= q + EPSILON:
                    break
                q = better
                up = current.select(F.col("id").alias("community"), F.col("community").alias("_up"))
                steps = written(steps.join(up, "community").select("id", F.col("_up").alias("community")), "louvain-steps")
            if q <= quality + EPSILON:
                break
            found, quality = steps, q
    if leaves is not None:
        found = written(found.unionByName(leaves.join(found.withColumnRenamed("id", "host"), "host").select("id", "community")), "louvain-found")
    heads = found.groupBy("community").agg(F.min("id").alias("head"))
    named = found.join(heads, "community").select("id", F.col("head").alias("community"))
    if nodes is not None:
        named = nodes.select("id").join(named, "id", "left").select("id", F.coalesce("community", "id").alias("community"))
    return Louvain(named, quality, height, spent, still)


def hubs(members: DataFrame) -> DataFrame:
    """community, hub, score of members (community, name): the name that most other members' names contain, in any case;
    the shorter of several, then the first. Names of one letter count only where there are no others. A name contains
    another if one of its stretches of that length equals it, so containment is an equality join of distinct names with
    the stretches of distinct names, at the lengths that occur in the community."""
    named = members.where("name is not null").groupBy("community", "name").agg(F.count(F.lit(1)).alias("n")).withColumn("low", F.lower("name"))
    long = named.where(F.length("low") > 1)
    lows = written(long.groupBy("community", "low").agg(F.sum("n").alias("n")), "hub-names")
    lengths = lows.groupBy("community").agg(F.collect_set(F.length("low")).alias("lengths"))  # bounded by the longest name
    fitting = F.filter("lengths", lambda m: m <= F.length("low"))
    stretches = F.array_distinct(F.flatten(F.transform(fitting, lambda m: F.transform(F.sequence(F.lit(1), F.length("low") - m + 1), lambda i: F.col("low").substr(i, m)))))
    parts = lows.join(lengths, "community").select("community", "n", F.explode(stretches).alias("low"))
    scores = lows.select("community", "low").join(parts, ["community", "low"]).groupBy("community", "low").agg((F.sum("n") - 1).alias("score"))
    ranked = long.join(scores, ["community", "low"])
    best = ranked.groupBy("community").agg(F.min(F.struct((-F.col("score")).alias("s"), F.length("name").alias("len"), "name")).alias("b"))
    best = best.select("community", F.col("b.name").alias("hub"), (-F.col("b.s")).alias("score"))
    tiny = named.join(best, "community", "left_anti").groupBy("community").agg(F.min(F.struct(F.length("name").alias("len"), "name")).alias("b"))
    return best.unionByName(tiny.select("community", F.col("b.name").alias("hub"), F.lit(0).cast("long").alias("score")))
