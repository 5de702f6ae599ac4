"""Louvain against a plain one, hubs against brute force."""

import random

from graphloom.operators.communities import hubs, louvain
from graphloom.operators.graph import modularity


def edge_table(spark, pairs):
    return spark.createDataFrame([(f"e{i}", "CALLS", a, b) for i, (a, b) in enumerate(pairs)], "id string, type string, source_id string, target_id string")


def plain_quality(weights, labels, resolution=1.0):
    whole = 2 * sum(weights.values())
    degree, inside = {}, 0
    for (a, b), w in weights.items():
        inside += 2 * w * (labels[a] == labels[b])
        for x in (a, b):
            degree[labels[x]] = degree.get(labels[x], 0) + w
    return inside / whole - resolution * sum((d / whole) ** 2 for d in degree.values())


def plain_louvain(pairs, seed=0):
    """One node at a time, level by level, with the modularity worked out anew for what it may change."""
    weights = {}
    for a, b in pairs:
        if a != b:
            weights[min(a, b), max(a, b)] = weights.get((min(a, b), max(a, b)), 0) + 1
    names = sorted({x for e in weights for x in e})
    groups = {x: [x] for x in names}
    labels = {x: x for x in names}
    draw = random.Random(seed)
    while True:
        near = {g: {} for g in groups}
        degree = dict.fromkeys(groups, 0)
        home = {x: g for g, xs in groups.items() for x in xs}
        for (a, b), w in weights.items():
            a, b = home[a], home[b]
            degree[a] += w
            degree[b] += w
            if a != b:
                near[a][b] = near[a].get(b, 0) + w
                near[b][a] = near[b].get(a, 0) + w
        whole = sum(degree.values())
        place = {g: g for g in groups}
        total = dict(degree)
        moved = True
        while moved:
            moved = False
            order = sorted(groups)
            draw.shuffle(order)
            for g in order:
                total[place[g]] -= degree[g]
                into = {}
                for h, w in near[g].items():
                    into[place[h]] = into.get(place[h], 0) + w
                gain = lambda c: into.get(c, 0) - degree[g] * total[c] / whole  # noqa: B023, E731
                best = max([place[g], *into], key=lambda c: (round(gain(c), 9), c == place[g]))
                if best != place[g]:
                    place[g], moved = best, True
                total[best] += degree[g]
        merged = {}
        for g, xs in groups.items():
            merged.setdefault(place[g], []).extend(xs)
        if len(merged) == len(groups):
            break
        groups = merged
        labels = {x: g for g, xs in groups.items() for x in xs}
    return plain_quality(weights, labels)


def cliques(n, size):
    pairs = [(f"c{c}_{i}", f"c{c}_{j}") for c in range(n) for i in range(size) for j in range(i)]
    return pairs + [(f"c{c}_0", f"c{(c + 1) % n}_1") for c in range(n)]


def planted(groups, size, inside, across, seed):
    draw = random.Random(seed)
    names = [(g, f"p{g}_{i}") for g in range(groups) for i in range(size)]
    return [(a, b) for k, (g, a) in enumerate(names) for h, b in names[:k] if draw.random() < (inside if g == h else across)]


def random_pairs(n, m, seed):
    draw = random.Random(seed)
    return [(f"r{draw.randrange(n)}", f"r{draw.randrange(n)}") for _ in range(m)]


def test_louvain_is_no_worse_than_a_plain_one(spark):
    for pairs in (cliques(8, 5), planted(4, 12, 0.6, 0.05, 1), random_pairs(40, 90, 5)):
        found = louvain(edge_table(spark, pairs))
        assert found.settled
        assert abs(found.modularity - modularity(edge_table(spark, pairs), found.labels)) < 1e-9
        assert found.modularity >= plain_louvain(pairs) - 1e-9, (found.modularity, plain_louvain(pairs))


def test_louvain_finds_cliques_and_reports_its_end(spark):
    pairs = [*cliques(6, 5), ("c0_0", "c0_0"), ("c0_1", "c0_2"), ("c1_1", "gone")]
    nodes = spark.createDataFrame([(x,) for x in sorted({x for p in cliques(6, 5) for x in p} | {"alone"})], "id string")
    found = louvain(edge_table(spark, pairs), nodes)
    labels = {r["id"]: r["community"] for r in found.labels.collect()}
    assert labels["alone"] == "alone" and "gone" not in labels
    assert {labels[f"c{c}_{i}"] for c in range(6) for i in range(5)} == {f"c{c}_0" for c in range(6)}
    assert all(labels[f"c{c}_{i}"] == f"c{c}_0" for c in range(6) for i in range(5))
    stopped = louvain(edge_table(spark, pairs), nodes, rounds=1, levels=1, passes=1)
    assert not stopped.settled and stopped.rounds == 2
    fine = louvain(edge_table(spark, pairs), nodes, resolution=40.0)
    assert len({r["community"] for r in fine.labels.collect()}) > 7


def test_louvain_of_nothing(spark):
    found = louvain(edge_table(spark, [("a", "a")]))
    assert found.labels.collect() == [] and found.modularity == 0.0 and found.settled


def brute_hub(names):
    names = [n for n in names if n is not None]
    if not names:
        return None
    long = [n for n in names if len(n) > 1]
    if not long:
        return min(names, key=lambda n: (len(n), n)), 0
    score = {n: sum(n.lower() in other.lower() for other in names) - 1 for n in long}
    best = min(long, key=lambda n: (-score[n], len(n), n))
    return best, score[best]


def test_hubs_equal_brute_force(spark):
    draw = random.Random(8)
    groups = {g: ["".join(draw.choices("abAB_é", k=draw.randint(1, 6))) for _ in range(draw.randint(1, 40))] for g in range(12)}
    groups |= {90: ["x", "y"], 91: [None, "q"], 92: ["Same", "same", "Same", "sameness"], 93: ["a" * 60, "a" * 59, "b"]}
    rows = [(g, n) for g, ns in groups.items() for n in ns]
    got = {r["community"]: (r["hub"], r["score"]) for r in hubs(spark.createDataFrame(rows, "community int, name string")).collect()}
    assert got == {g: brute_hub(ns) for g, ns in groups.items() if brute_hub(ns)}
