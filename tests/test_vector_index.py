"""A stored vector index against an exact scan."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.operators import vector_index
from graphloom.operators.vector_index import VectorIndex

WIDTH = 16


def table(spark, first, n, seed, centers=40):
    rng = np.random.default_rng(seed)
    around = np.random.default_rng(1).standard_normal((centers, WIDTH)) * 2
    rows = around[rng.integers(centers, size=n)] + rng.standard_normal((n, WIDTH))
    return spark.createDataFrame([(first + i, r.tolist()) for i, r in enumerate(rows.astype(np.float32))], "id long, vec array<float>")


def brute(vectors, queries, k):
    """query_id, id of the k nearest, worked out in numpy."""
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in vectors.items()}
    out = {}
    for q, v in queries.items():
        v = np.array(v) / np.linalg.norm(v)
        out[q] = sorted(unit, key=lambda i: (-round(float(unit[i] @ v), 9), i))[:k]
    return {(q, i) for q, own in out.items() for i in own}


def read(df):
    return {r[0]: r["vec"] for r in df.collect()}


def test_recall_share_and_exact_search(spark, tmp_path):
    vectors = table(spark, 0, 4000, 5)
    queries = table(spark, 0, 25, 6).withColumnRenamed("id", "query_id")
    index = VectorIndex.build(vectors, str(tmp_path / "index"))
    truth = brute(read(vectors), read(queries), 10)
    want = spark.createDataFrame(sorted(truth), "query_id long, id long")
    assert vector_index.recall(index.search(queries, 10), want) >= 0.9
    assert vector_index.recall(index.search(queries, 10, probes=1), want) < 1
    shares = [r["share"] for r in index.reads(queries).collect()]
    assert len(shares) == 25 and max(shares) < 0.4
    assert {(r["query_id"], r["id"]) for r in index.exact(queries, 10, probes=1).collect()} == truth


def test_batches_replace_and_remove_without_touching_earlier_files(spark, tmp_path):
    root = str(tmp_path / "index")
    one = table(spark, 0, 600, 7)
    index = VectorIndex.build(one, root)
    files = {os.path.join(at, n): os.path.getmtime(os.path.join(at, n)) for at, _, names in os.walk(f"{root}/rows") for n in names}
    two = table(spark, 590, 50, 8)
    index.add(two)
    index.remove(spark.createDataFrame([(3,), (595,), (9999,)], "id long"))
    index.add(table(spark, 3, 1, 9))
    assert all(os.path.getmtime(f) == t for f, t in files.items())
    have = read(one) | read(two)
    have = {i: v for i, v in have.items() if i not in (3, 595)} | read(table(spark, 3, 1, 9))
    queries = table(spark, 0, 12, 10).withColumnRenamed("id", "query_id")
    again = VectorIndex(spark, root)
    assert {(r["query_id"], r["id"]) for r in again.exact(queries, 7).collect()} == brute(have, read(queries), 7)
    scores = [r["score"] for r in vector_index.nearest(again, list(have[3]), 3, probes=100).collect()]
    assert scores[0] == pytest.approx(1) and scores == sorted(scores, reverse=True)


def test_odd_vectors_ties_and_too_many_queries(spark, tmp_path):
    rows = [("a", [1.0, 0.0]), ("b", [2.0, 0.0]), ("c", [0.0, 0.0]), ("d", None), ("e", [1.0]), ("f", [float("nan"), 1.0]), ("g", [None, 1.0]), (None, [1.0, 1.0]), ("h", [0.0, 1.0]), ("h", [0.0, 1.0])]
    index = VectorIndex.build(spark.createDataFrame(rows, "id string, vec array<float>"), str(tmp_path / "index"))
    queries = spark.createDataFrame([("x", [1.0, 0.0]), ("zero", [0.0, 0.0]), ("none", None)], "query_id string, vec array<float>")
    for found in (index.search(queries, 2), index.exact(queries, 2)):
        assert [(r["query_id"], r["rank"], r["id"]) for r in found.orderBy("rank").collect()] == [("x", 1, "a"), ("x", 2, "b")]
    assert index.search(queries, 9).count() == 3 and index.exact(queries, 9).count() == 3
    with pytest.raises(ValueError, match="queries"):
        index.search(spark.range(vector_index.MOST_QUERIES + 1).select(F.col("id").alias("query_id"), F.array(F.lit(1.0), F.lit(2.0)).alias("vec")))
    with pytest.raises(ValueError, match="no vectors"):
        VectorIndex.build(spark.createDataFrame([], "id long, vec array<float>"), str(tmp_path / "none"))
