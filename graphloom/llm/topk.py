"""Exact top-k search by inner product with a uniform threshold, in three phases.

Vectors are dealt to cells by the nearest of some centroids (fitted on at most
``FIT_ROWS`` rows; every row is dealt) and packed into blocks, each a row with one
matrix of one cell. A vector's score is the sum of the scores of ``segments`` of its
components; each segment of a block is a local list of scores. Queries are packed alike,
so no pair of rows is ever a row of its own.

1. The blocks of a query's own cell gather the best entries of their local lists with their
   totals. The k-th best total is a safe cutoff: k candidates reach it.
2. The cutoff goes to all blocks. A block has an upper bound from the mean and the
   radius of each of its segments; a query skips the blocks whose bound is below its cutoff.
   In the others, a candidate that reaches the cutoff has at least one segment score of
   cutoff / segments or more; these entries are collected.
3. Their scores are summed up exactly, and those that reach the cutoff, at most the k
   best of a block, go to the final ranking.

The result does not depend on the cells; they say how much is skipped, which
``search_work`` counts.

Defined results: vectors that are null or hold null or non-finite components take no
part, nor do rows with a null id. Shorter vectors count as if they ended with zeros. Rows
that share an id are candidates each, but none of them for a query of that id; queries that
share an id rank their candidates together. Scores that pass 64 bits wrap. Fewer candidates
than k: all are returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import saved, ship

BLOCK_ROWS = 2048
QUERY_ROWS = 512
#: Rows that the centroids are fitted on, rounds of the fit, rows a centroid, and most centroids.
FIT_ROWS, FIT_ROUNDS, CELL_ROWS, MOST_CELLS = 10_000, 8, 2048, 1024
_BLOCK = "cell int, block long, n int, dim int, ids binary, data binary, bounds binary"
_PARTS = ("n", "dim", "ids", "data", "bounds")


def integer_vectors(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id and v, an array<long> of floor(scale * x)."""
    scaled = F.transform(F.col("embedding"), lambda x: x.cast("double") * F.lit(float(scale)))
    clean = ~F.exists("x", lambda y: y.isNull() | F.isnan(y) | (F.abs(y) == float("inf")))
    return (
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), scaled.alias("x"))
        .where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & clean)
        .select("vec_id", F.transform("x", lambda y: F.floor(y).cast("long")).alias("v"))
    )


def matrix(lists: list, dim: int | None = None) -> np.ndarray:
    """Lists as rows, ended with zeros (or cut) to ``dim``."""
    dim = dim or max(1, max(map(len, lists), default=1))
    out = np.zeros((len(lists), dim), np.int64)
    for i, x in enumerate(lists):
        out[i, : len(x)] = x[:dim]
    return out


def fit_centroids(whole: DataFrame, rows: int) -> np.ndarray:
    """Centroids by Lloyd's rounds on at most FIT_ROWS rows."""
    some = whole.sample(min(1.0, 1.2 * FIT_ROWS / max(1, rows)), seed=5).select("v").limit(FIT_ROWS).toArrow()["v"].to_pylist()
    if not some:
        return np.zeros((1, 1))
    data = matrix(some).astype(np.float64)
    count = max(1, min(MOST_CELLS, rows // CELL_ROWS, len(data) // 4))
    centroids = data[np.random.default_rng(5).choice(len(data), count, replace=False)]
    for _ in range(FIT_ROUNDS):
        near = nearest(data, centroids)
        held = np.bincount(near, minlength=count)
        for c in np.nonzero(held)[0].tolist():
            centroids[c] = data[near == c].mean(axis=0)
    return centroids


def nearest(data: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return ((centroids**2).sum(axis=1) - 2 * data @ centroids.T).argmin(axis=1)


def in_cells(whole: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, v and cell."""
    shared = whole.sparkSession.sparkContext.broadcast(centroids)

    @F.pandas_udf("int")
    def cell(vectors: pd.Series) -> pd.Series:
        c = shared.value
        return pd.Series([], dtype="int32") if vectors.empty else pd.Series(nearest(matrix(vectors.tolist(), c.shape[1]).astype(np.float64), c))

    return whole.select("vec_id", "v", cell("v").alias("cell"))


def segment_edges(dim: int, segments: int) -> np.ndarray:
    return np.linspace(0, dim, min(segments, dim) + 1).astype(int)


def pack(df: DataFrame, rows: int, segments: int) -> DataFrame:
    """Rows cell, vec_id, v, in the order of cells, as blocks of at most ``rows`` rows of a cell."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, seq = TaskContext.get().partitionId(), 0

        def block(cell: int, ids: list, lists: list) -> pa.RecordBatch:
            nonlocal seq
            data = matrix(lists)
            dim = data.shape[1]
            kind = np.int16 if data.max(initial=0) < 2**15 and data.min(initial=0) > -(2**15) else np.int64
            real = data.astype(np.float64)
            mean = real.mean(axis=0)
            radii = [np.sqrt(((real[:, a:b] - mean[a:b]) ** 2).sum(axis=1).max()) for a, b in pairwise(segment_edges(dim, segments))]
            out = pd.DataFrame({
                "cell": np.array([cell], np.int32), "block": [task << 32 | seq], "n": np.array([len(lists)], np.int32), "dim": np.array([dim], np.int32),
                "ids": [np.array(ids, np.int64).tobytes()], "data": [kind(0).tobytes() + data.astype(kind).tobytes()], "bounds": [np.concatenate([mean, radii]).tobytes()],
            })
            seq += 1
            return pa.RecordBatch.from_pandas(out, preserve_index=False)

        held, ids, lists = None, [], []
        for batch in batches:
            for cell, vec_id, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if ids and (cell != held or len(ids) == rows):
                    yield block(held, ids, lists)
                    ids, lists = [], []
                held = cell
                ids.append(vec_id)
                lists.append(v)
        if ids:
            yield block(held, ids, lists)

    return df.select("cell", "vec_id", "v").mapInArrow(blocks, _BLOCK)


def unpack(n: int, dim: int, ids: bytes, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Ids and matrix. The data start with a zero of their own type."""
    kind = np.int16 if len(data) == 2 * (n * dim + 1) else np.int64
    return np.frombuffer(ids, np.int64), np.frombuffer(data, kind)[1:].reshape(n, dim)


def segment_scores(queries: np.ndarray, vectors: np.ndarray, segments: int) -> list[np.ndarray]:
    """Exact inner products by segment of the components, queries x vectors."""
    dim = max(queries.shape[1], vectors.shape[1])
    q, v = (np.pad(x, ((0, 0), (0, dim - x.shape[1]))) for x in (queries, vectors))
    most = float(np.abs(q.astype(np.float64)).max(initial=0)) * float(np.abs(v.astype(np.float64)).max(initial=0)) * dim
    kind = np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64
    q, v = q.astype(kind), v.astype(kind)
    edges = segment_edges(dim, segments)
    return [q[:, a:b] @ v[:, a:b].T for a, b in zip(edges[:-1], edges[1:], strict=True)]


def upper_bounds(queries: np.ndarray, bounds: bytes, dim: int, segments: int) -> np.ndarray:
    """For each query, what no vector of a block scores more than: in each segment the score of
    the mean and the query's length times the radius."""
    stats = np.frombuffer(bounds)
    mean, radii = stats[:dim], stats[dim:]
    q = np.zeros((len(queries), dim))
    q[:, : min(dim, queries.shape[1])] = queries[:, :dim]
    out = q @ mean
    for r, (a, b) in zip(radii, pairwise(segment_edges(dim, segments)), strict=True):
        out += np.sqrt((q[:, a:b] ** 2).sum(axis=1)) * r
    return out + 1e-9 * np.abs(out) + 1e-6  # room for rounding


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest scores of each row, in no order."""
    return np.argpartition(-scores, k - 1, axis=1)[:, :k] if scores.shape[1] > k else np.broadcast_to(np.arange(scores.shape[1]), scores.shape)


def _first(k: int, row: np.ndarray, *order: np.ndarray) -> np.ndarray:
    """Places of the first k entries of each row in the given order."""
    at = np.lexsort((*order[::-1], row))
    own = row[at]
    return at[np.arange(len(at)) - np.searchsorted(own, own) < k]


def gathered(ids: np.ndarray, v: np.ndarray, qids: np.ndarray, q: np.ndarray, segments: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Phase 1 in a block: the places of queries and the totals of the best entries of their local lists, at most k each."""
    parts = segment_scores(q, v, segments)
    best = np.concatenate([_best(p, k) for p in parts], axis=1)
    best.sort(axis=1)
    total = sum(np.take_along_axis(p, best, 1) for p in parts).astype(np.int64)
    use = ids[best] != qids[:, None]
    use[:, 1:] &= best[:, 1:] != best[:, :-1]
    row, col = np.nonzero(use)
    score = total[row, col]
    at = _first(k, row, -score)
    return row[at], score[at]


def sufficient(ids: np.ndarray, v: np.ndarray, bounds: bytes, qids: np.ndarray, q: np.ndarray, low: np.ndarray, segments: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, int]:
    """Phases 2 and 3 in a block: places of queries, scores and ids of what reaches the cutoffs, at most k
    of each query; how many pairs were not skipped as a block, and how many scores were resolved."""
    some = np.nonzero(upper_bounds(q, bounds, v.shape[1], segments) >= low)[0]
    if not len(some):
        return some, some, some, 0, 0
    parts = segment_scores(q[some], v, segments)
    share = (low[some] // len(parts)).astype(parts[0].dtype)[:, None]  # rounded down, so nothing is lost
    enough = parts[0] >= share
    for p in parts[1:]:
        enough |= p >= share
    enough &= ids != qids[some][:, None]
    row, col = np.nonzero(enough)
    score = sum(p[row, col] for p in parts).astype(np.int64)
    reach = score >= low[some][row]
    found, score, col = some[row[reach]], score[reach], col[reach]
    at = _first(k, found, -score, ids[col])
    return found[at], score[at], ids[col[at]], len(some) * len(ids), len(row)


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(r["n"], r["block"])), pa.array(np.arange(r["n"], dtype=np.int32))], ["block", "at"])


def _search(vectors: DataFrame, k: int, query_mod: int, scale: int, segments: int) -> DataFrame:
    """query_id, score, vec_id, at most k of each query and block, and rows with pairs (not
    skipped as a block) and resolved (scores summed up)."""
    spark = vectors.sparkSession
    ship(spark)
    whole = saved(integer_vectors(vectors, scale), "topk-vectors")
    dealt = saved(in_cells(whole, fit_centroids(whole, whole.count())), "topk-cells")
    salts = saved(dealt.groupBy("cell").agg(F.ceil(F.count("v") / (16 * BLOCK_ROWS)).alias("salts")), "topk-salts")
    dealt = dealt.join(F.broadcast(salts), "cell")  # a row for each of at most MOST_CELLS cells

    def packed(rows: DataFrame, size: int, name: str) -> DataFrame:
        spread = rows.repartition("cell", F.pmod(F.xxhash64("vec_id"), "salts")).sortWithinPartitions("cell")
        return saved(pack(spread, size, segments), name)

    blocks = packed(dealt, BLOCK_ROWS, "topk-blocks")
    queries = packed(dealt.where(F.col("vec_id") % query_mod == 0), QUERY_ROWS, "topk-queries")
    left = blocks.select("cell", "block", *[F.col(c).alias(f"b_{c}") for c in _PARTS])
    right = queries.select("cell", F.col("block").alias("q_block"), *[F.col(c).alias(f"q_{c}") for c in _PARTS])
    cols = [f"{s}_{c}" for s in "bq" for c in _PARTS]

    # plain UDFs, for a row is a whole block: Spark hands them over a hundred at a time
    # whatever their size, while an Arrow batch would hold ten thousand
    @F.udf("array<struct<at:int,score:long>>", useArrow=False)
    def local_lists(*block):
        (ids, v), (qids, q) = unpack(*block[:4]), unpack(*block[5:9])
        row, score = gathered(ids, v, qids, q, segments, k)
        return list(zip(row.tolist(), score.tolist(), strict=True))

    best = Window.partitionBy("q_block", "at").orderBy(F.col("score").desc())
    lists = left.join(right, "cell").select("q_block", F.explode(local_lists(*cols)).alias("x")).select("q_block", "x.at", "x.score")
    cut = (
        lists.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)
        .groupBy("q_block", "at").agg(F.when(F.count("score") == k, F.min("score")).alias("cutoff"))
    )
    # the cutoffs go back packed like the queries: a map would be driver state
    armed = (
        queries.select("block", "n").mapInArrow(_members, "block long, at int").withColumnRenamed("block", "q_block")
        .join(cut, ["q_block", "at"], "left")
        .groupBy("q_block").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "cutoff"))), lambda x: x["cutoff"]).alias("cutoffs"))
    )
    armed = saved(armed, "topk-cutoffs")

    @F.udf("struct<pairs:long,resolved:long,found:array<struct<query_id:long,score:long,vec_id:long>>>", useArrow=False)
    def above_cutoff(*block):
        (ids, v), (qids, q) = unpack(*block[:4]), unpack(*block[5:9])
        low = np.array([-(2**63) if c is None else c for c in block[10]], np.int64)
        row, score, vec, pairs, resolved = sufficient(ids, v, block[4], qids, q, low, segments, k)
        return pairs, resolved, list(zip(qids[row].tolist(), score.tolist(), vec.tolist(), strict=True))

    lanes = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), blocks.count()))
    here = left.withColumn("lane", F.pmod(F.xxhash64("block"), F.lit(lanes)).cast("int")).drop("cell")
    there = right.join(armed, "q_block").withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1)))).drop("cell")
    return here.join(there, "lane").select(above_cutoff(*cols, "cutoffs").alias("x")).select("x.*")


def top_k(vectors: DataFrame, k: int = 20, query_mod: int = 20, scale: int = 64, segments: int = 4) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all other vectors for each vector
    whose id is divisible by ``query_mod``, ties to the smaller vec_id."""
    final = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    found = _search(vectors, k, query_mod, scale, segments).select(F.explode("found").alias("x")).select("x.*")
    return found.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search_work(vectors: DataFrame, k: int = 20, query_mod: int = 20, scale: int = 64, segments: int = 4) -> DataFrame:
    """pairs (of a query and a vector in blocks that were not skipped) and resolved (scores summed up)."""
    found = _search(vectors, k, query_mod, scale, segments)
    return found.agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"), F.coalesce(F.sum("resolved"), F.lit(0)).alias("resolved"))
