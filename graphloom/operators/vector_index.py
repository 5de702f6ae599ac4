"""A stored index of vectors: cells around centroids, codes of one byte a component, exact scores at the end.

Rows lie in folders of their batch and cell, so a search opens the folders of the cells it probes and no others. It
scores codes in numpy, keeps what may be among the best, and works out exact cosines for these alone. Batches are
added without touching earlier ones; a vector that comes again hides the earlier one by an entry in ``gone``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.operators.search import cosine

#: Vectors that centroids are fitted on, those of the smallest hashes; every vector is indexed.
FIT_ROWS, ROWS_A_CENTROID = 20_000, 8
#: Queries of one search: they and their cells are broadcast.
MOST_QUERIES = 4096
#: Candidates by code for each result asked for.
SPARE = 4
PLACED = "cell int, code binary, scale float, error float, angle float"


def units(vectors: pd.Series, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of unit length, and which of the vectors have one: those of the index's width, finite and not zero."""
    fit = np.array([v is not None and len(v) == width for v in vectors], bool)
    out = np.zeros((len(vectors), width))
    if fit.any():
        out[fit] = np.array([[np.nan if x is None else x for x in v] for v in vectors[fit]], float)
    with np.errstate(over="ignore"):
        size = np.linalg.norm(out, axis=1)
    fit &= np.isfinite(size) & (size > 0)
    out[fit] /= size[fit, None]
    out[~fit] = 0
    return out, fit


class VectorIndex:
    """Vectors (id, vec) under a folder.

    Vectors that are null, zero, not finite or of another length than the index's take no part. Of rows with the same id
    in a batch the one with the greatest vector counts, of batches the last. A batch counts once its sizes are written,
    so one that failed is as if it had not been; writers are one at a time.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        rows = spark.read.parquet(f"{self.root}/centroids").orderBy("cell").collect()
        self.centroids = np.array([r["vec"] for r in rows])
        self._columns = spark.read.parquet(f"{self.root}/ids").schema

    @classmethod
    def build(cls, vectors: DataFrame, root: str, cells: int | None = None, fit_rows: int = FIT_ROWS, seed: int = 11) -> VectorIndex:
        """Fit centroids on a bounded sample, about the square root of the number of vectors, and index all vectors."""
        spark = vectors.sparkSession
        width = vectors.where("vec IS NOT NULL AND size(vec) > 0").groupBy(F.size("vec").alias("d")).count().orderBy(F.col("count").desc(), "d").first()
        if width is None:
            raise ValueError("no vectors to fit centroids on")
        size = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
        clean = vectors.where((F.size("vec") == width["d"]) & (size > 0) & (size < float("inf")))
        sample = clean.orderBy(F.xxhash64("id"), "id").limit(fit_rows).select(array_to_vector(F.transform("vec", lambda x: x / size)).alias("features"))
        n = min(width["count"], fit_rows)
        k = max(1, min(cells or round(width["count"] ** 0.5), n // ROWS_A_CENTROID))
        sample = sample.repartition(max(1, min(spark.sparkContext.defaultParallelism, n // 1000))).cache()
        try:
            centers = KMeans(k=k, seed=seed, maxIter=10).fit(sample).clusterCenters() if k > 1 else [np.mean([r["features"].toArray() for r in sample.collect()], axis=0)]
        finally:
            sample.unpersist()
        centers = [c / s for c in centers if (s := np.linalg.norm(c)) > 0] or [np.eye(width["d"])[0]]
        spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centers)], "cell int, vec array<double>").coalesce(1).write.parquet(f"{root}/centroids")
        vectors.select("id").where("false").write.parquet(f"{root}/ids")
        index = cls(spark, root)
        index.add(vectors)
        return index

    # batches

    def _sizes(self) -> DataFrame:
        return self.spark.read.schema("cell int, n long, angle float, batch int").parquet(f"{self.root}/sizes/*")

    def _batches(self) -> list[int]:
        try:
            return sorted(r["batch"] for r in self._sizes().select("batch").distinct().collect())
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" in str(e):
                return []
            raise

    def _rows(self) -> DataFrame | None:
        batches = self._batches()
        if not batches:
            return None
        kind = self._columns["id"].dataType.simpleString()
        schema = f"id {kind}, vec array<float>, code binary, scale float, error float, batch int, cell int"
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/rows").parquet(*[f"{self.root}/rows/batch={b}" for b in batches])

    def _living(self, rows: DataFrame) -> DataFrame:
        """rows (id, batch, ...) that no later batch hides."""
        kind = self._columns["id"].dataType.simpleString()
        hidden = self.spark.read.schema(f"id {kind}, before int").parquet(*[f"{self.root}/gone/batch={b}" for b in self._batches()]).groupBy("id").agg(F.max("before").alias("before"))
        return rows.join(hidden, "id", "left").where("before IS NULL OR batch >= before").drop("before")

    def add(self, vectors: DataFrame) -> int:
        """Add vectors, in place of those with the same id, as a batch; its number."""
        shared, width = self.spark.sparkContext.broadcast(self.centroids), self.centroids.shape[1]

        @F.pandas_udf(PLACED)
        def placed(vecs: pd.Series) -> pd.DataFrame:
            rows, fit = units(vecs, width)
            near = rows @ shared.value.T
            cell = near.argmax(axis=1)
            scale = np.abs(rows).max(axis=1) / 127
            code = np.rint(rows / np.where(scale > 0, scale, 1)[:, None]).astype(np.int8)
            error = np.linalg.norm(rows - code * scale[:, None], axis=1) + 1e-6
            angle = np.arccos(near.max(axis=1).clip(-1, 1)) + 1e-4
            out = pd.DataFrame({"cell": pd.Series(cell, dtype="Int32"), "code": [c.tobytes() for c in code], "scale": scale, "error": error, "angle": angle})
            out.loc[~fit, "cell"] = pd.NA
            return out

        batches, own = self._batches(), vectors.where("id IS NOT NULL").groupBy("id").agg(F.max(F.col("vec").cast("array<float>")).alias("vec"))
        batch = batches[-1] + 1 if batches else 0
        rows = own.withColumn("at", placed("vec")).where("at.cell IS NOT NULL").select("id", "vec", "at.*")
        path = f"{self.root}/rows/batch={batch}"
        # rebalanced: a cell with many vectors is cut into several files, small ones go together
        rows.hint("rebalance", "cell").sortWithinPartitions("cell").write.mode("overwrite").partitionBy("cell").parquet(path)
        self._hide(own.select("id") if batches else None, batch)
        back = self.spark.read.schema("angle float, cell int").parquet(path)
        self._finish(back.groupBy("cell").agg(F.count("cell").alias("n"), F.max("angle").alias("angle")), batch)
        return batch

    def remove(self, ids: DataFrame) -> int:
        """Hide the vectors with these ids (id); the number of the batch that does so."""
        batch = self._batches()[-1] + 1
        empty = f"{self.root}/rows/batch={batch}"
        self._rows().where("false").drop("batch").write.mode("overwrite").partitionBy("cell").parquet(empty)
        self._hide(ids.select("id").distinct(), batch)
        self._finish(self.spark.createDataFrame([], "cell int, n long, angle float"), batch)
        return batch

    def _hide(self, ids: DataFrame | None, batch: int) -> None:
        old = self._rows()
        known = old.select("id").distinct().join(ids, "id", "left_semi") if ids is not None and old is not None else self.spark.createDataFrame([], self._columns)
        known.select("id", F.lit(batch).alias("before")).write.mode("overwrite").parquet(f"{self.root}/gone/batch={batch}")

    def _finish(self, sizes: DataFrame, batch: int) -> None:
        mark = self.spark.createDataFrame([(None, 0, 0.0)], "cell int, n long, angle float")
        sizes.unionByName(mark).withColumn("batch", F.lit(batch)).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/sizes/{batch}")

    # search

    def _asked(self, queries: DataFrame) -> tuple[list, np.ndarray]:
        """query_id and unit vector of the queries that have one."""
        rows = queries.select("query_id", "vec").limit(MOST_QUERIES + 1).collect()
        if len(rows) > MOST_QUERIES:
            raise ValueError(f"more than {MOST_QUERIES} queries: search in several calls, or use a join over all rows")
        vecs, fit = units(pd.Series([r["vec"] for r in rows], dtype=object), self.centroids.shape[1])
        return [r["query_id"] for r, f in zip(rows, fit, strict=True) if f], vecs[fit]

    def _nearest_cells(self, asked: np.ndarray, probes: int) -> list[np.ndarray]:
        near = asked @ self.centroids.T
        return list(np.argsort(-near, axis=1, kind="stable")[:, :probes])

    def _candidates(self, asked: np.ndarray, cells: list[np.ndarray], best: int, floor: np.ndarray | None) -> DataFrame:
        """q, id, batch, cell, approx, error of rows in the cells of each query: the ``best`` of each batch by code, or, with a
        floor for each query, all whose score may reach it."""
        by: dict[int, list[int]] = {}
        for q, own in enumerate(cells):
            for c in own.tolist():
                by.setdefault(c, []).append(q)
        plan = self.spark.sparkContext.broadcast(({c: np.array(q) for c, q in by.items()}, asked, floor))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            who, vecs, low = plan.value
            for batch in batches:
                cell = batch.column(batch.schema.get_field_index("cell")).to_numpy()
                for c in np.unique(cell).tolist():
                    at = np.nonzero(cell == c)[0]
                    part = batch.take(pa.array(at))
                    code = np.frombuffer(b"".join(part["code"].to_pylist()), np.int8).reshape(len(at), -1)
                    score = (code @ vecs[who[c]].T.astype(np.float32)) * part["scale"].to_numpy()[:, None]
                    error = part["error"].to_numpy()
                    if low is not None:
                        row, q = np.nonzero(score + error[:, None] >= low[who[c]])
                    else:
                        few = min(best, len(at))
                        row, q = np.argpartition(-score, few - 1, axis=0)[:few].ravel(), np.tile(np.arange(len(who[c])), few)
                    take = pa.array(row)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(who[c][q].astype(np.int32)), part["id"].take(take), part["batch"].take(take), part["cell"].take(take), pa.array(score[row, q].astype(np.float64))],
                        ["q", "id", "batch", "cell", "approx"],
                    )

        kind = self._columns["id"].dataType.simpleString()
        rows = self._rows().where(F.col("cell").isin(sorted(by))).select("id", "batch", "cell", "code", "scale", "error")
        return rows.mapInArrow(scan, f"q int, id {kind}, batch int, cell int, approx double")

    def _resolved(self, found: DataFrame, names: list, asked: np.ndarray, queries: DataFrame, k: int) -> DataFrame:
        """The k best of the candidates by exact cosine."""
        kind = queries.schema["query_id"].dataType.simpleString()
        table = self.spark.createDataFrame([(i, n, v.tolist()) for i, (n, v) in enumerate(zip(names, asked, strict=True))], f"q int, query_id {kind}, asked array<double>")
        rows = self._rows().where(F.col("cell").isNotNull()).select("id", "batch", "cell", "vec")
        scored = found.join(rows, ["id", "batch", "cell"]).join(F.broadcast(table), "q").select("query_id", "id", cosine(F.col("vec"), F.col("asked")).alias("score"))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id"))
        return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")

    def search(self, queries: DataFrame, k: int = 20, probes: int = 8) -> DataFrame:
        """query_id, rank, id, score (cosine): the k nearest of each query (query_id, vec) among the rows of the ``probes`` cells
        nearest to it; ties to smaller ids. Queries without a direction find nothing."""
        names, asked = self._asked(queries)
        found = self._living(self._candidates(asked, self._nearest_cells(asked, probes), SPARE * k, None))
        rank = F.row_number().over(Window.partitionBy("q").orderBy(F.col("approx").desc(), "id"))
        best = found.withColumn("place", rank).where(F.col("place") <= SPARE * k).drop("place")
        return self._resolved(best, names, asked, queries, k)

    def exact(self, queries: DataFrame, k: int = 20, probes: int = 8) -> DataFrame:
        """As ``search``, but exact: the k-th score of a first search rules out cells that lie too far off by the angle of
        their widest vector, and rows by the error of their codes; what is left is scored."""
        names, asked = self._asked(queries)
        first = {r["query_id"]: r["low"] for r in self.search(queries, k, probes).groupBy("query_id").agg(F.min("score").alias("low"), F.count("id").alias("n")).where(F.col("n") >= k).collect()}
        floor = np.array([first.get(n, -2.0) for n in names]) - 1e-5
        angle = np.full(len(self.centroids), -1.0)
        for r in self._sizes().where("cell IS NOT NULL").groupBy("cell").agg(F.max("angle").alias("a")).collect():
            angle[r["cell"]] = r["a"]
        apart = np.arccos((asked @ self.centroids.T).clip(-1, 1))
        reach = np.cos((apart - angle).clip(0, np.pi))
        cells = [np.nonzero((reach[i] >= floor[i]) & (angle >= 0))[0] for i in range(len(names))]
        return self._resolved(self._living(self._candidates(asked, cells, 0, floor)), names, asked, queries, k)

    def reads(self, queries: DataFrame, probes: int = 8) -> DataFrame:
        """query_id, rows and share: what a search of each query reads of all rows."""
        names, asked = self._asked(queries)
        kind = queries.schema["query_id"].dataType.simpleString()
        pairs = [(n, int(c)) for n, own in zip(names, self._nearest_cells(asked, probes), strict=True) for c in own]
        sizes = self._sizes().where("cell IS NOT NULL").groupBy("cell").agg(F.sum("n").alias("n"))
        total = sizes.agg(F.sum("n")).first()[0] or 0
        rows = self.spark.createDataFrame(pairs, f"query_id {kind}, cell int").join(sizes, "cell", "left")
        return rows.groupBy("query_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).withColumn("share", F.col("rows") / total)


def recall(found: DataFrame, truth: DataFrame) -> float:
    """Share of the rows of truth (query_id, id) that found has."""
    row = truth.join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left").agg(F.count("hit").alias("hit"), F.count(F.lit(1)).alias("n")).first()
    return row["hit"] / row["n"] if row["n"] else 1.0


def nearest(index: VectorIndex, query: Sequence[float], limit: int = 20, probes: int = 8) -> DataFrame:
    """id, score of the closest vectors to one query, as ``search.nearest`` gives them."""
    asked = index.spark.createDataFrame([(0, [float(x) for x in query])], "query_id int, vec array<double>")
    return index.search(asked, limit, probes).select("id", "score").orderBy(F.col("score").desc(), "id")
