"""Session factory and intermediate tables."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "graphloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and last-wins maps."""
    builder = SparkSession.builder.appName(app).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    builder = builder.config("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where none is named it is a temporary
    folder in a local session, whose executors are on this machine, and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return (base or os.path.join(tempfile.gettempdir(), f"graphloom-{spark.sparkContext.applicationId}")).rstrip("/")


def spread(scan: DataFrame) -> DataFrame:
    """A table scan over all cores, where its files give fewer splits than there are."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/graphloom/{name}-{uuid.uuid4().hex}"


_written: list[tuple[SparkSession, str]] = []


@atexit.register
def _remove_written() -> None:
    """Intermediate tables live as long as the driver: results are lazy and may read them."""
    for spark, path in _written:
        with contextlib.suppress(Exception):  # the session may be gone
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def scratch(spark: SparkSession, name: str) -> str:
    """A folder's path in the shared folder, for as long as the driver lives."""
    path = new_path(spark, name)
    _written.append((spark, path))
    return path


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """df, written to the shared folder and read back, so that loops have short lineages
    and lost executors cost no recomputation."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
