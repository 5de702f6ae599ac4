"""Shared pieces: word pattern, scratch tables and shipping the package to executors."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, which separates words.
SPACES = " \t\n\x0b\x0c\r"
#: One word.
WORD = r"[^\x20\x09-\x0D]+"
#: Texts of an Arrow batch that are unpacked at once.
SLICE_TEXTS = 250

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to Python workers that do not have it on their path."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    name = os.path.basename(root)
    target = os.path.join(tempfile.mkdtemp(prefix="graphloom-"), f"{name}.zip")
    with zipfile.ZipFile(target, "w") as out:
        for folder in (root, os.path.join(root, "llm")):
            for entry in sorted(os.listdir(folder)):
                if entry.endswith(".py"):
                    path = os.path.join(folder, entry)
                    out.write(path, os.path.join(name, os.path.relpath(path, root)))
    context.addPyFile(target)
    _shipped.add(context.applicationId)


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir``. Where none is named it is
    a temporary folder in a local session (tests), and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = os.path.join(tempfile.gettempdir(), f"graphloom-{spark.sparkContext.applicationId}")
    return base.rstrip("/")


_written: list[tuple[SparkSession, str]] = []


@atexit.register
def _remove_written() -> None:
    """Intermediate tables live as long as the driver: results are lazy and may read them."""
    for spark, path in _written:
        with contextlib.suppress(Exception):  # the session may be gone
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which goes when the driver ends."""
    path = f"{scratch_dir(spark)}/graphloom/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later jobs start from the
    files, whatever executors are lost, and the lineage above is cut."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Return a worker's free memory to the system, where the C library can: workers live on between stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def unpacked(texts: pa.Array) -> Iterator[str | None]:
    """The texts of an array, of which few are Python's at once."""
    for at in range(0, len(texts), SLICE_TEXTS):
        yield from texts.slice(at, SLICE_TEXTS).to_pylist()


def whole_row(docs: DataFrame) -> Column:
    """All columns of docs in one, so that no column beside it can clash with them; ``row.*`` takes them out."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns])


def count_words(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
