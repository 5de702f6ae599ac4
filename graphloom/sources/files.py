"""Source trees: a scan of files into Repository, Directory and File nodes with DEFINES
edges, archives of sources, binary detection."""

from __future__ import annotations

import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import fixed_values as fixed
from graphloom.functions.text import basename, extension, language_of, parent_dir

MAX_BYTES = 1_000_000
PROBE_BYTES = 8192


def is_binary(content: Column) -> Column:
    """A zero byte in the first 8 KiB."""
    # two hexadecimal digits a byte: the pairs start at odd places
    return F.hex(F.substring(content, 1, PROBE_BYTES)).rlike("^(?:..)*?00")


def kept_path(path: Column) -> Column:
    """Whether a scan keeps a relative path: no excluded folder in it, and an extension of the list."""
    folders = F.slice(F.split(path, "/"), F.lit(1), F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    excluded = F.exists(folders, lambda s: s.isin(fixed.EXCLUDED_DIRS) | s.endswith(".egg-info"))
    return ~excluded & extension(path).isin(fixed.INCLUDED_EXTENSIONS)


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """path (relative), content (binary), bytes of all files below a folder."""
    root = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), "^.*?" + root.replace(".", r"\.") + "/", "")
    return files.select(path.alias("path"), "content", F.col("length").alias("bytes"))


def read_zip(spark: SparkSession, path: str) -> DataFrame:
    """path, content, bytes of the files in zip archives, without a common top folder. Tasks list the archives' files
    first; then the files are dealt to tasks, which read them one at a time where they lie in the archive."""

    def opened(archive: str):
        import re

        from pyarrow import fs

        system, place = fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", archive))
        return system.open_input_file(place)

    def listed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for place in frame["path"]:
                with opened(place) as data, zipfile.ZipFile(data) as archive:
                    names = [n for n in archive.namelist() if not n.endswith("/")]
                tops = {n.split("/", 1)[0] for n in names}
                cut = len(next(iter(tops))) + 1 if len(tops) == 1 and all("/" in n for n in names) else 0
                yield pd.DataFrame({"archive": place, "name": names, "path": [n[cut:] for n in names]})

    def entries(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for place, some in frame.groupby("archive", sort=False):
                with opened(place) as data, zipfile.ZipFile(data) as archive:
                    for name, short in zip(some["name"], some["path"], strict=True):
                        body = archive.read(name)
                        yield pd.DataFrame({"path": [short], "content": [body], "bytes": [len(body)]})

    names = spark.read.format("binaryFile").load(path).select("path").mapInPandas(listed, "archive string, name string, path string")
    return names.repartition(spark.sparkContext.defaultParallelism).mapInPandas(entries, "path string, content binary, bytes long")


def sources(files: DataFrame, repo: str) -> DataFrame:
    """file_id, path, content (text), language, lines of the files that a scan keeps and that are text of at most a megabyte."""
    kept = files.where(kept_path(F.col("path")) & (F.col("bytes") <= MAX_BYTES)).where(~is_binary(F.col("content")))
    text = F.decode("content", "UTF-8")
    return kept.select(F.concat(F.lit(f"{repo}/"), F.col("path")).alias("file_id"), "path", text.alias("content"), language_of(F.col("path")).alias("language"), F.size(F.split(text, "\n", -1)).alias("lines"))


def tree(files: DataFrame, repo: str) -> tuple[DataFrame, DataFrame]:
    """nodes and edges of a repository's files: each folder once, each child defined by its parent."""
    parts = F.split("path", "/")
    folders = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    dirs = files.where(F.col("path").contains("/")).select(F.explode(folders).alias("path")).distinct()
    prop = lambda **cols: F.to_json(F.struct(*[c.alias(k) for k, c in cols.items()]))
    full = F.concat(F.lit(f"{repo}/"), F.col("path"))
    file_nodes = files.select(full.alias("id"), F.lit("File").alias("type"), basename(F.col("path")).alias("name"), prop(path=F.col("path"), extension=extension(F.col("path")), language=language_of(F.col("path"))).alias("properties"))
    dir_nodes = dirs.select(full.alias("id"), F.lit("Directory").alias("type"), basename(F.col("path")).alias("name"), prop(path=F.col("path")).alias("properties"))
    root = files.sparkSession.createDataFrame([(repo, "Repository", repo, "{}")], "id string, type string, name string, properties string")
    up = parent_dir(F.col("path"))
    parent = F.when(up == "", F.lit(repo)).otherwise(F.concat(F.lit(f"{repo}/"), up))
    edge = F.concat(parent, F.lit("->DEFINES->"), full)
    edges = files.select("path").union(dirs.select("path")).select(edge.alias("id"), F.lit("DEFINES").alias("type"), parent.alias("source_id"), full.alias("target_id"))
    return root.unionByName(dir_nodes).unionByName(file_nodes), edges
