"""Interchange archives: a zip of nodes_{Type}.parquet, relationships.parquet and, if wanted, source_text.parquet.

Spark tasks write the Parquet files and read them, row group by row group, straight out of the zip; the driver copies
finished files into the zip a block at a time, so it holds no rows. A table too large for one file goes on in
nodes_{Type}/1.parquet and so on.
"""

from __future__ import annotations

import os
import re
import shutil
import uuid
import zipfile
from collections.abc import Callable, Iterator
from functools import reduce
from urllib.parse import quote, unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from graphloom.session import scratch, shared_dir

#: About so many rows of a table are a file of the archive.
ROWS_A_FILE = 1_000_000
#: About so many bytes of an archive are a task's when it is read.
BYTES_A_TASK = 32 << 20
#: The driver holds a row for each type, and tasks get these rows by broadcast.
MAX_TYPES = 10_000
_RENAMED = {"Package": "Dependency"}
_MEMBER = re.compile(r"(?:^|/)(nodes_[^/]+?|relationships|source_text)(?:/[0-9]+)?\.parquet$")


def _at(path: str):
    """The file system of a path or URI, and the path there."""
    from pyarrow import fs

    local = re.sub(r"^file:/+", "/", path)
    return fs.FileSystem.from_uri(local if "://" in local else os.path.abspath(local))


def _files(spark: SparkSession, df: DataFrame, table: Column, tables: dict[str, int]) -> Iterator[tuple[str, str]]:
    """Write df's rows to Parquet files and name them: the table (one of ``tables``, which gives their rows) and the file's path."""
    firsts, n = {}, 0
    for name, rows in tables.items():
        firsts[name], n = (n, -(-rows // ROWS_A_FILE)), n + -(-rows // ROWS_A_FILE)
    places = spark.createDataFrame([(name, *place) for name, place in firsts.items()], "_table string, _first int, _parts int")
    placed = df.withColumn("_table", table).join(F.broadcast(places), "_table")
    member = F.col("_first") + F.pmod(F.xxhash64(*df.columns), F.col("_parts")).cast("int")
    folder = scratch(spark, "archive")
    placed.select(*[c for c in df.columns if c != "_type"], member.alias("_member")).repartition("_member").write.partitionBy("_member").parquet(folder)
    from pyarrow.fs import FileSelector, FileType

    fs, root = _at(folder)
    for name, (first, parts) in firsts.items():
        for k in range(first, first + parts):
            listed = fs.get_file_info(FileSelector(f"{root}/_member={k}", allow_not_found=True))
            yield from ((name, f.path) for f in sorted(listed, key=lambda f: f.path) if f.type == FileType.File and f.path.endswith(".parquet"))


def export_graph(nodes: DataFrame, edges: DataFrame, path: str, source_text: DataFrame | None = None) -> None:
    """Write an archive of all rows, in place of one at ``path`` when it is complete. An empty graph is an error, as is
    a node without a type. Repeated rows and null names and properties are kept."""
    spark, (fs, place) = nodes.sparkSession, _at(path)
    counts = {r["type"]: r["n"] for r in nodes.groupBy("type").agg(F.count(F.lit(1)).alias("n")).limit(MAX_TYPES + 1).collect()}
    if not counts:
        raise ValueError("an empty graph can't be exported")
    if None in counts or len(counts) > MAX_TYPES:
        raise ValueError("a node has no type" if None in counts else f"more than {MAX_TYPES} types")
    links = edges.select(F.col("source_id").alias("from"), F.col("target_id").alias("to"), "id", "type", *[c for c in edges.columns if c == "properties"])
    typed = nodes.select("id", "name", "properties", F.col("type").alias("_type"))
    tables = [(typed, F.concat(F.lit("nodes_"), "_type"), {f"nodes_{t}": n for t, n in counts.items()}), (links, F.lit("relationships"), {"relationships": edges.count()})]
    if source_text is not None:
        tables.append((source_text.select("id", "name", "source_text"), F.lit("source_text"), {"source_text": source_text.count()}))

    shared = _at(shared_dir(spark))[0]
    fs.create_dir(place.rsplit("/", 1)[0], recursive=True)
    unfinished = f"{place}.{uuid.uuid4().hex}"
    try:
        with fs.open_output_stream(unfinished) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as archive:
            for df, table, rows in tables:
                seen: dict[str, int] = {}
                for name, file in _files(spark, df, table, rows):
                    k = seen[name] = seen.get(name, -1) + 1
                    member = quote(name, safe=" ") + (f"/{k}" if k else "") + ".parquet"
                    with shared.open_input_stream(file) as source, archive.open(zipfile.ZipInfo(member), "w", force_zip64=True) as target:
                        shutil.copyfileobj(source, target, 1 << 20)
                if not seen:
                    archive.writestr(f"{next(iter(rows))}.parquet", _no_rows(df))
        fs.move(unfinished, place)
    except BaseException:
        if fs.get_file_info(unfinished).is_file:
            fs.delete_file(unfinished)
        raise


def _no_rows(df: DataFrame) -> bytes:
    """A Parquet file with df's columns and no rows."""
    import io

    import pyarrow.parquet as pq
    from pyspark.sql.pandas.types import to_arrow_schema

    buffer = io.BytesIO()
    pq.write_table(to_arrow_schema(df.schema).empty_table(), buffer)
    return buffer.getvalue()


def _readers(path: str, schema: StructType) -> tuple[Callable, Callable]:
    """What tasks run: name the row groups of members, and read row groups. A compressed member can't be read from its
    middle: it is one unit (group -1), and unpacked to the task's own disk while it is read."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def opened(name: str, unpack: bool):
        import contextlib
        import re
        import shutil
        import tempfile
        import zipfile

        import pyarrow.parquet as pq
        from pyarrow import fs

        @contextlib.contextmanager
        def tables():
            system, place = fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path))
            with system.open_input_file(place) as data, zipfile.ZipFile(data) as archive, archive.open(name) as member:
                stored = archive.getinfo(name).compress_type == zipfile.ZIP_STORED
                if stored:
                    yield pq.ParquetFile(member)
                elif not unpack:
                    yield None
                else:
                    with tempfile.TemporaryFile() as spool:
                        shutil.copyfileobj(member, spool, 1 << 20)
                        yield pq.ParquetFile(spool)

        return tables()

    def groups(batches):
        import pyarrow as pa

        for batch in batches:
            for name in batch.column(0).to_pylist():
                with opened(name, False) as table:
                    found = range(table.num_row_groups) if table is not None else [-1]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), pa.array(found, pa.int32())], ["member", "group"])

    def rows(batches):
        import pyarrow as pa

        for batch in batches:
            for name, group in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with opened(name, True) as table:
                    for got in table.iter_batches(batch_size=10_000, row_groups=None if group < 0 else [group]):
                        have = set(got.schema.names)
                        yield pa.RecordBatch.from_arrays([got.column(f.name).cast(f.type) if f.name in have else pa.nulls(got.num_rows, f.type) for f in arrow], schema=arrow)

    return groups, rows


def _table(spark: SparkSession, path: str, members: list[zipfile.ZipInfo], schema: StructType) -> DataFrame:
    """The rows of some members of an archive that have about the same columns; a column that a member lacks is null there."""
    groups, rows = _readers(path, schema)
    tasks = max(1, -(-sum(m.file_size for m in members) // BYTES_A_TASK))
    names = spark.createDataFrame([(m.filename,) for m in members], "member string").repartition(min(len(members), tasks))
    return names.mapInArrow(groups, "member string, group int").repartition(tasks).mapInArrow(rows, schema)


def _columns(archive: zipfile.ZipFile, members: list[zipfile.ZipInfo]) -> StructType:
    """The columns of a table, from its first file."""
    import pyarrow.parquet as pq
    from pyspark.sql.pandas.types import from_arrow_schema

    with archive.open(members[0]) as file:
        return from_arrow_schema(pq.ParquetFile(file).schema_arrow)


def import_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """nodes and edges of an archive that all executors can reach; older names of types are renamed, typed columns become properties."""
    fs, place = _at(path)
    where = path if "://" in path else place
    nodes, edges = [], None
    with fs.open_input_file(place) as data, zipfile.ZipFile(data) as archive:
        tables: dict[str, list[zipfile.ZipInfo]] = {}
        for member in archive.infolist():
            if found := _MEMBER.search(member.filename):
                tables.setdefault(unquote(found[1]), []).append(member)
        if not tables:
            raise ValueError("no tables in the archive")
        for name, members in tables.items():
            if name == "source_text":
                continue
            df = _table(spark, where, members, _columns(archive, members))
            if name == "relationships":
                props = F.col("properties").cast("string") if "properties" in df.columns else F.lit("{}")
                edges = df.select("id", "type", F.col("from").alias("source_id"), F.col("to").alias("target_id"), props.alias("properties"))
                continue
            kind, rest = name.removeprefix("nodes_"), [c for c in df.columns if c not in ("id", "name")]
            as_is = rest == ["properties"] and isinstance(df.schema["properties"].dataType, StringType)
            props = F.col("properties") if as_is else F.to_json(F.struct(*rest)) if rest else F.lit("{}")
            nodes.append(df.select("id", F.lit(_RENAMED.get(kind, kind)).alias("type"), "name", props.alias("properties")))
    if not nodes:
        raise ValueError("no nodes in the archive")
    if edges is None:
        edges = spark.createDataFrame([], "id string, type string, source_id string, target_id string, properties string")
    return reduce(DataFrame.unionByName, nodes), edges


def import_source_text(spark: SparkSession, path: str) -> DataFrame | None:
    """id, name, source_text of an archive, if it holds them."""
    fs, place = _at(path)
    with fs.open_input_file(place) as data, zipfile.ZipFile(data) as archive:
        members = [m for m in archive.infolist() if (found := _MEMBER.search(m.filename)) and found[1] == "source_text"]
        return _table(spark, path if "://" in path else place, members, _columns(archive, members)) if members else None
