"""Snapshots of a graph that repositories are replaced in, at a cost of what changes.

Rows lie in folders of their repository (nodes) or pair of repositories (edges, by their ends). A
manifest names the folders of a snapshot, and a commit file the manifest; a new snapshot writes the
folders of what it replaces and takes over the names of all others. So edges into a repository leave
with it though another one holds their other end, and no folder is read for that.
"""

from __future__ import annotations

import contextlib
import hashlib
import json
import os
import time
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

COMMITS, DATA, MANIFESTS, LOCK = "_commits", "data", "manifests", "_LOCK"
#: Owner of ids that lie in no repository: dependencies, and ids without a folder.
SHARED = ""
META, DEPENDENCY = "_meta:index:", "pkg:"
PART = "kind string, owner string, other string, folder string"


class Locked(RuntimeError):
    """Another writer holds the store."""


class Conflict(RuntimeError):
    """Another snapshot was committed since this one's base was read."""


@dataclass(frozen=True)
class Part:
    """A folder of rows: of nodes of an owner, or of edges from an owner's nodes to another's."""

    kind: str
    owner: str
    other: str
    folder: str

    def within(self, owners: Iterable[str]) -> bool:
        return self.owner in owners or (self.kind == "edges" and self.other in owners)


def _above(repo: str) -> list[str]:
    """A repository's id and those of the folders above it."""
    steps = repo.split("/")
    return ["/".join(steps[: n + 1]) for n in range(len(steps))]


def owner_of(rows: DataFrame, column: str, owners: list[str], name: str) -> DataFrame:
    """rows with the owner of the ids in ``column``: the longest of the owners that the id is or lies in, else its
    first folder, else SHARED; metadata of a repository is its own owner. One equality join for each depth that
    owners have; rows are not multiplied."""
    meta, steps = F.col(column).startswith(META), F.split(column, "/")
    depths: dict[int, list[str]] = {}
    for o in owners:
        if o and not o.startswith(META):
            depths.setdefault(o.count("/") + 1, []).append(o)
    found = []
    for depth, some in sorted(depths.items(), reverse=True):
        names = rows.sparkSession.createDataFrame([(o,) for o in some], f"_found_{depth} string")
        key = F.when(~meta & (F.size(steps) >= depth), F.array_join(F.slice(steps, 1, depth), "/"))
        rows = rows.withColumn("_key", key).join(names, F.col("_key") == F.col(f"_found_{depth}"), "left").drop("_key")
        found.append(F.col(f"_found_{depth}"))
    first = F.when(~F.col(column).startswith(DEPENDENCY) & (F.size(steps) > 1), steps[0])
    return rows.withColumn(name, F.when(meta, F.col(column)).otherwise(F.coalesce(*found, first, F.lit(SHARED)))).drop(*[f"_found_{d}" for d in depths])


class SnapshotStore:
    """nodes (id, type, ...) and edges (id, type, source_id, target_id, ...) under a folder.

    A writer holds ``_LOCK``; a second one fails with ``Locked``. A commit creates the file of the next number, which
    fails with ``Conflict`` where it exists, so a lock that was broken too early loses no snapshot either. Readers need
    no lock: a snapshot's files do not change until ``clean`` removes it. What a failed write left is removed at once,
    or by ``clean`` if its driver died. The file system must create or rename to a new name atomically, as HDFS and
    local ones do. The driver holds the manifest: a row for each repository and pair of repositories with edges.

    Null ids belong to no repository and are kept; repeated rows are kept as they are.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    # files

    def _path(self, *names: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *names]))

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _local(self, *names: str) -> str | None:
        """The path on this machine, if the store is there."""
        uri = urlparse(self._fs().makeQualified(self._path()).toString())
        return "/".join([uri.path, *names]) if uri.scheme == "file" else None

    def _names(self, folder: str) -> list[str]:
        fs, path = self._fs(), self._path(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def _create(self, content: str, *names: str) -> bool:
        """Create a file as a whole; False if there is one."""
        local, fs = self._local(*names), self._fs()
        spare = (*names[:-1], f".{names[-1]}-{uuid.uuid4().hex}")
        fs.mkdirs(self._path(*names[:-1]))
        if local:
            # a link, as a rename would replace the file
            with open(self._local(*spare), "x", encoding="utf-8") as file:
                file.write(content)
            try:
                os.link(self._local(*spare), local)
            except FileExistsError:
                return False
            finally:
                os.remove(self._local(*spare))
            return True
        out = fs.create(self._path(*spare), False)
        out.write(bytearray(content.encode()))
        out.close()
        done = fs.rename(self._path(*spare), self._path(*names))
        if not done:
            fs.delete(self._path(*spare), False)
        return done

    @contextlib.contextmanager
    def lock(self) -> Iterator[None]:
        about = json.dumps({"application": self.spark.sparkContext.applicationId, "since": time.time()})
        if not self._create(about, LOCK):
            raise Locked(f"{self.root} is held by another writer; break_lock() if that one is gone")
        try:
            yield
        finally:
            self.break_lock()

    def break_lock(self) -> None:
        self._fs().delete(self._path(LOCK), False)

    # reading

    def current(self) -> str | None:
        """Name of the current snapshot."""
        names = [n for n in self._names(COMMITS) if not n.startswith(".")]
        return self._commit(int(names[-1]))["name"] if names else None

    def _commit(self, number: int) -> dict:
        text = self.spark.read.text(f"{self.root}/{COMMITS}/{number:010d}", wholetext=True).first()["value"]
        return json.loads(text)

    def manifest(self, name: str | None = None) -> list[Part]:
        """The folders of a snapshot, the current one if none is named."""
        name = name or self.current()
        return [Part(**r.asDict()) for r in self.spark.read.schema(PART).parquet(f"{self.root}/{MANIFESTS}/{name}").collect()] if name else []

    def _schemas(self, name: str) -> tuple[StructType, StructType]:
        about = self._commit(int(name.split("-")[0]))
        return tuple(StructType.fromJson(about[kind]) for kind in ("nodes", "edges"))

    def _rows(self, parts: list[Part], kind: str, schema: StructType) -> DataFrame:
        folders = sorted({f"{self.root}/{DATA}/{p.folder}" for p in parts if p.kind == kind})
        return self.spark.read.schema(schema).parquet(*folders).select(*schema.names) if folders else self.spark.createDataFrame([], schema)

    def read(self, name: str | None = None, repos: Iterable[str] | None = None) -> tuple[DataFrame, DataFrame] | None:
        """nodes and edges of a snapshot, or only those of some owners: their nodes and the edges at these."""
        name = name or self.current()
        if name is None:
            return None
        parts = self.manifest(name)
        if repos is not None:
            wanted = set(repos)
            parts = [p for p in parts if p.within(wanted)]
        nodes, edges = self._schemas(name)
        return self._rows(parts, "nodes", nodes), self._rows(parts, "edges", edges)

    # writing

    def _write(self, rows: DataFrame, kind: str, name: str) -> list[Part]:
        """Write rows with _owner (and _other) to a folder for each, and name the folders."""
        rows = rows if kind == "edges" else rows.withColumn("_other", F.lit(SHARED))
        keyed = rows.withColumns({"_a": F.md5("_owner"), "_b": F.md5("_other")})
        # rebalanced: adaptive execution cuts up a repository with many rows and keeps small ones together
        keyed.hint("rebalance", "_owner", "_other").sortWithinPartitions("_a", "_b", "type").write.partitionBy("_a", "_b").parquet(f"{self.root}/{DATA}/{name}/{kind}")
        back = self.spark.read.schema("_owner string, _other string").parquet(f"{self.root}/{DATA}/{name}/{kind}")
        digest = lambda x: hashlib.md5(x.encode()).hexdigest()
        pairs = back.select("_owner", "_other").distinct().collect()
        return [Part(kind, a, b, f"{name}/{kind}/_a={digest(a)}/_b={digest(b)}") for a, b in pairs]

    def _commit_parts(self, name: str, parts: list[Part], nodes: StructType, edges: StructType) -> None:
        rows = [(p.kind, p.owner, p.other, p.folder) for p in parts]
        self.spark.createDataFrame(rows, PART).coalesce(1).write.parquet(f"{self.root}/{MANIFESTS}/{name}")
        about = {"name": name, "nodes": json.loads(nodes.json()), "edges": json.loads(edges.json())}
        if not self._create(json.dumps(about), COMMITS, name.split("-")[0]):
            raise Conflict(f"snapshot {name.split('-')[0]} of {self.root} was committed by another writer")

    @contextlib.contextmanager
    def _next(self, base: str | None) -> Iterator[str]:
        """The name of the snapshot after ``base``; what was written of it goes if it fails."""
        name = f"{int(base.split('-')[0]) + 1 if base else 1:010d}-{uuid.uuid4().hex[:8]}"
        try:
            yield name
        except BaseException:
            for folder in (DATA, MANIFESTS):
                self._fs().delete(self._path(folder, name), True)
            raise

    def _owned(self, nodes: DataFrame, edges: DataFrame, owners: list[str]) -> tuple[DataFrame, DataFrame]:
        return owner_of(nodes, "id", owners, "_owner"), owner_of(owner_of(edges, "source_id", owners, "_owner"), "target_id", owners, "_other")

    def publish(self, nodes: DataFrame, edges: DataFrame, repos: Iterable[str] | None = None) -> str:
        """A snapshot of a whole graph. Its repositories are those named, else its nodes of type Repository."""
        if repos is None:
            repos = [r["id"] for r in nodes.where("type = 'Repository'").select("id").distinct().collect()]
        with self.lock(), self._next(self.current()) as name:
            own_nodes, own_edges = self._owned(nodes, edges, sorted(set(repos)))
            parts = self._write(own_nodes, "nodes", name) + self._write(own_edges, "edges", name)
            self._commit_parts(name, parts, nodes.schema, edges.schema)
        return name

    def replace(self, repos: str | DataFrame, nodes: DataFrame, edges: DataFrame) -> str:
        """A snapshot in which the parts of a repository, or of several (a table with repo), are the given ones.

        What the given rows say of other repositories and of shared ids is added where the id is new. A repository that
        lies in another one is cut out of it, which writes that one again."""
        gone = {repos} if isinstance(repos, str) else {r["repo"] for r in repos.select("repo").where("repo IS NOT NULL").distinct().collect()}
        with self.lock(), self._next(base := self.current()) as name:
            old = self.manifest(base)
            known = {p.owner for p in old} | {p.other for p in old if p.kind == "edges"}
            again = gone | {META + r for r in gone}
            inside = {o for o in known if (o in again if o.startswith(META) else not gone.isdisjoint(_above(o)))}
            outer = ({o for g in gone for o in _above(g)} & known) - inside
            stray = self._schemas(base) if base else (nodes.schema, edges.schema)
            shared = [p for p in old if p.within({SHARED})]
            if shared and self._holds(shared, gone, stray):
                outer |= {SHARED}
            kept = [p for p in old if not p.within(inside)]
            cut = [p for p in kept if p.within(outer)]
            kept = [p for p in kept if p not in set(cut)]
            every = sorted((known - inside) | gone)

            new_nodes, new_edges = self._owned(nodes, edges, every)
            # whatever lies in a replaced repository has a replaced one as its owner: no other is left below it in ``every``
            named = F.col("_owner").isin(sorted(again))
            touching = named | F.col("_other").isin(sorted(again))
            new_nodes = self._only_new(new_nodes, named, kept + cut, "nodes", stray[0])
            new_edges = self._only_new(new_edges, touching, kept + cut, "edges", stray[1])
            if cut:
                again_nodes, again_edges = self._owned(self._rows(cut, "nodes", stray[0]), self._rows(cut, "edges", stray[1]), every)
                new_nodes = new_nodes.unionByName(again_nodes.where(~named), allowMissingColumns=True)
                new_edges = new_edges.unionByName(again_edges.where(~touching), allowMissingColumns=True)
            parts = kept + self._write(new_nodes, "nodes", name) + self._write(new_edges, "edges", name)
            self._commit_parts(name, parts, self._wider(stray[0], nodes.schema), self._wider(stray[1], edges.schema))
        return name

    def _holds(self, parts: list[Part], repos: set[str], schemas: tuple[StructType, StructType]) -> bool:
        """Whether shared rows are named like a repository; asked of files whose statistics mostly say no."""
        nodes, edges = (self._rows(parts, kind, schema) for kind, schema in zip(("nodes", "edges"), schemas, strict=True))
        ids = sorted(repos)
        return not nodes.where(F.col("id").isin(ids)).isEmpty() or not edges.where(F.col("source_id").isin(ids) | F.col("target_id").isin(ids)).isEmpty()

    def _only_new(self, rows: DataFrame, mine: Column, parts: list[Part], kind: str, schema: StructType) -> DataFrame:
        """rows that are mine, and of the others those whose id their owners' folders do not hold."""
        owners = {(r[0], r[1]) for r in rows.where(~mine).select("_owner", "_other" if kind == "edges" else F.lit(SHARED)).distinct().collect()}
        there = [p for p in parts if p.kind == kind and (p.owner, p.other) in owners]
        if not there:
            return rows
        held = self._rows(there, kind, schema).select("id")
        return rows.where(mine).unionByName(rows.where(~mine).join(held, "id", "left_anti"))

    @staticmethod
    def _wider(old: StructType, new: StructType) -> StructType:
        return StructType([*old.fields, *[f for f in new.fields if f.name not in old.names]])

    def compact(self) -> str | None:
        """A snapshot with one folder for each owner that has several, as shared ids get by and by."""
        with self.lock(), self._next(base := self.current()) as name:
            parts = self.manifest(base)
            folders: dict[tuple, list[Part]] = {}
            for p in parts:
                folders.setdefault((p.kind, p.owner, p.other), []).append(p)
            many = [p for own in folders.values() if len(own) > 1 for p in own]
            if not many:
                return base
            nodes, edges = self._schemas(base)
            kept = [p for p in parts if p not in set(many)]
            known = sorted({p.owner for p in parts} | {p.other for p in parts})
            own_nodes, own_edges = self._owned(self._rows(many, "nodes", nodes), self._rows(many, "edges", edges), known)
            self._commit_parts(name, kept + self._write(own_nodes, "nodes", name) + self._write(own_edges, "edges", name), nodes, edges)
        return name

    def clean(self, keep: int = 1) -> int:
        """Remove the snapshots before the last ``keep`` and what unfinished writes left; the number of folders that went."""
        if keep < 1:
            raise ValueError("the current snapshot stays")
        with self.lock():
            numbers = [n for n in self._names(COMMITS) if not n.startswith(".")]
            names = [self._commit(int(n))["name"] for n in numbers[-keep:]]
            used = {tuple(p.folder.split("/")) for n in names for p in self.manifest(n)}
            fs, before = self._fs(), 0
            for n in numbers[:-keep]:
                fs.delete(self._path(COMMITS, n), False)
            for n in self._names(MANIFESTS):
                if n not in names:
                    fs.delete(self._path(MANIFESTS, n), True)
            for n in self._names(DATA):
                for kind in self._names(f"{DATA}/{n}"):
                    for a in (x for x in self._names(f"{DATA}/{n}/{kind}") if x.startswith("_a=")):
                        for b in self._names(f"{DATA}/{n}/{kind}/{a}"):
                            if (n, kind, a, b) not in used:
                                fs.delete(self._path(DATA, n, kind, a, b), True)
                                before += 1
                if not any(u[0] == n for u in used):
                    fs.delete(self._path(DATA, n), True)
        return before


def ingest(store: SnapshotStore, nodes: DataFrame, edges_of, checkpoint: str):
    """Replace repositories as batches of a node stream (with a column repo) arrive. ``edges_of``
    gives the edges of some repositories (a table with repo); a batch is one snapshot, however many
    it has. A batch that is run again replaces the same repositories by the same rows."""

    def each(batch: DataFrame, number: int) -> None:
        repos = batch.select("repo").distinct()
        if not repos.isEmpty():
            store.replace(repos, batch.drop("repo"), edges_of(repos))

    return nodes.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
