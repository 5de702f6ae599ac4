"""GraphStore: the query surface over nodes and edges. Every method returns a DataFrame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import search_text, sub_type
from graphloom.operators import fulltext, graph, search, store_ops


class GraphStore:
    """nodes: id, type, name, properties (JSON). edges: id, type, source_id, target_id.
    Optional: sources (id, path, content) and vectors (id, vec)."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, sources: DataFrame | None = None, vectors: DataFrame | None = None) -> None:
        self.nodes, self.edges, self.sources, self.vectors = nodes.where(~F.col("type").isin(*graph.INTERNAL_TYPES)), edges, sources, vectors
        self._index: search.Index | None = None
        self._texts: dict[str, fulltext.FullText] = {}

    def docs(self) -> DataFrame:
        """What search indexes of the nodes."""
        return self.nodes.select("id", "type", "name", search_text(F.col("name"), F.col("type"), F.col("properties")).alias("text"))

    def index(self) -> search.Index:
        """The search index of the nodes, built when it is first asked for."""
        if self._index is None:
            self._index = search.Index.build(self.docs())
        return self._index

    def node_text(self) -> fulltext.FullText:
        """The full-text index of the nodes, built when it is first asked for."""
        if "nodes" not in self._texts:
            self._texts["nodes"] = fulltext.FullText.build(fulltext.node_docs(self.nodes))
        return self._texts["nodes"]

    def source_text(self) -> fulltext.FullText | None:
        """The full-text index of the sources, if sources are stored."""
        if self.sources is not None and "sources" not in self._texts:
            self._texts["sources"] = fulltext.index_sources(self.sources)
        return self._texts.get("sources")

    def full_text_nodes(self, query: str, types: Sequence[str] | None = None, limit: int = 50) -> DataFrame:
        return fulltext.search_nodes(self.node_text(), self.nodes, query, types, limit)

    def full_text_sources(self, query: str, limit: int = 50) -> DataFrame:
        """id, score of the files whose name or text fits best."""
        index = self.source_text()
        if index is None:
            raise LookupError("no sources are stored")
        return index.search(query, limit)

    def register(self) -> None:
        """Views nodes and edges for spark.sql()."""
        self.nodes.createOrReplaceTempView("nodes")
        self.edges.createOrReplaceTempView("edges")

    def get_node(self, node_id: str) -> DataFrame:
        return self.nodes.where(F.col("id") == node_id)

    def get_nodes(self, ids: Sequence[str]) -> DataFrame:
        """Those of the ids that exist, in the order asked for."""
        asked = self.nodes.sparkSession.createDataFrame([(x, i) for i, x in enumerate(dict.fromkeys(ids))], "id string, ord int")
        return self.nodes.join(F.broadcast(asked), "id").orderBy("ord").drop("ord")

    def list_nodes(self, kind: str, filters: dict[str, object] | None = None, limit: int = 50) -> DataFrame:
        """Nodes of a type whose properties equal the filters as text; filtered, then limited."""
        rows = self.nodes.where(F.col("type") == kind)
        for key, value in (filters or {}).items():
            text = {True: "true", False: "false"}.get(value, str(value)) if isinstance(value, bool) else str(value)
            rows = rows.where(F.get_json_object("properties", f"$.{key}") == text)
        return rows.orderBy("id").limit(min(limit, 1000))

    def find_files(self, base: str, limit: int = 50) -> DataFrame:
        """Files of a base name."""
        path = F.get_json_object("properties", "$.path")
        return self.nodes.where((F.col("type") == "File") & ((path == base) | path.endswith(f"/{base}"))).orderBy("id").limit(limit)

    def search_nodes(self, query: str, types: Sequence[str] | None = None, limit: int = 50, vector: Sequence[float] | None = None) -> DataFrame:
        """BM25 over the nodes, full text over the sources and vectors, whichever there are, fused by rank."""
        found = search.hybrid(self.docs(), query, self.vectors, vector, types, min(limit, 1000), None if types else self.index(), self.source_text())
        return found.join(self.nodes, "id").orderBy(F.col("score").desc(), "id")

    def search_graph(self, query: str, hops: int = 2, limit: int = 50) -> tuple[DataFrame, DataFrame]:
        """The neighborhood of what a search (or type:X, or an id) finds, and the edges in it."""
        if query.startswith("type:"):
            seeds = graph.type_seeds(self.nodes, query)
        else:
            seeds = self.get_node(query).select("id")
            if seeds.isEmpty():
                seeds = search.hybrid(self.docs(), query, limit=limit, index=self.index()).select("id")
        ids = graph.expand(self.edges, seeds, hops)
        return self.nodes.join(ids, "id"), graph.induced_edges(self.edges, ids)

    def traverse(self, start: str, direction: str = "outgoing", max_depth: int = 3, relationship_type: str | None = None) -> DataFrame:
        return graph.traverse(self.nodes, self.edges, start, direction, max_depth, relationship_type)

    def neighbors(self, node_id: str, direction: str = "both") -> DataFrame:
        return graph.neighbors(self.edges, self.get_node(node_id), direction)

    def repo_paths(self) -> DataFrame:
        """repo_id and path (where the repository lies, if that is known), in order of the ids."""
        return self.nodes.where("type = 'Repository'").select(F.col("id").alias("repo_id"), F.get_json_object("properties", "$.path").alias("path")).orderBy("repo_id")

    def path_candidates(self, path: str) -> list[str]:
        """The path, and what is left of it below each repository that holds it."""
        asked = F.lit(path)
        below = self.repo_paths().where("path IS NOT NULL AND path <> ''").select(F.regexp_replace("path", "/+$", "").alias("root")).where(asked.startswith(F.concat("root", F.lit("/"))))
        return list(dict.fromkeys([path, *(path[len(r["root"]) + 1 :] for r in below.distinct().orderBy(F.length("root").desc()).collect())]))

    def resolve_file(self, path: str) -> str | None:
        """The id of a file by its path or what is left of it below a repository, else by a base name that
        only one file has; several are an error that names them."""
        at = F.get_json_object("properties", "$.path")
        files = self.nodes.where(F.col("type") == "File")
        for found in (files.where(at.isin(self.path_candidates(path))), self.find_files(path.rsplit("/", 1)[-1], 11)):
            ids = [r["id"] for r in found.select("id").orderBy("id").limit(11).collect()]
            if len(ids) > 1:
                raise LookupError(f"several files are named {path!r}: {', '.join(ids[:10])}")
            if ids:
                return ids[0]
        return None

    def impact(self, path: str, lines: str | None = None, depth: int = 2) -> DataFrame:
        """What depends on the symbols that a file defines, those on the given lines."""
        file = self.resolve_file(path)
        files = self.nodes.where(F.col("id") == file).select("id") if file else self.nodes.where("false").select("id")
        inside = graph.neighbors(self.edges, files, "outgoing", ["DEFINES"]).select(F.col("neighbor_id").alias("id"))
        symbols = self.nodes.join(inside, "id", "left_semi").where(F.col("type").isin("Function", "Class", "Module"))
        line = lambda key: F.get_json_object("properties", f"$.{key}").cast("int")
        return graph.impact(self.edges, symbols.where(graph.overlaps(line("start_line"), line("end_line"), graph.parse_lines(lines or ""))), depth)

    def file_impact(self, path: str, limit: int = 10) -> DataFrame:
        """The first neighbors of a file itself over edges of dependency types, for files without symbols."""
        file = self.resolve_file(path)
        return graph.file_impact(self.edges, self.nodes.where(F.col("id") == file).select("id") if file else self.nodes.where("false").select("id"), limit)

    def source_search(self, query: str, repo: str | None = None, types: Sequence[str] | None = None, limit: int = 20) -> DataFrame:
        """search.scoped_search with a repository by id; one that is not there is an error that names those that are."""
        if repo is not None and self.nodes.where((F.col("type") == "Repository") & (F.col("id") == repo)).isEmpty():
            known = [r["repo_id"] for r in self.repo_paths().limit(20).collect()]
            raise LookupError(f"no repository {repo!r}; there are {', '.join(known) or 'none'}")
        return search.scoped_search(self.index(), self.nodes, query, store_ops.in_scope(F.col("id"), repo) if repo is not None else None, types, limit)

    def read_source(self, node_id: str | None = None, path: str | None = None, lines: str | None = None) -> DataFrame:
        """A file's lines, by a node in it or by path. ``lines``: N, N-M, or N- to the end."""
        file = node_id.split("::")[0] if node_id else self.resolve_file(path or "")
        if file is None:
            raise LookupError(f"no file {path!r}")
        return self.source(file, *graph.parse_span(lines))

    def augment(self, query: str, limit: int = 10, told: int = 5) -> DataFrame:
        """What a search finds, each with its first relations of the types that are told of (by type, then edge) and the number
        of those left out: id, name, type, score, and position, direction, edge_type, neighbor_id, neighbor_name, more; these
        are null for a node without relations."""
        found = self.search_nodes(query, limit=limit).select("id", "name", "type", "score")
        steps = store_ops.top_per_group(graph.neighbors(self.edges, found, "both", graph.TOLD_TYPES), "id", [F.col("edge_type"), F.col("edge_id"), F.col("direction")], told)
        names = self.nodes.select(F.col("id").alias("neighbor_id"), F.col("name").alias("neighbor_name"))
        relations = steps.join(names, "neighbor_id", "left").select("id", "position", "direction", "edge_type", "neighbor_id", "neighbor_name", "more")
        return found.join(relations, "id", "left").orderBy(F.col("score").desc(), "id", "position")

    def _pull_request(self, pr: str) -> DataFrame:
        node = self.get_node(pr)
        if node.isEmpty():
            raise LookupError(f"no pull request {pr!r}")
        return node

    def pull_request(self, pr: str) -> tuple[DataFrame, DataFrame]:
        """A pull request, and what it changes, with the properties of the edges where they have some."""
        node = self._pull_request(pr)
        changed = graph.traverse(self.nodes, self.edges, pr, "outgoing", 2, "CHANGES")
        about = self.edges.select(F.col("id").alias("edge_id"), F.col("properties").alias("change")) if "properties" in self.edges.columns else None
        return node, changed.join(about, "edge_id", "left") if about is not None else changed

    def pull_request_radius(self, pr: str, depth: int = 2) -> DataFrame:
        """file_id, id, depth, edge_type: what leads to each file that a pull request changes, a search for each file."""
        changed = graph.neighbors(self.edges, self._pull_request(pr), "outgoing", ["CHANGES"]).select(F.col("neighbor_id").alias("key"), F.col("neighbor_id").alias("id"))
        return graph.bfs(self.edges, changed, "incoming", depth).select(F.col("key").alias("file_id"), "id", "depth", "edge_type")

    def swept(self, kind: str = "Dependency") -> GraphStore:
        """A store without the nodes of a type that no edge leads to; edges that they had go too."""
        kept = graph.sweep_orphans(self.nodes, self.edges, kind)
        return GraphStore(kept, graph.induced_edges(self.edges, kept), self.sources, self.vectors)

    def explore(self, node_id: str, depth: int = 1) -> tuple[DataFrame, DataFrame, DataFrame | None]:
        """A node, what lies within ``depth`` steps (three at most) in both directions, and its source, if sources are stored."""
        node = self.get_node(node_id)
        return node, graph.around(self.nodes, self.edges, node_id, depth), self.read_source(node_id) if self.sources is not None else None

    def add_vectors(self, vectors: DataFrame) -> GraphStore:
        """A store with more vectors (id, vec), the new ones in place of those with the same id."""
        kept = self.vectors.join(vectors.select("id"), "id", "left_anti").unionByName(vectors) if self.vectors is not None else vectors
        return GraphStore(self.nodes, self.edges, self.sources, kept)

    def cleared(self) -> GraphStore:
        """A store with the same columns and no rows."""
        return GraphStore(*(df.where("false") if df is not None else None for df in (self.nodes, self.edges, self.sources, self.vectors)))

    def stats(self) -> DataFrame:
        """Counts by type, and of all nodes and edges."""
        by = self.nodes.groupBy(F.concat(F.lit("nodes."), "type").alias("what")).agg(F.count("id").alias("n"))
        total = self.nodes.agg(F.lit("nodes").alias("what"), F.count("id").alias("n")).unionByName(self.edges.agg(F.lit("edges").alias("what"), F.count("id").alias("n")))
        return by.unionByName(total)

    def facets(self) -> DataFrame:
        return store_ops.facets(self.nodes, sub_type(F.col("type"), F.col("name"), F.col("properties")))

    def grep(self, pattern: str, **options) -> DataFrame:
        if self.sources is None:
            raise LookupError("no sources are stored")
        return search.grep(self.sources, pattern, **options)

    def source(self, node_id: str, start: int | None = None, end: int | None = None) -> DataFrame:
        if self.sources is None:
            raise LookupError("no sources are stored")
        return search.source_slice(self.sources, node_id, start, end)

    def import_batch(self, nodes: DataFrame, edges: DataFrame) -> GraphStore:
        """A store with more nodes and edges, the new ones in place of those with the same id."""
        new = nodes.select(*self.nodes.columns, F.lit(1).alias("seq")).unionByName(self.nodes.withColumn("seq", F.lit(0)))
        every = store_ops.keep_latest(new).drop("seq")
        more = edges.select(*self.edges.columns, F.lit(1).alias("seq")).unionByName(self.edges.withColumn("seq", F.lit(0)))
        return GraphStore(every, graph.induced_edges(store_ops.keep_latest(more).drop("seq"), every), self.sources, self.vectors)

    def import_report(self, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
        """What import_batch would do with the rows: counts, and the rows it rejects with their errors."""
        return store_ops.import_report(self.nodes, self.edges, nodes, edges)

    def import_counted(self, nodes: DataFrame, edges: DataFrame) -> tuple[GraphStore, dict[str, int], DataFrame]:
        """import_batch that writes the new rows once: the store, counts of what was created, updated and rejected, and
        the rejected rows with their errors."""
        every, links, counts, errors = store_ops.import_rows(self.nodes, self.edges, nodes, edges)
        return GraphStore(every, links, self.sources, self.vectors), counts, errors

    def delete_repo(self, repo: str) -> GraphStore:
        return GraphStore(*store_ops.delete_scope(self.nodes, self.edges, repo), self.sources, self.vectors)
