"""Search: BM25 with expansion, vectors, rank fusion, hybrid search, grep."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import glob_pattern, tokenize
from graphloom.operators.fulltext import FullText, Scan, holds_any
from graphloom.session import written

K1, B = 1.5, 0.75
NAME_BOOST = 2.0
RRF_K = 60


def tokens_of(docs: DataFrame) -> DataFrame:
    """id, tokens and names (tokens of the name) of docs (id, name, text)."""
    return docs.select("id", tokenize(F.coalesce("text", F.lit(""))).alias("tokens"), tokenize(F.coalesce("name", F.lit(""))).alias("names"))


def _exploded(rows: DataFrame) -> DataFrame:
    posts = rows.select("id", F.size("tokens").alias("len"), "names", F.explode("tokens").alias("token"))
    return posts.select("id", "token", F.array_contains("names", F.col("token")).alias("in_name"), "len")


def postings(docs: DataFrame) -> DataFrame:
    """id, token, in_name, len for docs (id, name, text). Tokens of a document are
    distinct, so its length is their number and a token's frequency is one."""
    return _exploded(tokens_of(docs))


def query_tokens(spark, query: str) -> list[str]:
    return spark.range(1).select(tokenize(F.lit(query)).alias("t")).first()["t"]


def expansions(vocabulary: DataFrame, terms: Sequence[str]) -> DataFrame:
    """term, token, penalty: the token itself; if it is not in the vocabulary, at most 20
    tokens that start with it (three letters or more); if there are none, at most 10
    within one edit (four letters or more)."""
    spark = vocabulary.sparkSession
    asked = F.broadcast(spark.createDataFrame([(t,) for t in terms], "term string"))
    exact = vocabulary.join(asked, F.col("token") == F.col("term")).select("term", "token", F.lit(1.0).alias("penalty"), F.lit(0).alias("kind"))
    near = F.length("term") >= 4
    prefix = vocabulary.join(asked, (F.length("term") >= 3) & F.col("token").startswith(F.col("term")) & (F.col("token") != F.col("term"))).select("term", "token", F.lit(0.8).alias("penalty"), F.lit(1).alias("kind"))
    fuzzy = vocabulary.join(asked, near & (F.abs(F.length("token") - F.length("term")) <= 1) & (F.levenshtein("token", "term", 1) == 1)).select("term", "token", F.lit(0.6).alias("penalty"), F.lit(2).alias("kind"))
    order = Window.partitionBy("term", "kind").orderBy("token")
    ranked = exact.union(prefix).union(fuzzy).withColumn("_n", F.row_number().over(order)).where((F.col("kind") == 0) | ((F.col("kind") == 1) & (F.col("_n") <= 20)) | ((F.col("kind") == 2) & (F.col("_n") <= 10)))
    first = ranked.groupBy("term").agg(F.min("kind").alias("_kind"))
    return ranked.join(first, "term").where(F.col("kind") == F.col("_kind")).select("term", "token", "penalty")


@dataclass(frozen=True)
class Segment:
    """What one update added: postings (token, id, in_name, len) in ranges of tokens, its documents (id, len, tokens), the
    ids it hides in earlier segments, and changes of document frequencies (token, df) and totals, which may be negative."""

    number: int
    postings: DataFrame
    documents: DataFrame
    hidden: DataFrame | None
    frequencies: DataFrame
    held: int
    n_docs: int
    total_len: int


@dataclass(frozen=True)
class Index:
    """A stored search index of segments. A query reads the row groups of its tokens only; an update writes a segment in
    proportion to its documents, and now and then merges segments of about one size, so that each document is
    written again as often as the logarithm of the index's size."""

    segments: tuple[Segment, ...]

    #: Segments of one size (to a factor of as many) that become one.
    MERGED = 8

    @classmethod
    def build(cls, docs: DataFrame) -> Index:
        """Of docs (id, name, text); the texts are read once."""
        return cls((cls._segment(0, written(tokens_of(docs), "tokens"), None),))

    @staticmethod
    def _segment(number: int, rows: DataFrame, dead: DataFrame | None) -> Segment:
        """A segment of rows (id, tokens, names) that hides the dead documents (id, len, tokens)."""
        posts = written(_exploded(rows).repartitionByRange("token").sortWithinPartitions("token"), "postings")
        own = rows.select("id", F.size("tokens").alias("len"), "tokens")
        counts = posts.groupBy("token").agg(F.count("id").alias("df"))
        sums = lambda df: df.agg(F.count("len"), F.coalesce(F.sum("len"), F.lit(0))).first()
        n, total = sums(own)
        held = n
        if dead is not None:
            less = dead.select(F.explode("tokens").alias("token")).groupBy("token").agg((-F.count("token")).alias("df"))
            counts = counts.unionByName(less).groupBy("token").agg(F.sum("df").alias("df")).where("df <> 0")
            gone = sums(dead)
            n, total = n - gone[0], total - gone[1]
        return Segment(number, posts, own, dead.select("id").distinct() if dead is not None else None, written(counts, "frequencies"), held, n, total)

    def _living(self, kind: str, segments: Sequence[Segment] | None = None) -> DataFrame:
        """postings or documents of segments without those that a later segment hides."""
        rows = reduce(DataFrame.unionByName, [getattr(s, kind).withColumn("_segment", F.lit(s.number)) for s in segments or self.segments])
        hiding = [s.hidden.select("id", F.lit(s.number).alias("_before")) for s in self.segments if s.hidden is not None]
        if not hiding:
            return rows.drop("_segment")
        hidden = reduce(DataFrame.unionByName, hiding).groupBy("id").agg(F.max("_before").alias("_before"))
        return rows.join(hidden, "id", "left").where("_before IS NULL OR _segment >= _before").drop("_segment", "_before")

    @property
    def postings(self) -> DataFrame:
        """token, id, in_name, len."""
        return self._living("postings")

    @property
    def vocabulary(self) -> DataFrame:
        """token, df."""
        if len(self.segments) == 1:
            return self.segments[0].frequencies
        every = reduce(DataFrame.unionByName, [s.frequencies for s in self.segments])
        return every.groupBy("token").agg(F.sum("df").alias("df")).where("df > 0")

    @property
    def sizes(self) -> DataFrame:
        """id, len."""
        return self._living("documents").select("id", "len")

    @property
    def n_docs(self) -> int:
        return sum(s.n_docs for s in self.segments)

    @property
    def avg_len(self) -> float | None:
        return sum(s.total_len for s in self.segments) / self.n_docs if self.n_docs else None

    def remove(self, ids: DataFrame) -> Index:
        """Without the documents of ids (id)."""
        none = self.segments[0].documents.where("false").select("id", "tokens", F.col("tokens").alias("names"))
        return self._with(none, ids)

    def update(self, docs: DataFrame) -> Index:
        """With docs (id, name, text) in place of those with the same ids."""
        rows = written(tokens_of(docs), "tokens")
        return self._with(rows, rows.select("id"))

    def _with(self, rows: DataFrame, ids: DataFrame) -> Index:
        dead = written(self._living("documents").join(ids.select("id").distinct(), "id", "left_semi").select("id", "len", "tokens"), "hidden")
        return Index((*self.segments, self._segment(self.segments[-1].number + 1, rows, dead)))._merged()

    def _merged(self) -> Index:
        """With the last segments as one, where enough of them are of one size."""
        tier = lambda s: int(math.log(max(1, s.held), self.MERGED))
        last, n = tier(self.segments[-1]), 0
        while n < len(self.segments) and tier(self.segments[-1 - n]) <= last:
            n += 1
        if n < self.MERGED:
            return self
        group = self.segments[-n:]
        posts = written(self._living("postings", group).repartitionByRange("token").sortWithinPartitions("token"), "postings")
        documents = written(self._living("documents", group).select("id", "len", "tokens"), "documents")
        # a row that is hidden still counts in the sums, as what hides it counts against it
        counts = reduce(DataFrame.unionByName, [s.frequencies for s in group]).groupBy("token").agg(F.sum("df").alias("df")).where("df <> 0")
        hiding = [s.hidden for s in group if s.hidden is not None]
        # ids hidden before the group stay so: the new number is above theirs and no hidden row is in the group any more
        hidden = written(reduce(DataFrame.unionByName, hiding).distinct(), "hidden") if hiding and n < len(self.segments) else None
        one = Segment(group[-1].number, posts, documents, hidden, written(counts, "frequencies"), documents.count(), sum(s.n_docs for s in group), sum(s.total_len for s in group))
        return Index((*self.segments[:-n], one))._merged() if n < len(self.segments) else Index((one,))


def bm25(index: Index | DataFrame, query: str, limit: int | None = 50, boost: float = NAME_BOOST) -> DataFrame:
    """id, score of the best documents, ties to the smaller id. Of a stored index, or of docs (id, name, text), which for one
    query are not indexed: their tokens are counted where they are, and what holds one of the query's is split again.
    At most 20 tokens stand for a term, so they come to the driver and prune the postings or documents."""
    if isinstance(index, Index):
        vocabulary, n_docs, avg_len = index.vocabulary, index.n_docs, index.avg_len
    else:
        said = tokens_of(index).select(F.explode_outer("tokens").alias("token"))  # outer, or Spark splits once more for a filter
        vocabulary = written(said.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("token IS NOT NULL"), "frequencies")
        n_docs, total = index.count(), vocabulary.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]  # a document's tokens are distinct
        avg_len = total / n_docs if n_docs else None
    used = written(expansions(vocabulary.select("token"), query_tokens(vocabulary.sparkSession, query)).join(vocabulary, "token"), "query-tokens")
    tokens = [r["token"] for r in used.select("token").distinct().collect()]
    posts = index.postings if isinstance(index, Index) else postings(index.where(holds_any(F.lower("text"), tokens)))
    idf = F.log((F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    tf = (K1 + 1) / (1 + K1 * (1 - B + B * F.col("len") / F.lit(avg_len).cast("double")))
    score = idf * tf * F.col("penalty") * F.when(F.col("in_name"), boost).otherwise(1.0)
    posts = posts.where(F.col("token").isin(tokens)).join(F.broadcast(used), "token")
    rows = posts.groupBy("id").agg(F.sum(score).alias("score"))
    return rows.orderBy(F.col("score").desc(), "id").limit(limit) if limit is not None else rows


def scoped_search(index: Index, nodes: DataFrame, query: str, scope: Column | None = None, types: Sequence[str] | None = None, limit: int = 20) -> DataFrame:
    """The best nodes (their columns and score) within a scope and of some types, ranked by the statistics
    of the whole index; truncated says whether there were more."""
    if scope is not None:
        nodes = nodes.where(scope)
    if types:
        nodes = nodes.where(F.col("type").isin(list(types)))
    best = written(bm25(index, query, None).join(nodes, "id").orderBy(F.col("score").desc(), "id").limit(limit + 1), "scoped")
    return best.withColumn("truncated", F.lit(best.count() > limit)).orderBy(F.col("score").desc(), "id").limit(limit)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for a zero vector; null if the lengths differ."""
    norm = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when(F.size(a) == F.size(b), F.when(norm > 0, _dot(a, b) / norm).otherwise(0.0))


def nearest(vectors: DataFrame, query: Sequence[float], limit: int = 20, max_distance: float | None = None) -> DataFrame:
    """id, score (cosine) of the closest vectors; with ``max_distance``, those nearer than that only."""
    q = F.array(*[F.lit(float(x)) for x in query])
    rows = vectors.select("id", cosine(F.col("vec"), q).alias("score")).where("score IS NOT NULL")
    if max_distance is not None:
        rows = rows.where(1 - F.col("score") < max_distance)
    return rows.orderBy(F.col("score").desc(), "id").limit(limit)


def distance_score(distance: Column) -> Column:
    return F.exp(-2 * distance)


def ranked(rows: DataFrame) -> DataFrame:
    """id, rank (from 1) of a bounded result list."""
    return rows.select("id", F.row_number().over(Window.orderBy(F.col("score").desc(), "id")).alias("rank"))


def fuse(lists: Sequence[DataFrame], limit: int = 50, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of result lists (id, score)."""
    every = None
    for rows in lists:
        one = ranked(rows)
        every = one if every is None else every.unionByName(one)
    fused = every.groupBy("id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"))
    return fused.orderBy(F.col("score").desc(), "id").limit(limit)


def name_contains(nodes: DataFrame, query: str) -> DataFrame:
    """Nodes whose name holds the query, whatever the case; shorter names are better."""
    hit = nodes.where(F.lower("name").contains(query.lower()))
    return hit.select("id", (1.0 / (1 + F.length("name"))).alias("score"))


def name_or_id_contains(nodes: DataFrame, query: str, types: Sequence[str] | None = None) -> DataFrame:
    """Nodes (of some types) whose name or id contains a text, in any case."""
    part = query.lower()
    found = nodes.where(F.lower("name").contains(part) | F.lower("id").contains(part))
    return found.where(F.col("type").isin(list(types))) if types else found


def hybrid(docs: DataFrame, query: str, vectors: DataFrame | None = None, query_vector: Sequence[float] | None = None, types: Sequence[str] | None = None, limit: int = 50, index: Index | None = None, full_text: FullText | Scan | None = None) -> DataFrame:
    """BM25, stemmed full text and vector lists fused by rank; if all are empty, names that hold the query.
    Types are filtered before the ranking, so none of the places is lost to others. A
    stored index of all docs serves queries without types; full text keeps the statistics of all its documents."""
    ids = None
    if types:
        docs, index = docs.where(F.col("type").isin(list(types))), None
        ids = docs.select("id")
        vectors = vectors.join(ids, "id", "left_semi") if vectors is not None else None
    lists = [bm25(index or docs, query, 2 * limit)]
    if full_text is not None:
        lists.append(full_text.search(query, 2 * limit, within=ids))
    if vectors is not None and query_vector is not None:
        lists.append(nearest(vectors, query_vector, 2 * limit, 0.65))
    found = written(fuse(lists, limit), "found")
    return found.orderBy(F.col("score").desc(), "id") if not found.isEmpty() else name_contains(docs, query).orderBy(F.col("score").desc(), "id").limit(limit)


def grep(files: DataFrame, pattern: str, case_sensitive: bool = False, limit: int | None = 100, path_part: str | None = None, include: str | None = None) -> DataFrame:
    """id, line, text (trimmed, 200 characters) of the lines that match a regular
    expression, in order. An expression that is none gives no rows."""
    schema_rows = files.where("false").select("id", F.lit(1).alias("line"), F.lit("").alias("text"))
    try:
        re.compile(pattern)
    except re.error:
        return schema_rows
    if path_part:
        files = files.where(F.col("path").contains(path_part))
    if include:
        files = files.where(F.col("path").rlike(glob_pattern(include)))
    regex = pattern if case_sensitive else f"(?i){pattern}"
    lines = files.select("id", F.posexplode(F.split("content", "\n", -1)).alias("_at", "_line")).where(F.col("_line").rlike(regex))
    rows = lines.select("id", (F.col("_at") + 1).alias("line"), F.substring(F.trim("_line"), 1, 200).alias("text"))
    return rows.orderBy("id", "line").limit(limit) if limit else rows


def grep_per_group(files: DataFrame, pattern: str, group: str, limit: int = 50, case_sensitive: bool = False) -> DataFrame:
    """The first lines of each group, and whether there are more."""
    rows = grep(files, pattern, case_sensitive, limit=None).join(files.select("id", group), "id")
    at = F.row_number().over(Window.partitionBy(group).orderBy("id", "line"))
    kept = rows.withColumn("_n", at).where(F.col("_n") <= limit + 1)
    more = kept.groupBy(group).agg((F.max("_n") > limit).alias("truncated"))
    return kept.where(F.col("_n") <= limit).drop("_n").join(more, group)


def source_slice(files: DataFrame, file_id: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """id, content (lines start to end, both or none) and line_count of a file."""
    lines = F.split("content", "\n", -1)
    part = F.array_join(F.slice(lines, start, end - start + 1), "\n") if start and end else F.col("content")
    return files.where(F.col("id") == file_id.split("::")[0]).select("id", part.alias("content"), F.size(lines).alias("line_count"))
