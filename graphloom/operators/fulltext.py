"""Full text with stems: an inverted index of fields, ranked by BM25 over term frequencies.

Words are runs of letters a-z and digits of the lower-cased text, without stop words, as Porter stems. Stems
are worked out once for each distinct word and joined. A term's frequency is counted in each field.
``FullText`` is stored and answers many queries; ``Scan`` answers one from the texts and writes only their vocabulary.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import fixed_values as fixed
from graphloom.functions.stemming import stem
from graphloom.functions.text import search_text
from graphloom.session import spread, written

K1, B = 1.2, 0.75
#: Characters of a source that its index holds.
SNIPPET = 10_000


def words(text: Column) -> Column:
    """All words of a text, repeats included, without stop words."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda w: ~w.isin("", *fixed.STOP_WORDS))  # one look into a set


def query_terms(spark: SparkSession, query: str) -> list[str]:
    asked = spark.createDataFrame([(query,)], "q string").select(F.explode(words(F.col("q"))).alias("word")).distinct()
    return sorted({r["term"] for r in stem(asked, "word", "term").collect()})


def holds_any(text: Column, parts: Sequence[str]) -> Column:
    """Whether a lower-cased text holds one of the parts anywhere: what has one of them as a word is among these."""
    return reduce(Column.__or__, [text.contains(p) for p in parts], F.lit(False))


def node_docs(nodes: DataFrame) -> DataFrame:
    """What is indexed of nodes: id and search_text."""
    return nodes.select("id", search_text(F.col("name"), F.col("type"), F.col("properties")).alias("search_text"))


def source_docs(sources: DataFrame, name: Column | None = None, size: int | None = SNIPPET) -> DataFrame:
    """What is indexed of sources (id, path, content): id, name (of the file) and the first characters of the text, all without a size."""
    named = F.element_at(F.split("path", "/"), -1) if name is None else name
    return sources.select("id", named.alias("name"), (F.col("content") if size is None else F.substring("content", 1, size)).alias("source_text"))


@dataclass
class FullText:
    """A stored index: postings (term, id, field, tf) in ranges of terms, so that a query reads the row groups of
    its terms only; terms (term, df); sizes (id, len)."""

    postings: DataFrame
    terms: DataFrame
    sizes: DataFrame
    fields: tuple[str, ...]

    #: Distinct words up to which their stems are broadcast.
    BROADCAST = 200_000

    @classmethod
    def build(cls, docs: DataFrame) -> FullText:
        """Of docs (id and text columns, the fields). Texts are split once; a document's words are counted in its own task."""
        fields = tuple(c for c in docs.columns if c != "id")
        split = [F.struct(F.lit(f).alias("field"), words(F.col(f)).alias("ws")) for f in fields]
        rows = docs.select("id", F.explode(F.array(*split)).alias("f")).select("id", "f.field", F.explode("f.ws").alias("word"))
        counted = written(rows.groupBy("id", "field", "word").agg(F.count(F.lit(1)).alias("tf")), "words")
        stems = written(stem(counted.select("word").distinct(), "word", "term"), "stems")
        # a word may be in every document, so a vocabulary of bounded size goes to all tasks and ranges are cut within a term
        posts = counted.join(F.broadcast(stems) if stems.count() <= cls.BROADCAST else stems, "word").groupBy("term", "id", "field").agg(F.sum("tf").alias("tf"))
        posts = written(posts.repartitionByRange("term", "id").sortWithinPartitions("term"), "full-text")
        counts = counted.groupBy("id").agg(F.sum("tf").alias("len"))
        sizes = written(docs.select("id").join(counts, "id", "left").select("id", F.coalesce("len", F.lit(0).cast("long")).alias("len")), "full-text-sizes")
        return cls(posts, written(posts.groupBy("term").agg(F.count_distinct("id").alias("df")) if len(fields) > 1 else posts.groupBy("term").agg(F.count("id").alias("df")), "terms"), sizes, fields)

    def query_terms(self, query: str) -> list[str]:
        return query_terms(self.postings.sparkSession, query)

    def search(self, query: str, limit: int | None = 50, weights: Mapping[str, float] | None = None, conjunctive: bool = False, within: DataFrame | None = None) -> DataFrame:
        """id, score of the best documents, ties to the smaller id. ``weights`` multiply frequencies by field,
        ``conjunctive`` asks for all terms, ``within`` (id) restricts the result, not the statistics."""
        terms = self.query_terms(query)
        posts = self.postings.where(F.col("term").isin(terms)) if terms else self.postings.where("false")
        used = F.broadcast(self.terms.where(F.col("term").isin(terms) if terms else F.lit(False)))  # a row for each term asked for
        weight = F.lit(1.0)
        for field, w in (weights or {}).items():
            weight = F.when(F.col("field") == field, F.lit(float(w))).otherwise(weight)
        found = posts.groupBy("id", "term").agg(F.sum(F.col("tf") * weight).alias("tf")) if weights or len(self.fields) > 1 else posts.select("id", "term", "tf")
        if within is not None:
            found = found.join(within.select("id"), "id", "left_semi")
        whole = self.sizes.agg(F.count("len").alias("n_docs"), F.avg("len").alias("avg_len"))
        idf = F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
        part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
        rows = found.join(used, "term").join(self.sizes, "id").join(F.broadcast(whole))  # one row
        rows = rows.groupBy("id").agg(F.sum(part).alias("score"), F.count(F.lit(1)).alias("_terms"))
        rows = (rows.where(F.col("_terms") == len(terms)) if conjunctive else rows).select("id", "score")
        return rows.orderBy(F.col("score").desc(), "id").limit(limit) if limit is not None else rows


@dataclass
class Scan:
    """Full text of docs (distinct ids and text columns, the fields) for one query, with the results of ``FullText``: no
    postings are sent or written. All texts are read twice: for the number of each word (counted in their tasks, so each
    sends its vocabulary only), then for the documents that hold one of the words that stand for the query's terms."""

    docs: DataFrame

    def search(self, query: str, limit: int | None = 50, weights: Mapping[str, float] | None = None, conjunctive: bool = False, within: DataFrame | None = None) -> DataFrame:
        """As FullText.search()."""
        spark, fields = self.docs.sparkSession, [c for c in self.docs.columns if c != "id"]
        terms = query_terms(spark, query)
        split = F.concat(*[F.split(F.lower(F.coalesce(F.col(f), F.lit(""))), r"[\W_]+") for f in fields])
        counts = self.docs.where("id IS NOT NULL").select(F.explode_outer(split).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))  # outer, or Spark splits once more for a filter
        counts = written(counts.where(~F.col("word").isin("", *fixed.STOP_WORDS)), "vocabulary")
        # a step of the stemmer takes one of a few suffixes, so the words of a term are bounded, however large the vocabulary
        stands = {t: [] for t in terms}
        stems = written(stem(counts.select("word"), "word", "term"), "stems")  # a filter would move into the steps, each of which holds the one before several times
        for r in stems.where(F.col("term").isin(terms)).collect() if terms else ():
            stands[r["term"]].append(r["word"])
        n_docs, total = self.docs.count(), counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        asked = sorted(w for ws in stands.values() for w in ws)
        held = reduce(Column.__or__, [holds_any(F.lower(F.col(f)), asked) for f in fields])
        rows = self.docs.where(F.col("id").isNotNull() & F.coalesce(held, F.lit(False))).select("id", *[words(F.col(f)).alias(f) for f in fields])
        count = lambda f, ws: F.size(F.filter(F.col(f), lambda w: w.isin(ws)))
        times = {t: [count(f, ws) for f in fields] for t, ws in stands.items()}
        weigh = [F.lit(float((weights or {}).get(f, 1.0))) for f in fields]
        met = [F.struct(reduce(Column.__add__, t).alias("n"), reduce(Column.__add__, [w * x for w, x in zip(weigh, t, strict=True)]).alias("tf")).alias(f"t{i}") for i, t in enumerate(times.values())]
        rows = rows.select("id", reduce(Column.__add__, [F.size(f) for f in fields]).alias("len"), *met)
        n = [F.col(f"t{i}.n") for i in range(len(terms))]
        rows = written(rows.where(reduce(Column.__or__, [x > 0 for x in n], F.lit(False))), "full-text-found")
        df = rows.agg(F.count(F.lit(1)), *[F.count(F.when(x > 0, True)) for x in n]).first()[1:]
        if within is not None:
            rows = rows.join(within.select("id"), "id", "left_semi")
        score = F.lit(0.0)
        for i, d in enumerate(df):
            tf, idf = F.col(f"t{i}.tf"), F.log((F.lit(n_docs) - F.lit(d) + 0.5) / (F.lit(d) + 0.5) + 1)
            part = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.lit(total / n_docs if n_docs else None).cast("double")))
            score = score + F.when(n[i] > 0, part).otherwise(0.0)
        rows = rows.where(reduce(Column.__and__, [x > 0 for x in n], F.lit(True))) if conjunctive else rows
        rows = rows.select("id", score.alias("score"))
        return rows.orderBy(F.col("score").desc(), "id").limit(limit) if limit is not None else rows


def search_nodes(index: FullText, nodes: DataFrame, query: str, types: Sequence[str] | None = None, limit: int = 50) -> DataFrame:
    """Nodes by full text: twice the limit is ranked, then types are filtered. If the index finds anything the filtered
    list is final, even if it is empty; if not, names that hold the query stand in."""
    best = written(index.search(query, 2 * limit), "full-text-found")
    if best.isEmpty():
        hit = nodes.where(F.lower("name").contains(query.lower()))
        best = hit.select("id", (1.0 / (1 + F.length("name"))).alias("score"))
    rows = nodes.join(best, "id")
    rows = rows.where(F.col("type").isin(list(types))) if types else rows
    return rows.orderBy(F.col("score").desc(), "id").limit(limit)


def index_sources(sources: DataFrame) -> FullText:
    return FullText.build(source_docs(spread(sources)))
