"""Writes as DataFrame operations: upserts, merges, deletes, differences, facets, ranks."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from graphloom.session import written


def keep_latest(rows: DataFrame, key: str = "id", seq: str = "seq") -> DataFrame:
    """Upsert: the row with the largest seq of each key."""
    others = [c for c in rows.columns if c != key]
    latest = rows.groupBy(key).agg(F.max_by(F.struct(*others), seq).alias("_row"))
    return latest.select(key, "_row.*").select(*rows.columns)


def keep_first(rows: DataFrame, key: str = "id", seq: str = "seq") -> DataFrame:
    """The row with the smallest seq of each key."""
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min_by(F.struct(*others), seq).alias("_row")).select(key, "_row.*").select(*rows.columns)


def merge_properties(rows: DataFrame) -> DataFrame:
    """id, type, name, properties (a map): the first type and name of an id, and for each
    property the last value by seq."""
    first = rows.groupBy("id").agg(F.min_by(F.struct("type", "name"), "seq").alias("f")).select("id", "f.type", "f.name")
    pairs = rows.select("id", "seq", F.explode("properties").alias("k", "v")).groupBy("id", "k").agg(F.max_by("v", "seq").alias("v"))
    merged = pairs.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("properties"))
    empty = F.create_map().cast("map<string,string>")
    return first.join(merged, "id", "left").withColumn("properties", F.coalesce("properties", empty))


def insert_missing(existing: DataFrame, new: DataFrame) -> DataFrame:
    """existing and those of new whose id is not there; of equal ids the smallest row."""
    rest = [c for c in new.columns if c != "id"]
    fresh = new.join(existing.select("id"), "id", "left_anti").groupBy("id").agg(F.min(F.struct(*rest)).alias("_row")).select("id", "_row.*")
    return existing.unionByName(fresh.select(*existing.columns))


def edges_with_ends(nodes: DataFrame, edges: DataFrame, parts: int | None = None) -> DataFrame:
    from graphloom.operators.graph import induced_edges

    return induced_edges(edges, nodes, parts)


def in_scope(node_id: Column, repo: str) -> Column:
    """Whether an id is the repository, lies in it, or is its metadata."""
    return (node_id == repo) | node_id.startswith(f"{repo}/") | (node_id == f"_meta:index:{repo}")


def delete_scopes(nodes: DataFrame, edges: DataFrame, repos: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes and edges without those of several repositories (repo): an id is in the scope of any
    of its prefixes, which are joined by equality."""
    gone = attribute_scopes(nodes.select("id").unionByName(edges.select(F.col("source_id").alias("id"))).unionByName(edges.select(F.col("target_id").alias("id"))), repos)
    kept = nodes.join(gone, "id", "left_anti")
    return kept, edges.join(gone.withColumnRenamed("id", "source_id"), "source_id", "left_anti").join(gone.withColumnRenamed("id", "target_id"), "target_id", "left_anti")


def attribute_scopes(ids: DataFrame, repos: DataFrame) -> DataFrame:
    """Those of the ids that are a repository, lie in it, or are its metadata."""
    bare = F.regexp_replace("id", "^_meta:index:", "")
    parts = F.split(bare, "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    own = F.when(F.col("id").startswith("_meta:index:"), F.array(bare)).otherwise(prefixes)
    return ids.distinct().select("id", F.explode(own).alias("repo")).join(repos.select("repo").distinct(), "repo", "left_semi").select("id").distinct()


def delete_scope(nodes: DataFrame, edges: DataFrame, repo: str) -> tuple[DataFrame, DataFrame]:
    return nodes.where(~in_scope(F.col("id"), repo)), edges.where(~(in_scope(F.col("source_id"), repo) | in_scope(F.col("target_id"), repo)))


def snapshot_diff(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """key and change: added, removed or changed between two snapshots of the same columns."""
    cols = [c for c in old.columns if c != key]
    a = old.select(F.col(key), F.xxhash64(*cols).alias("_a"))
    b = new.select(F.col(key), F.xxhash64(*cols).alias("_b"))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_a") != F.col("_b"), "changed")
    return a.join(b, key, "full").select(key, change.alias("change")).where("change IS NOT NULL")


def scoped(nodes: DataFrame, edges: DataFrame, repo: str) -> tuple[DataFrame, DataFrame]:
    """A repository's part of the graph: its nodes, the dependencies that they name, and the edges among them."""
    own = nodes.where(in_scope(F.col("id"), repo))
    used = edges.join(own.select(F.col("id").alias("source_id")), "source_id", "left_semi").select(F.col("target_id").alias("id"))
    deps = nodes.where("type = 'Dependency'").join(used, "id", "left_semi")
    part = own.unionByName(deps).dropDuplicates(["id"])
    return part, edges_with_ends(part, edges)


def attribute(ids: DataFrame, repos: DataFrame) -> DataFrame:
    """id, repo: the longest repository id that is the id or a folder above it, else the
    first segment. Prefixes are joined by equality, so no pair is compared in vain."""
    parts = F.split(F.substring_index("id", "::", 1), "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    rows = ids.select("id").distinct().select("id", F.posexplode(prefixes).alias("n", "repo"))
    found = rows.join(repos.select(F.col("id").alias("repo")).distinct(), "repo").groupBy("id").agg(F.max_by("repo", "n").alias("repo"))
    return ids.select("id").distinct().join(found, "id", "left").select("id", F.coalesce("repo", F.split("id", "/")[0]).alias("repo"))


def top_per_group(rows: DataFrame, group: str, order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of each group with position and the count of those not shown."""
    ranked = rows.withColumn("position", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("position") <= k)
    counts = rows.groupBy(group).agg(F.greatest(F.count(F.lit(1)) - k, F.lit(0)).alias("more"))
    return ranked.join(counts, group)


def stratified(rows: DataFrame, group: str, order: Sequence[Column], total: int) -> DataFrame:
    """About ``total`` rows, as many from each group."""
    groups = max(1, rows.select(group).distinct().count())
    position = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("position", position).where(F.col("position") <= max(1, total // groups))


def facets(nodes: DataFrame, sub: Column) -> DataFrame:
    """type, sub_type, n with totals by type (sub_type null) and over all (type null)."""
    rows = nodes.select("type", sub.alias("sub_type")).rollup("type", "sub_type").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))
    return rows


def facet_tree(nodes: DataFrame, sub: Column, hidden: Sequence[str] = ()) -> DataFrame:
    """type, n, hidden, subs: types by number, each with its sub-types (an array of n, sub_type, the most frequent first)."""
    by = nodes.select("type", sub.alias("sub_type")).groupBy("type", "sub_type").agg(F.count(F.lit(1)).alias("n"))
    named = F.when(F.col("sub_type").isNotNull(), F.struct((-F.col("n")).alias("n"), "sub_type"))
    tree = by.groupBy("type").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(named)).alias("_subs"))
    return tree.select("type", "n", F.col("type").isin(*hidden).alias("hidden"), F.transform("_subs", lambda x: F.struct((-x["n"]).alias("n"), x["sub_type"].alias("sub_type"))).alias("subs")).orderBy(F.col("n").desc(), "type")


def unpacked(nodes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Some properties as columns, as text; a nested value stays JSON."""
    return nodes.select("*", *[F.get_json_object("properties", f"$.{k}").alias(k) for k in keys])


#: A quoted string, a bracket or mark, or plain text up to the next of these.
_TOKEN = r"""("(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|[{}\[\],:]|[^\s{}\[\],:"'][^{}\[\],:]*)"""


def _plain(token: Column) -> Column:
    """A token without its quotes and the backslashes before quotes in it."""
    return F.when(token.rlike(r"""(?s)^(".*"|'.*')$"""), F.regexp_replace(F.regexp_replace(token, r"""(?s)^["'](.*)["']$""", "$1"), r"""\\(["'\\])""", "$1")).otherwise(token)


def _named(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _as_json(tokens: Column) -> Column:
    """The tokens of a nested value as JSON: plain keys and words in quotes, numbers, booleans and null as they are."""
    quoted = lambda t: F.regexp_extract(F.to_json(F.array(_plain(t))), r"(?s)^\[(.*)\]$", 1)

    def one(t: Column, i: Column) -> Column:
        key = F.coalesce(F.get(tokens, i + 1) == ":", F.lit(False))
        number = t.rlike(r"^(-?(0|[1-9][0-9]*)([.][0-9]+)?([eE][+-]?[0-9]+)?|true|false|null)$")
        return F.when(t.rlike(r"^[{}\[\],:]$") | (number & ~key), t).otherwise(quoted(t))

    return F.array_join(F.transform(tokens, one), "")


def parse_map_literal(literal: Column) -> Column:
    """A map from a literal such as {a: 1, b: 'x', c: {d: [2, 3]}} with plain or quoted keys; a nested value is JSON text
    ({"d":[2,3]}). Later keys win; entries without a key and a value are left out; null if brackets do not balance or
    it is no map."""
    tokens = F.transform(F.regexp_extract_all(literal, F.lit(_TOKEN), F.lit(1)), lambda t: F.regexp_replace(t, r"\s+$", ""))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("entry"), F.lit(True).alias("fits"), F.array().cast("array<struct<entry:int,token:string>>").alias("out"))

    def step(at: Column, t: Column) -> Column:
        opens, closes = t.isin("{", "["), t.isin("}", "]")
        # the outer braces and the commas between entries are not part of an entry
        outer = (closes & (at["depth"] == 1)) | (at["depth"] == 0) | ((t == ",") & (at["depth"] == 1))
        return F.struct(
            (at["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)).alias("depth"),
            (at["entry"] + F.when((t == ",") & (at["depth"] == 1), 1).otherwise(0)).alias("entry"),
            # nothing stands outside the braces: only the first token is met at depth 0
            (at["fits"] & ((at["depth"] > 0) | ((t == "{") & (F.size(at["out"]) == 0) & (at["entry"] == 0)))).alias("fits"),
            F.when(outer, at["out"]).otherwise(F.array_append(at["out"], F.struct(at["entry"].alias("entry"), t.alias("token")))).alias("out"),
        )

    def pair(x: Column) -> Column:
        value = F.slice(x, F.lit(3), F.size(x))
        first = F.get(value, F.lit(0))
        text = F.when(F.size(value) == 1, _plain(first)).when(first.isin("{", "["), _named(value, _as_json)).otherwise(F.array_join(value, ""))
        return F.struct(_plain(F.get(x, F.lit(0))).alias("key"), text.alias("value"))

    def last_of_each(pairs: Column) -> Column:
        keys = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
        return F.map_from_entries(F.transform(keys, lambda k: F.element_at(F.filter(pairs, lambda p: p["key"] == k), -1)))

    def finish(end: Column) -> Column:
        entries = F.transform(F.sequence(F.lit(0), end["entry"]), lambda e: F.transform(F.filter(end["out"], lambda x: x["entry"] == e), lambda x: x["token"]))
        whole = F.filter(entries, lambda x: (F.size(x) >= 3) & (F.get(x, F.lit(1)) == ":") & ~F.get(x, F.lit(0)).rlike(r"^[{}\[\],:]$"))
        return F.when((end["depth"] == 0) & end["fits"], _named(F.transform(whole, pair), last_of_each))

    return F.when(literal.rlike(r"(?s)^\s*\{.*\}\s*$"), F.aggregate(tokens, start, step, finish))


def import_report(nodes: DataFrame, edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Counts (what, n) of an import, and its rejected rows (what, id, error): rows without an id or
    type, and edges without their ends among the old and the new nodes."""
    bad = lambda df, what: df.where("id IS NULL OR type IS NULL").select(F.lit(what).alias("what"), "id", F.when(F.col("id").isNull(), "no id").otherwise("no type").alias("error"))
    good_nodes, good_edges = (df.where("id IS NOT NULL AND type IS NOT NULL") for df in (new_nodes, new_edges))
    ids = nodes.select("id").unionByName(good_nodes.select("id")).distinct()
    joined = good_edges
    for end in ("source_id", "target_id"):
        joined = joined.join(ids.select(F.col("id").alias(end), F.lit(True).alias(f"_{end}")), end, "left")
    missing = joined.where("_source_id IS NULL OR _target_id IS NULL").select(F.lit("edge").alias("what"), "id", F.when(F.col("_source_id").isNull(), "no source").otherwise("no target").alias("error"))
    errors = bad(new_nodes, "node").unionByName(bad(new_edges, "edge")).unionByName(missing)
    known = nodes.select("id", F.lit(True).alias("_old"))
    fates = good_nodes.select("id").distinct().join(known, "id", "left").select(F.when(F.col("_old"), "nodes_updated").otherwise("nodes_created").alias("what"))
    old_edges = edges.select("id", F.lit(True).alias("_old"))
    fates = fates.unionByName(joined.where("_source_id AND _target_id").select("id").distinct().join(old_edges, "id", "left").select(F.when(F.col("_old"), "edges_updated").otherwise("edges_created").alias("what")))
    return fates.unionByName(errors.select(F.lit("errors").alias("what"))).groupBy("what").agg(F.count("what").alias("n")), errors


def import_rows(nodes: DataFrame, edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame) -> tuple[DataFrame, DataFrame, dict[str, int], DataFrame]:
    """nodes and edges after an import, counts of what it did, and its rejected rows (what, id, error), as import_report
    gives them. The new rows are judged and written once; the counts are observed on the way. Of new rows with one id
    the largest counts."""
    from graphloom.operators.graph import induced_edges

    def judged(old: DataFrame, rows: DataFrame, what: str, error: Column, keep: list[str]) -> tuple[DataFrame, dict[str, int]]:
        rows = rows.withColumn("_error", error)
        rest = [c for c in keep if c != "id"]
        good = rows.where("_error IS NULL").groupBy("id").agg(F.max(F.struct(*rest)).alias("_row")).select("id", "_row.*")
        fates = good.join(old.select("id", F.lit(True).alias("_old")).distinct(), "id", "left").withColumn("_error", F.lit(None).cast("string"))
        every = fates.unionByName(rows.where("_error IS NOT NULL").select(*keep, "_error", F.lit(None).cast("boolean").alias("_old")))
        seen, fine = Observation(), F.col("_error").isNull()
        updated = F.coalesce("_old", F.lit(False))
        counts = {f"{what}s_created": fine & ~updated, f"{what}s_updated": fine & updated, "errors": ~fine}
        # observed right before the write, in its last stage: a stage that is run again is not counted twice
        stored = written(every.observe(seen, *[F.count_if(c).alias(k) for k, c in counts.items()]), f"import-{what}")
        return stored, seen.get

    untyped = F.when(F.col("id").isNull(), "no id").when(F.col("type").isNull(), "no type")
    own, node_counts = judged(nodes, new_nodes.select(*nodes.columns), "node", untyped, nodes.columns)
    fresh = own.where("_error IS NULL").select(*nodes.columns)
    after = nodes.join(fresh.select("id"), "id", "left_anti").select(*nodes.columns).unionByName(fresh)
    ids, ended = after.select("id").distinct(), new_edges.select(*edges.columns)
    for end in ("source_id", "target_id"):
        ended = ended.join(ids.select(F.col("id").alias(end), F.lit(True).alias(f"_{end}")), end, "left")
    loose = untyped.when(F.col("_source_id").isNull(), "no source").when(F.col("_target_id").isNull(), "no target")
    links, edge_counts = judged(edges, ended, "edge", loose, edges.columns)
    linked = links.where("_error IS NULL").select(*edges.columns)
    after_edges = induced_edges(edges.join(linked.select("id"), "id", "left_anti").select(*edges.columns).unionByName(linked), after)
    errors = reduce(DataFrame.unionByName, [df.where("_error IS NOT NULL").select(F.lit(what).alias("what"), "id", F.col("_error").alias("error")) for what, df in (("node", own), ("edge", links))])
    counts = node_counts | edge_counts | {"errors": node_counts["errors"] + edge_counts["errors"]}
    return after, after_edges, counts, errors


def merge_refs(rows: DataFrame) -> DataFrame:
    """scope_id, name, seq and refs of variables (scope_id, name, seq, refs): repeated assignments are one
    variable at the place of the first, with the references of all in their order."""
    by = rows.groupBy("scope_id", "name").agg(F.min("seq").alias("seq"), F.array_sort(F.collect_list(F.struct("seq", "refs"))).alias("_all"))
    return by.select("scope_id", "name", "seq", F.flatten(F.transform("_all", lambda x: x["refs"])).alias("refs"))
