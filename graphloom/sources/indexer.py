"""From files to a graph: folders and files, symbols, imports, calls, variables and their
data flow, dependencies, summaries and index metadata, all as joins over exploded facts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import text
from graphloom.operators import resolve
from graphloom.operators.store_ops import keep_first, keep_latest
from graphloom.session import written
from graphloom.sources import blocks, code, files, lexer, manifests, syntax


def _edge(kind: str, source: Column, target: Column, properties: Column | None = None) -> list[Column]:
    made = F.concat(source, F.lit(f"->{kind}->"), target)
    return [made.alias("id"), F.lit(kind).alias("type"), source.alias("source_id"), target.alias("target_id"), (F.lit("{}") if properties is None else properties).alias("properties")]


def symbol_table(sources: DataFrame, facts: DataFrame, parsed: DataFrame) -> DataFrame:
    """node_id, name, kind, file_id, parent_id, receiver_var, receiver_type, seq, lines, signature, docs, bases, language. ``parsed``
    are the symbols of languages other than Python."""
    none = F.lit(None).cast("string")
    own = facts.where("what = 'symbol'").select(
        F.concat("scope", F.lit("::"), "name", F.coalesce("signature", F.lit(""))).alias("node_id"), "name", "kind", "file_id", F.col("scope").alias("parent_id"),
        none.alias("receiver_var"), none.alias("receiver_type"), "seq", "start_line", "end_line", "signature", "docs", "bases",
    )
    receiver = F.coalesce(F.concat("receiver_type", F.lit(".")), F.lit(""))
    none_of = F.array().cast("array<string>")
    bases = F.concat(F.coalesce("superclasses", none_of), F.coalesce("interfaces", none_of)).alias("bases")
    other = parsed.select(
        F.concat("scope", F.lit("::"), receiver, F.col("name")).alias("node_id"), "name", "kind", "file_id", F.col("scope").alias("parent_id"),
        "receiver_var", "receiver_type", "seq", "start_line", "end_line", "signature", "docs", F.when(F.col("kind") == "class", bases).alias("bases"),
    )
    every = keep_first(own.unionByName(other).withColumn("_key", F.col("node_id")), "_key", "seq").drop("_key")
    return every.join(sources.select("file_id", "language"), "file_id")


def _imports(facts: DataFrame, sources: DataFrame, tree: DataFrame) -> DataFrame:
    """file_id, alias, module, target_file_id (null: external), language of all imports."""
    paths = sources.select("file_id", "path", "language")
    python = facts.where("what = 'import'").select("file_id", F.lit("python").alias("language"), F.col("name").alias("alias"), F.col("receiver").alias("module"), F.when(F.col("kind") == "from", F.col("signature")).alias("member"))
    named = written(python.unionByName(blocks.imports(sources)).join(paths.select("file_id", "path"), "file_id"), "named-imports")
    found = resolve.resolve_imports(named.where("language <> 'go'"), paths.select("path", "file_id"))
    root = tree.where("path = 'go.mod'").select(manifests.go_module(F.decode("content", "UTF-8")).alias("module")).first()
    go = resolve.resolve_go_imports(named.where("language = 'go'").withColumnRenamed("module", "import_path"), paths.select("path", "file_id"), root["module"] if root else None)
    # a Go import names a folder; its first file stands for it
    first = paths.where("language = 'go'").groupBy(text.parent_dir(F.col("path")).alias("target_dir")).agg(F.min_by("file_id", "path").alias("target_file_id"))
    go = go.join(first, "target_dir", "left").select("file_id", "alias", F.col("import_path").alias("module"), "target_file_id")
    return found.unionByName(go).join(paths.select("file_id", "language"), "file_id")


def _package(imports: DataFrame) -> DataFrame:
    """file_id, registry, package: what imports that no file answers come from."""
    name = F.col("module")
    ways = {
        "python": ("pypi", manifests.normalised_python(F.substring_index(name, ".", 1))), "typescript": ("npm", manifests.npm_package(name)), "javascript": ("npm", manifests.npm_package(name)),
        "go": ("go", name), "rust": ("crates", F.substring_index(name, "::", 1)), "ruby": ("rubygems", F.substring_index(name, "/", 1)),
    }
    pick = lambda i: F.coalesce(*[F.when(F.col("language") == lang, F.lit(w[i]) if i == 0 else w[i]) for lang, w in ways.items()])
    outside = imports.where("target_file_id IS NULL AND NOT startswith(module, '.') AND NOT (language = 'rust' AND module RLIKE '^(crate|self|super)(::|$)')")
    return outside.select("file_id", pick(0).alias("registry"), pick(1).alias("package")).where("package <> ''").distinct()


def index_files(tree: DataFrame, repo: str) -> tuple[DataFrame, DataFrame]:
    """nodes and edges of a repository's files (path, content, bytes)."""
    return index_with_errors(tree, repo)[:2]


def index_with_errors(tree: DataFrame, repo: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes and edges, and the files whose symbols could not be read (file_id, error, message, line), which are nodes all the same."""
    sources = written(files.sources(tree, repo), "sources")
    file_nodes, file_edges = files.tree(sources, repo)
    facts = written(code.python_facts(sources), "facts")
    other = sources.where("language IS NOT NULL AND language <> 'python'").select("file_id", "language", "content")
    tokens = written(syntax.in_blocks(lexer.tokens(other)), "tokens")
    parsed = written(syntax.symbols(other, tokens), "parsed")
    symbols = written(symbol_table(sources, facts, parsed), "symbols")

    about = F.to_json(F.struct("language", "start_line", "end_line", "signature", "docs", F.col("bases").alias("superclasses"), "summary"))
    members = symbols.groupBy(F.col("parent_id").alias("node_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "name"))), lambda x: x["name"]).alias("members"))
    none = F.lit(None).cast("string")
    told = F.coalesce(text.first_sentence(F.col("docs")), F.when(F.col("kind") == "class", text.summarise_class(F.col("name"), F.coalesce("members", F.array().cast("array<string>")), none)).otherwise(text.summarise_function(F.col("name"), F.col("receiver_type"), none)))
    symbol_nodes = symbols.join(members, "node_id", "left").withColumn("summary", told).select(F.col("node_id").alias("id"), F.when(F.col("kind") == "class", "Class").otherwise("Function").alias("type"), F.concat("name", F.when(F.col("kind") == "class", F.lit("")).otherwise(F.coalesce("signature", F.lit("")))).alias("name"), about.alias("properties"))
    defined = symbols.select(*_edge("DEFINES", F.col("parent_id"), F.col("node_id")))

    imports = written(_imports(facts, sources, tree), "imports")
    internal = imports.where("target_file_id IS NOT NULL").select("file_id", "target_file_id").distinct().select(*_edge("IMPORTS", F.col("file_id"), F.col("target_file_id")))
    external = written(_package(imports), "packages")
    package = manifests.package_id(F.col("registry"), F.col("package"))
    external_edges = external.select(*_edge("IMPORTS", F.col("file_id"), package))
    external_nodes = external.select("registry", "package").distinct().select(package.alias("id"), F.lit("Dependency").alias("type"), F.col("package").alias("name"), F.to_json(F.struct("registry")).alias("properties"))

    variables = facts.where("what = 'variable'").withColumn("var_id", F.concat("scope", F.lit("::"), "name"))
    types = variables.where("kind = 'parameter' AND signature IS NOT NULL").groupBy(F.col("scope").alias("caller_id")).agg(F.map_from_entries(F.collect_set(F.struct("name", "signature"))).alias("param_types"))
    callers = symbols.select(F.col("node_id").alias("caller_id"), F.col("name").alias("caller_name"), "receiver_var", "receiver_type")
    receiver = F.coalesce(F.concat("receiver_type", F.lit(".")), F.lit(""))
    ids = parsed.select("file_id", F.col("seq").alias("caller"), F.concat("scope", F.lit("::"), receiver, F.col("name")).alias("caller_id"))
    heard = syntax.call_refs(other, tokens, parsed).join(ids, ["file_id", "caller"]).select("caller_id", "file_id", F.col("ord").cast("long").alias("ord"), "name", "receiver", "kind")
    called = facts.where("what = 'call'").select(F.col("scope").alias("caller_id"), "file_id", F.col("seq").alias("ord"), "name", "receiver", "kind").unionByName(heard)
    calls = resolve.resolve_calls(called.join(callers, "caller_id").join(types, "caller_id", "left"), symbols, imports)
    call_edges = calls.select(*_edge("CALLS", F.col("source_id"), F.col("target_id"), F.to_json(F.struct("confidence"))))

    once = keep_first(variables.select("var_id", "name", "kind", "scope", "start_line", "seq"), "var_id", "seq")
    variable_nodes = once.select(F.col("var_id").alias("id"), F.lit("Variable").alias("type"), "name", F.to_json(F.struct("kind", "start_line")).alias("properties"))
    variable_edges = once.select(*_edge("DEFINES", F.col("scope"), F.col("var_id")))
    refs = facts.where("what = 'derives'").select(F.concat("scope", F.lit("::"), "signature").alias("variable_id"), F.col("scope").alias("scope_id"), "file_id", F.col("seq").alias("ord"), "name", "receiver", "kind")
    derived = resolve.resolve_derivations(refs, once.select(F.col("scope").alias("scope_id"), "name", "var_id"), symbols, imports)
    derived_edges = derived.select(*_edge("DERIVED_FROM", F.col("source_id"), F.col("target_id"), F.to_json(F.struct("transform"))))

    package_nodes, package_edges = manifests.dependency_graph(manifests.dependencies(tree.select("path", F.decode("content", "UTF-8").alias("content"))), repo)
    nodes = reduce(DataFrame.unionByName, [part.withColumn("seq", F.lit(n)) for n, part in enumerate([file_nodes, symbol_nodes, variable_nodes, package_nodes, external_nodes])])
    edges = reduce(DataFrame.unionByName, [file_edges.withColumn("properties", F.lit("{}")), defined, internal, external_edges, call_edges, variable_edges, derived_edges, package_edges]).dropDuplicates(["id"])
    return written(keep_first(nodes).drop("seq"), "indexed-nodes"), written(edges, "indexed-edges"), code.errors(facts)


def index_metadata(nodes: DataFrame, edges: DataFrame, repo: str, **about: str) -> DataFrame:
    """One row for an index run: what was indexed, when, and counts."""
    by = nodes.agg(*[F.count(F.when(F.col("type") == t, 1)).alias(f"n_{t.lower()}") for t in ("File", "Class", "Function", "Variable", "Dependency")])
    return by.crossJoin(edges.agg(F.count("id").alias("n_edges"))).select(F.lit(f"_meta:index:{repo}").alias("id"), F.lit(repo).alias("repo_id"), F.current_timestamp().alias("indexed_at"), *[F.lit(v).alias(k) for k, v in about.items()], *by.columns, "n_edges")


def repositories(nodes: DataFrame, metadata: DataFrame) -> DataFrame:
    """Repositories with the newest metadata of each, where there is some."""
    latest = keep_latest(metadata, "repo_id", "indexed_at")
    repos = nodes.where("type = 'Repository'").select(F.col("id").alias("repo_id"), "name", F.get_json_object("properties", "$.sourceUri").alias("uri"))
    return repos.join(latest.drop("id"), "repo_id", "left")
