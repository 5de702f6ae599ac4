"""Resolution by joins: imports to files, calls to symbols, data flow to variables.

Each rule is a join that yields candidates with a priority; the first rule that finds a
target wins, the smallest (priority, preference, seq) among its candidates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import parent_dir, resolve_relative
from graphloom.session import written

CONSTRUCTORS = ("__init__", "constructor")
#: What a module path of a language may stand for, in order of preference.
CANDIDATES = {
    "python": ["{}.py", "{}/__init__.py"],
    "typescript": ["{}", "{}.ts", "{}.tsx", "{}.js", "{}.jsx", "{}/index.ts", "{}/index.tsx", "{}/index.js"],
    "rust": ["{}.rs", "{}/mod.rs", "src/{}.rs", "src/{}/mod.rs"],
    "ruby": ["{}.rb", "lib/{}.rb", "{}"],
}


def candidate_paths(language: Column, module: Column) -> Column:
    """Candidate files of a module path, in order."""
    def forms(names: list[str]) -> Column:
        return F.array(*[F.concat(F.lit(n.split("{}")[0]), module, F.lit(n.split("{}")[1])) for n in names])

    out = F.array().cast("array<string>")
    for lang, names in CANDIDATES.items():
        out = F.when(language == lang, forms(names)).otherwise(out)
    return out


def module_path(language: Column, file_path: Column, module: Column) -> Column:
    """The path that a module names: relative ones from the file's folder."""
    dots = F.length(F.regexp_extract(module, r"^(\.*)", 1))
    python_up = F.concat(F.repeat(F.lit("../"), F.greatest(dots - 1, F.lit(0))), F.translate(F.regexp_replace(module, r"^\.+", ""), ".", "/"))
    python = F.when(dots > 0, resolve_relative(parent_dir(file_path), python_up)).otherwise(F.translate(module, ".", "/"))
    script = F.when(module.startswith("."), resolve_relative(parent_dir(file_path), module)).otherwise(module)
    return F.when(language == "python", python).when(language == "rust", F.regexp_replace(F.regexp_replace(module, "^(crate|super|self)::", ""), "::", "/")).otherwise(script)


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """file_id, alias, module, target_file_id (null: external). imports has file_id, path,
    language, alias, module and, for Python's from-imports, member: a member may be a module itself."""
    target = module_path(F.col("language"), F.col("path"), F.col("module"))
    inner = F.when(F.col("member").isNotNull(), F.concat_ws("/", F.nullif(target, F.lit("")), "member"))
    paths = F.concat(F.when(inner.isNotNull(), candidate_paths(F.col("language"), inner)).otherwise(F.array().cast("array<string>")), candidate_paths(F.col("language"), target))
    rows = imports.select("*", F.posexplode_outer(paths).alias("_pos", "_path"))
    hits = rows.join(files.select(F.col("path").alias("_path"), F.col("file_id").alias("_target")), "_path")
    best = hits.groupBy("file_id", "alias", "module").agg(F.min_by("_target", "_pos").alias("target_file_id"))
    return imports.select("file_id", "alias", "module").distinct().join(best, ["file_id", "alias", "module"], "left")


def resolve_go_imports(imports: DataFrame, files: DataFrame, module: str | None) -> DataFrame:
    """file_id, alias, import_path, target_dir: the folder of Go files that an import
    path is, or is below the module, or the only one of its last segment's name."""
    dirs = files.where(F.col("path").endswith(".go")).select(parent_dir(F.col("path")).alias("dir")).distinct()
    base = F.substring_index("dir", "/", -1)
    once = dirs.groupBy(base.alias("key")).agg(F.count("dir").alias("n"), F.min("dir").alias("dir")).where("n = 1").select("key", "dir", F.lit(2).alias("rank"))
    keys = dirs.select(F.col("dir").alias("key"), "dir", F.lit(0).alias("rank")).unionByName(once)
    own = F.when(F.col("import_path").startswith(f"{module}/"), F.col("import_path").substr(len(module) + 2, 10_000)) if module else F.lit(None).cast("string")
    asked = F.array_compact(F.array(F.struct(F.col("import_path").alias("key"), F.lit(0).alias("as")), F.when(own.isNotNull(), F.struct(own.alias("key"), F.lit(1).alias("as"))), F.struct(F.substring_index("import_path", "/", -1).alias("key"), F.lit(2).alias("as"))))
    rows = imports.select("*", F.explode(asked).alias("a")).select("*", F.col("a.key").alias("key"), F.col("a.as").alias("as"))
    hits = rows.join(keys, "key").where(((F.col("as") < 2) & (F.col("rank") == 0)) | ((F.col("as") == 2) & (F.col("rank") == 2)))
    best = hits.groupBy("file_id", "alias", "import_path").agg(F.min_by("dir", "as").alias("target_dir"))
    return imports.select("file_id", "alias", "import_path").distinct().join(best, ["file_id", "alias", "import_path"], "left")


def resolve_calls(calls: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """source_id, target_id, confidence: CALLS edges.

    calls: caller_id, caller_name, file_id, ord, name, receiver, kind (bare, attribute),
    receiver_var, receiver_type, param_types (map). symbols: node_id, name, kind (class,
    function), file_id, parent_id, receiver_type, seq. imports: file_id, alias, target_file_id.

    Symbols are first reduced to the best of each key that a rule asks for, so a call meets one row a rule and
    the work doesn't grow with the number of symbols that share a name."""
    calls = calls.where(~((F.col("kind") == "bare") & (F.col("name") == F.col("caller_name"))))
    s = symbols.select(F.col("node_id").alias("target_id"), F.col("name").alias("s_name"), F.col("kind").alias("s_kind"), F.col("file_id").alias("s_file"), "parent_id", F.col("receiver_type").alias("s_receiver"), F.col("seq").alias("s_seq"))
    classes = symbols.where("kind = 'class'").select(F.col("name").alias("c_name"), F.col("node_id").alias("c_id"), F.col("file_id").alias("c_file"), F.col("seq").alias("s_seq"))
    makers = symbols.where(F.col("name").isin(*CONSTRUCTORS)).groupBy(F.col("parent_id").alias("m_class")).agg(F.min_by("node_id", "seq").alias("maker"))
    key = ["caller_id", "ord"]

    def best_of(rows: DataFrame, keys: list[str], out: str, last: bool = False) -> DataFrame:
        """The first symbol of each key by seq, or the last one; written, so that a small table is known to be one."""
        prefer = (-F.col("s_seq")).cast("int") if last else F.lit(0)
        return written(rows.dropna(subset=keys).groupBy(*keys).agg(F.min(F.struct(prefer.alias("prefer"), "s_seq", "target_id")).alias(out)), "resolve")

    made = lambda rows, owner: rows.join(makers, F.col(owner) == F.col("m_class"), "left").withColumn("target_id", F.coalesce("maker", owner)).drop("maker", "m_class")
    near = lambda rows, keys, out: (best_of(rows, [*keys, "c_file"], out), best_of(rows.withColumn("_nowhere", F.col("c_file").isNull()), [*keys, "_nowhere"], out))
    members = classes.drop("s_seq").join(s, F.col("c_id") == F.col("parent_id")).select("c_name", "c_file", F.col("s_name").alias("name"), "s_seq", "target_id")
    named = s.withColumnRenamed("s_name", "name")
    owned_here, owned = near(members.withColumnRenamed("c_name", "receiver"), ["receiver", "name"], "_s")
    built_here, built = near(made(classes, "c_id").withColumnRenamed("c_name", "name"), ["name"], "_s")
    # symbols by name in each file: a name is alone abroad if it is once in all other files
    places = named.where("s_file IS NOT NULL AND name IS NOT NULL AND target_id IS NOT NULL").groupBy("name", "s_file").agg(F.count("target_id").alias("n"), F.min("target_id").alias("target_id"), F.min("s_seq").alias("s_seq"))
    # of two files at most can one be alone against the other, so two rows of a name are enough: its first and its last file
    spots = places.groupBy("name").agg(F.sum("n").alias("_all"), F.min(F.struct("s_file", "n", "s_seq", "target_id")).alias("_low"), F.max(F.struct("s_file", "n", "s_seq", "target_id")).alias("_high"))
    at_home = places.select("name", F.col("s_file").alias("file_id"), F.col("n").alias("_own"))
    rules: list[Column] = []

    def rule(found: Column, when: Column, priority: float, confidence: Column, prefer: Column | None = None) -> None:
        chosen = F.struct(F.lit(float(priority)).alias("priority"), (prefer if prefer is not None else found["prefer"]).cast("int").alias("prefer"), found["s_seq"].alias("s_seq"), found["target_id"].alias("target_id"), confidence.cast("double").alias("confidence"))
        rules.append(F.when(when & found.isNotNull(), chosen))

    def meet(rows: DataFrame, table: DataFrame, on: list[tuple[str, str]]) -> DataFrame:
        """rows with the columns of a table that are no keys; null where it has none."""
        renamed = table.withColumnsRenamed({theirs: f"_k{i}" for i, (_, theirs) in enumerate(on)})
        return rows.join(renamed, reduce(lambda x, y: x & y, [F.col(ours) == F.col(f"_k{i}") for i, (ours, _) in enumerate(on)]), "left").drop(*[f"_k{i}" for i in range(len(on))])

    bare, selfish = F.col("kind") == "bare", F.coalesce(F.col("receiver").isin("self", "this"), F.lit(False))
    other = (F.col("kind") == "attribute") & ~selfish
    as_ = lambda table, name: table.withColumnRenamed("_s", name)
    by_parent = best_of(named, ["parent_id", "name"], "_s")
    by_receiver = best_of(named, ["s_receiver", "name"], "_s")
    in_file = best_of(named, ["s_file", "name"], "_s", last=True)
    made_in_file = best_of(made(named, "target_id"), ["s_file", "name"], "_s", last=True)
    parents = written(symbols.select("node_id", F.col("parent_id").alias("_class")).where("node_id IS NOT NULL AND _class IS NOT NULL").distinct(), "resolve")
    known = written(classes.where("c_name IS NOT NULL").select("c_name", F.lit(True).alias("_known")).distinct(), "resolve")
    links = imports.where("target_file_id IS NOT NULL AND file_id IS NOT NULL AND alias IS NOT NULL").select(F.col("file_id").alias("i_file"), F.col("alias").alias("i_alias"), F.col("target_file_id").alias("_to")).distinct()
    aliases = written(links.groupBy("i_file", "i_alias").agg(F.collect_set("_to").alias("_to")), "resolve")  # as many as a file imports under one name

    rows = calls.withColumns({
        "_caller": F.when((F.col("kind") == "attribute") & selfish, F.col("caller_id")), "_typed": F.when(other, F.try_element_at("param_types", F.col("receiver"))),
        "_var": F.when(other & (F.col("receiver") == F.col("receiver_var")), F.col("receiver_type")), "_owner": F.when(other, F.col("receiver")), "_bare": F.when(bare, F.col("name")),
    })
    rows = meet(rows, parents.groupBy("node_id").agg(F.collect_set("_class").alias("_classes")), [("_caller", "node_id")])
    rows = meet(rows, known, [("_owner", "c_name")])
    rows = meet(meet(rows, as_(by_receiver, "_r2"), [("_var", "s_receiver"), ("name", "name")]), as_(best_of(members.withColumnRenamed("c_name", "type"), ["type", "name"], "_s"), "_r25"), [("_typed", "type"), ("name", "name")])
    rows = meet(meet(rows, as_(owned_here, "_r3"), [("_owner", "receiver"), ("name", "name"), ("file_id", "c_file")]), as_(owned.where("NOT _nowhere").drop("_nowhere"), "_r3far"), [("_owner", "receiver"), ("name", "name")])
    rows = meet(meet(rows, as_(owned.where("_nowhere").drop("_nowhere"), "_r3none"), [("_owner", "receiver"), ("name", "name")]), as_(by_receiver, "_r31"), [("_owner", "s_receiver"), ("name", "name")])
    rows = meet(meet(rows, as_(built_here, "_r5"), [("_bare", "name"), ("file_id", "c_file")]), as_(built.where("NOT _nowhere").drop("_nowhere"), "_r5far"), [("_bare", "name")])
    rows = meet(meet(rows, as_(built.where("_nowhere").drop("_nowhere"), "_r5none"), [("_bare", "name")]), as_(in_file, "_r6"), [("file_id", "s_file"), ("_bare", "name")])
    rows = meet(meet(rows, written(spots, "resolve"), [("_bare", "name")]), written(at_home, "resolve"), [("file_id", "file_id"), ("_bare", "name")])
    rows = rows.withColumn("_alias", F.when(bare, F.col("name")).when(other & F.col("_known").isNull(), F.col("receiver")))  # a receiver that is a class does not fall through to imports
    rows = meet(rows, aliases, [("file_id", "i_file"), ("_alias", "i_alias")])
    # a call is a row for itself, which counts it once, one for each file that its import may be and one for each parent of its caller
    none = F.array(F.struct(F.lit(None).cast("string").alias("_to"), F.lit(None).cast("string").alias("_class"), F.lit(True).alias("_first")))
    tos = F.transform("_to", lambda x: F.struct(x.cast("string").alias("_to"), F.lit(None).cast("string").alias("_class"), F.lit(False).alias("_first")))
    ups = F.transform("_classes", lambda x: F.struct(F.lit(None).cast("string").alias("_to"), x.cast("string").alias("_class"), F.lit(False).alias("_first")))
    rows = rows.withColumn("_way", F.explode(F.concat(none, F.coalesce(tos, F.slice(none, 1, 0)), F.coalesce(ups, F.slice(none, 1, 0))))).select("*", "_way._first", F.col("_way._to").alias("_file"), F.col("_way._class").alias("_parent")).drop("_way", "_to", "_classes")
    rows = meet(meet(rows, as_(by_parent, "_r1"), [("_parent", "parent_id"), ("name", "name")]), as_(in_file, "_r4"), [("_file", "s_file"), ("name", "name")])
    rows = meet(rows, as_(made_in_file, "_r45"), [("_file", "s_file"), ("name", "name")])

    first, yes, nothing = F.col("_first"), F.lit(True), F.lit(None).cast("int")
    unplaced = F.when(F.col("file_id").isNotNull(), 1)  # whose file is not known comes first, as nulls do
    rule(F.col("_r1"), yes, 1, F.lit(1.0))
    rule(F.col("_r2"), first, 2, F.lit(1.0))
    rule(F.col("_r25"), first, 2.5, F.lit(0.7))
    rule(F.col("_r3"), first, 3, F.lit(1.0), F.lit(0))
    rule(F.col("_r3far"), first, 3, F.lit(0.9), unplaced)
    rule(F.col("_r3none"), first, 3, F.lit(0.9), nothing)
    rule(F.col("_r31"), first & F.col("_known"), 3.1, F.lit(0.9))
    rule(F.col("_r4"), other, 4, F.lit(0.9))
    rule(F.col("_r45"), bare, 4.5, F.lit(0.9))
    rule(F.col("_r5"), first, 5, F.lit(1.0), F.lit(0))
    rule(F.col("_r5far"), first, 5, F.lit(0.8), unplaced)
    rule(F.col("_r5none"), first, 5, F.lit(0.8), nothing)
    rule(F.col("_r6"), first, 6, F.lit(1.0))
    # exactly one other file's symbol has the name
    there = F.when(first & bare & F.col("file_id").isNotNull(), F.col("_all") - F.coalesce("_own", F.lit(0)))
    alone = F.when(F.col("_low.s_file") != F.col("file_id"), F.col("_low")).otherwise(F.col("_high"))
    far = F.when(there == 1, F.struct(F.lit(7.0).alias("priority"), F.lit(0).alias("prefer"), alone["s_seq"].alias("s_seq"), alone["target_id"].alias("target_id"), F.lit(0.8).alias("confidence")))
    sums = rows.select(*key, F.array_min(F.array_compact(F.array(*rules))).alias("near"), there.alias("there"), far.alias("far"))
    best = sums.groupBy(*key).agg(F.min("near").alias("near"), F.sum("there").alias("there"), F.min("far").alias("far"))
    best = best.select(*key, F.coalesce("near", F.when(F.col("there") == 1, F.col("far"))).alias("b"))
    found = best.where(F.col("b.target_id") != F.col("caller_id"))
    return found.groupBy(F.col("caller_id").alias("source_id"), F.col("b.target_id").alias("target_id")).agg(F.min_by("b.confidence", "ord").alias("confidence"))


def scope_chain(scope: Column) -> Column:
    """The scopes of a::b::c, the nearest first."""
    parts = F.split(scope, "::")
    return F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "::"))


def resolve_derivations(refs: DataFrame, variables: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """source_id (variable), target_id, transform: DERIVED_FROM edges.

    refs: variable_id, scope_id, file_id, ord, name, receiver, kind (identifier, call,
    attribute). variables: scope_id, name, var_id."""
    key = ["variable_id", "ord"]
    v = variables.select(F.col("scope_id").alias("_scope"), F.col("name").alias("v_name"), F.col("var_id").alias("target_id"))
    s = symbols.select(F.col("file_id").alias("s_file"), F.col("name").alias("s_name"), F.col("node_id").alias("target_id"), F.col("seq").alias("s_seq"))
    aliases = imports.where("target_file_id IS NOT NULL").select(F.col("file_id").alias("i_file"), F.col("alias").alias("i_alias"), "target_file_id")
    chain = lambda rows, scope: rows.select("*", F.posexplode(scope_chain(scope)).alias("_pos", "_scope")).join(v, "_scope").where((F.col("name") == F.col("v_name")) & (F.col("target_id") != F.col("variable_id")))
    pick = lambda rows, priority, prefer: rows.select(*key, "kind", F.lit(float(priority)).alias("priority"), prefer.cast("int").alias("prefer"), "target_id")
    names, called, attributes = (refs.where(F.col("kind") == k) for k in ("identifier", "call", "attribute"))
    via = lambda rows, alias: rows.join(aliases, (F.col("file_id") == F.col("i_file")) & (F.col(alias) == F.col("i_alias"))).join(s, (F.col("target_file_id") == F.col("s_file")) & (F.col("name") == F.col("s_name")))
    own = F.col("receiver").isin("self", "this")
    unique = symbols.groupBy(F.col("name").alias("s_name")).agg(F.count("node_id").alias("_n"), F.min("node_id").alias("target_id")).where("_n = 1")
    outer = F.regexp_replace("scope_id", "::[^:]*$", "")
    rules = [
        pick(chain(names, F.col("scope_id")), 1, F.col("_pos")),
        pick(via(names, "name"), 2, -F.col("s_seq")),
        pick(called.join(s, (F.col("file_id") == F.col("s_file")) & (F.col("name") == F.col("s_name"))), 1, -F.col("s_seq")),
        pick(via(called, "name"), 2, -F.col("s_seq")),
        pick(via(called.where("receiver IS NOT NULL"), "receiver"), 2, -F.col("s_seq")),
        pick(called.join(unique, F.col("name") == F.col("s_name")), 3, F.lit(0)),
        pick(chain(attributes.where(own), outer), 1, F.col("_pos")),
        pick(via(attributes.where(~own), "receiver"), 2, -F.col("s_seq")),
    ]
    best = reduce(DataFrame.unionByName, rules).groupBy(*key).agg(F.min(F.struct("priority", "prefer", "target_id", "kind")).alias("b"))
    return best.groupBy(F.col("variable_id").alias("source_id"), F.col("b.target_id").alias("target_id")).agg(F.min_by("b.kind", "ord").alias("transform"))
