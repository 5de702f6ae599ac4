"""Package manifests: one row for each dependency that a manifest names.

package.json is read with Spark's JSON functions, line formats with exploded lines and
regular expressions, so manifests of any number are parsed without Python."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import basename

_OUT = ("path", "registry", "name", "version", "kind")


def normalised_python(name: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(name)), "[_.]+", "-")


def package_id(registry: Column, name: Column) -> Column:
    return F.concat(F.lit("pkg:"), registry, F.lit(":"), name)


def package_url(registry: Column, name: Column) -> Column:
    base = F.when(registry == "npm", "https://www.npmjs.com/package/").when(registry == "pypi", "https://pypi.org/project/").when(registry == "crates", "https://crates.io/crates/").when(registry == "go", "https://pkg.go.dev/")
    return F.concat(base, name)


def npm_package(specifier: Column) -> Column:
    """The package of an import: two segments with a scope, else one."""
    return F.when(specifier.startswith("@"), F.substring_index(specifier, "/", 2)).otherwise(F.substring_index(specifier, "/", 1))


def package_json(files: DataFrame) -> DataFrame:
    sections = {"dependencies": "runtime", "devDependencies": "dev", "peerDependencies": "peer", "optionalDependencies": "optional"}
    schema = "struct<" + ",".join(f"{k}:map<string,string>" for k in sections) + ">"
    own = files.where(basename(F.col("path")) == "package.json").withColumn("_j", F.from_json("content", schema))
    parts = [own.select("path", F.lit("npm").alias("registry"), F.explode(f"_j.{k}").alias("name", "version"), F.lit(kind).alias("kind")) for k, kind in sections.items()]
    return reduce(DataFrame.unionByName, parts)


def _lines(files: DataFrame, named: Column) -> DataFrame:
    return files.where(named).select("path", F.posexplode(F.split("content", r"\r?\n")).alias("at", "line")).withColumn("line", F.btrim("line", F.lit(" \t\r")))


def _sections(lines: DataFrame, header: str) -> DataFrame:
    """lines with the last header before each, by a window over one manifest."""
    upto = Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = F.nullif(F.regexp_extract("line", header, 1), F.lit(""))
    return lines.withColumn("section", F.last(found, ignorenulls=True).over(upto)).withColumn("_header", found.isNotNull())


def requirements(files: DataFrame) -> DataFrame:
    """Requirement lines; comments and options are passed over, operators stay in the version."""
    lines = _lines(files, basename(F.col("path")).rlike(r"^requirements.*\.txt$")).where("line <> '' AND NOT startswith(line, '#') AND NOT startswith(line, '-')")
    clean = F.trim(F.regexp_replace(F.regexp_replace("line", r"\s+#.*$", ""), ";.*$", ""))
    pattern = r"^([A-Za-z0-9][A-Za-z0-9._-]*)\s*(?:\[[^\]]*\])?\s*(.*)$"
    name, version = F.regexp_extract(clean, pattern, 1), F.regexp_extract(clean, pattern, 2)
    return lines.where(name != "").select("path", F.lit("pypi").alias("registry"), normalised_python(name).alias("name"), F.coalesce(F.nullif(F.trim(version), F.lit("")), F.lit("*")).alias("version"), F.lit("runtime").alias("kind"))


def go_mod(files: DataFrame) -> DataFrame:
    """Single requires and blocks; names with slashes in blocks count too."""
    lines = _lines(files, basename(F.col("path")) == "go.mod")
    upto = Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mark = F.when(F.col("line").rlike(r"^require\s*\("), True).when(F.col("line").rlike(r"^(\)|replace|exclude|retract|[a-z]+\s*\()"), False)
    lines = lines.withColumn("inside", F.coalesce(F.last(mark, ignorenulls=True).over(upto), F.lit(False)))
    pattern = r"^(?:require\s+)?([^\s()/]+(?:/[^\s()]+)*)\s+(v[^\s]+)"
    use = (F.col("inside") | F.col("line").rlike(r"^require\s+[^(]")) & (F.regexp_extract("line", pattern, 1) != "")
    kind = F.when(F.col("line").rlike(r"//\s*indirect"), "indirect").otherwise("runtime")
    return lines.where(use).select("path", F.lit("go").alias("registry"), F.regexp_extract("line", pattern, 1).alias("name"), F.regexp_extract("line", pattern, 2).alias("version"), kind.alias("kind"))


def go_module(content: Column) -> Column:
    return F.nullif(F.regexp_extract(content, r"(?m)^module\s+(\S+)", 1), F.lit(""))


def cargo(files: DataFrame) -> DataFrame:
    """Three sections; inline tables give their version, or *."""
    lines = _sections(_lines(files, basename(F.col("path")) == "Cargo.toml"), r"^\[([^\]]+)\]")
    kind = F.when(F.col("section") == "dependencies", "runtime").when(F.col("section") == "dev-dependencies", "dev").when(F.col("section") == "build-dependencies", "build")
    name = F.regexp_extract("line", r"^([A-Za-z0-9_-]+)\s*=", 1)
    version = F.coalesce(F.nullif(F.regexp_extract("line", r'^[^=]+=\s*"([^"]*)"', 1), F.lit("")), F.nullif(F.regexp_extract("line", r'version\s*=\s*"([^"]*)"', 1), F.lit("")), F.lit("*"))
    return lines.withColumn("kind", kind).where(F.col("kind").isNotNull() & ~F.col("_header") & (name != "")).select("path", F.lit("crates").alias("registry"), name.alias("name"), version.alias("version"), "kind")


def pyproject(files: DataFrame) -> DataFrame:
    """Arrays of [project] and its optional groups, and the tables of poetry."""
    lines = _sections(_lines(files, basename(F.col("path")) == "pyproject.toml"), r"^\[([^\[\]]+)\]$")
    upto = Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opened = F.when(F.col("line").rlike(r"^[A-Za-z0-9_-]+\s*=\s*\["), F.regexp_extract("line", r"^([A-Za-z0-9_-]+)\s*=", 1)).when(F.col("line").rlike(r"^[A-Za-z0-9_-]+\s*=|^\["), F.lit(""))
    lines = lines.withColumn("array", F.last(opened, ignorenulls=True).over(upto))
    main = (F.col("section") == "project") & (F.col("array") == "dependencies")
    extra = (F.col("section") == "project.optional-dependencies") & (F.col("array") != "")
    body = F.regexp_replace("line", r"^[A-Za-z0-9_-]+\s*=\s*", "")
    strings = F.regexp_extract_all(body, F.lit(r"""["']([^"']+)["']"""), F.lit(1))
    arrays = lines.where(main | extra).select("path", F.explode(strings).alias("spec"), F.when(main, "runtime").otherwise("optional").alias("kind"))
    pattern = r"^([A-Za-z0-9][A-Za-z0-9._-]*)\s*(?:\[[^\]]*\])?\s*([^;]*)"
    listed = arrays.select("path", F.lit("pypi").alias("registry"), normalised_python(F.regexp_extract("spec", pattern, 1)).alias("name"), F.coalesce(F.nullif(F.trim(F.regexp_extract("spec", pattern, 2)), F.lit("")), F.lit("*")).alias("version"), "kind").where("name <> ''")
    name = F.regexp_extract("line", r"^([A-Za-z0-9_.-]+)\s*=", 1)
    version = F.coalesce(F.nullif(F.regexp_extract("line", r'^[^=]+=\s*"([^"]*)"', 1), F.lit("")), F.nullif(F.regexp_extract("line", r'version\s*=\s*"([^"]*)"', 1), F.lit("")), F.lit("*"))
    poetry = F.when(F.col("section") == "tool.poetry.dependencies", "runtime").when(F.col("section").rlike(r"^tool\.poetry\.(dev-dependencies|group\..+\.dependencies)$"), "dev")
    tables = lines.withColumn("kind", poetry).where(F.col("kind").isNotNull() & ~F.col("_header") & (name != "") & (name != "python")).select("path", F.lit("pypi").alias("registry"), normalised_python(name).alias("name"), version.alias("version"), "kind")
    return listed.unionByName(tables)


def dependencies(files: DataFrame) -> DataFrame:
    """path, registry, name, version, kind over all manifests among files (path, content)."""
    return reduce(DataFrame.unionByName, [f(files).select(*_OUT) for f in (package_json, requirements, go_mod, cargo, pyproject)])


def dependency_graph(found: DataFrame, repo: str) -> tuple[DataFrame, DataFrame]:
    """Dependency nodes, each package once, and the repository's DEPENDS_ON edges."""
    key = package_id(F.col("registry"), F.col("name"))
    nodes = found.groupBy(key.alias("id")).agg(F.min(F.struct("registry", "name")).alias("x")).select("id", F.lit("Dependency").alias("type"), F.col("x.name").alias("name"), F.to_json(F.struct(F.col("x.registry").alias("registry"))).alias("properties"))
    first = found.groupBy(key.alias("target_id")).agg(F.min(F.struct("path", "version", F.col("kind").alias("dependency_type"))).alias("x"))
    edges = first.select(F.concat(F.lit(f"{repo}->DEPENDS_ON->"), F.col("target_id")).alias("id"), F.lit("DEPENDS_ON").alias("type"), F.lit(repo).alias("source_id"), "target_id", F.to_json(F.struct("x.version", "x.dependency_type", F.col("x.path").alias("source"))).alias("properties"))
    return nodes, edges
