"""Imports of TypeScript, Go, Rust and Ruby, as Spark expressions over whole files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _family() -> Column:
    return F.when(F.col("language") == "javascript", "typescript").otherwise(F.col("language"))


def _swap(text: Column, *pairs: tuple[str, str]) -> Column:
    for pattern, by in pairs:
        text = F.regexp_replace(text, pattern, by)
    return text


def imports(sources: DataFrame) -> DataFrame:
    """file_id, language, alias, module, member: imports of TypeScript, Go, Rust and Ruby, one row for a name."""
    rows = sources.select("file_id", _family().alias("language"), "content")
    every = lambda lang, pattern, text="content": rows.where(F.col("language") == lang).select("file_id", "language", F.explode(F.regexp_extract_all(text, F.lit(pattern), 0)).alias("text"))
    part = lambda pattern, n=1, of="text": F.nullif(F.regexp_extract(of, pattern, n), F.lit(""))
    none = F.lit(None).cast("string")

    script = every("typescript", r"""(?m)^\s*(?:import|export)\s+[\w*\s{},$]+?\s+from\s+['"][^'"]+['"]|^\s*import\s+['"][^'"]+['"]|(?:const|let|var)\s+[\w{},:\s]+?=\s*require\(\s*['"][^'"]+['"]""")
    names = _swap(F.regexp_extract("text", r"""(?s)^\s*(?:import|export|const|let|var)\s+(?:type\s+)?(.*?)\s*(?:from\s*['"]|=\s*require)""", 1), (r"[{}\n]", " "), (r"[\w*$]+\s+as\s+", ""), (r"\w+\s*:\s*", ""), (r"\btype\s+", ""))
    some = F.filter(F.transform(F.split(names, ","), lambda x: F.trim(x)), lambda x: x != "")
    script = script.select("file_id", "language", F.explode(F.when(F.size(some) > 0, some).otherwise(F.array(F.lit("")))).alias("alias"), part(r"""['"]([^'"]+)['"]\s*$""").alias("module"), none.alias("member"))
    script = script.distinct()

    go = every("go", r'(?ms)^import\s*\(.*?^\)|^import\s+(?:[\w.]+\s+)?"[^"]+"').select("file_id", "language", F.explode(F.regexp_extract_all("text", F.lit(r'(?:[\w.]+\s+)?"[^"]+"'), 0)).alias("text"))
    path = part(r'"([^"]+)"')
    alias = part(r'^(?!import\b)([\w.]+)\s+"')
    go = go.select("file_id", "language", F.coalesce(alias, F.substring_index(path, "/", -1)).alias("alias"), path.alias("module"), none.alias("member"))

    rust = every("rust", r"(?m)^\s*(?:pub\s+)?use\s+[\w:]+(?:\s+as\s+\w+)?").withColumn("_path", F.regexp_extract("text", r"use\s+([\w:]+)", 1))
    last = F.substring_index("_path", "::", -1)
    rust = rust.select("file_id", "language", F.coalesce(part(r"\sas\s+(\w+)"), last).alias("alias"), F.regexp_replace("_path", r"::\w+$", "").alias("module"), F.when(F.col("_path").contains("::"), last).alias("member"))

    ruby = every("ruby", r"""(?m)^\s*require(?:_relative)?\s*\(?\s*['"][^'"]+['"]""").withColumn("_path", F.regexp_extract("text", r"""['"]([^'"]+)['"]""", 1))
    beside = F.col("text").contains("require_relative") & ~F.col("_path").startswith(".")
    ruby = ruby.select("file_id", "language", F.substring_index("_path", "/", -1).alias("alias"), F.when(beside, F.concat(F.lit("./"), "_path")).otherwise(F.col("_path")).alias("module"), none.alias("member"))
    return script.unionByName(go).unionByName(rust).unionByName(ruby)
