"""Pull requests as graph rows, and unified diffs as lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import basename, parent_dir, truncate_patch


def pull_graph(prs: DataFrame, files: DataFrame, nodes: DataFrame, repo: str) -> tuple[DataFrame, DataFrame]:
    """PullRequest nodes, TARGETS_REPO and CHANGES edges, and File and Directory nodes
    (with defined_in edges) for the paths that the graph does not hold yet."""
    pr_id = F.concat(F.lit(f"{repo}/pr/"), F.col("number").cast("string"))
    changed = files.groupBy("number").agg(F.count("path").alias("files_changed"))
    props = F.to_json(F.struct(*[c for c in prs.columns if c not in ("title",)], F.coalesce("files_changed", F.lit(0)).alias("files_changed")))
    pulls = prs.join(changed, "number", "left").select(pr_id.alias("id"), F.lit("PullRequest").alias("type"), F.concat(F.lit("#"), F.col("number").cast("string"), F.lit(" "), F.col("title")).alias("name"), props.alias("properties"))
    full = F.concat(F.lit(f"{repo}/"), F.col("path"))
    detail = F.to_json(F.struct("status", "additions", "deletions", "path", truncate_patch(F.col("patch")).alias("patch"), "previous_path"))
    targets = prs.select(F.concat(pr_id, F.lit(f"->TARGETS_REPO->{repo}")).alias("id"), F.lit("TARGETS_REPO").alias("type"), pr_id.alias("source_id"), F.lit(repo).alias("target_id"), F.lit("{}").alias("properties"))
    changes = files.select(F.concat(pr_id, F.lit("->CHANGES->"), full).alias("id"), F.lit("CHANGES").alias("type"), pr_id.alias("source_id"), full.alias("target_id"), detail.alias("properties"))
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, F.lit(1), n), "/").alias("path"), (n == F.size(parts)).alias("file")))
    paths = files.select(F.explode(prefixes).alias("p")).groupBy("p.path").agg(F.max("p.file").alias("file"))
    fresh = paths.select("path", "file", full.alias("id")).join(nodes.select("id"), "id", "left_anti")
    made = fresh.select("id", F.when(F.col("file"), "File").otherwise("Directory").alias("type"), basename(F.col("path")).alias("name"), F.to_json(F.struct("path")).alias("properties"))
    parent = F.when(parent_dir(F.col("path")) == "", F.lit(repo)).otherwise(F.concat(F.lit(f"{repo}/"), parent_dir(F.col("path"))))
    inside = fresh.select(F.concat("id", F.lit("->defined_in->"), parent).alias("id"), F.lit("defined_in").alias("type"), F.col("id").alias("source_id"), parent.alias("target_id"), F.lit("{}").alias("properties"))
    return pulls.unionByName(made), targets.unionByName(changes).unionByName(inside)


def patch_lines(patches: DataFrame) -> DataFrame:
    """path, line (on the new side), added for the lines of unified diffs (path, patch)."""
    rows = patches.select("path", F.posexplode(F.split("patch", "\n", -1)).alias("at", "text"))
    start = F.nullif(F.regexp_extract("text", r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,\d+)? @@", 1), F.lit("")).cast("int")
    upto = Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_start", start).withColumn("_hunk", F.last(F.when(F.col("_start").isNotNull(), F.col("at")), ignorenulls=True).over(upto)).withColumn("_base", F.last("_start", ignorenulls=True).over(upto))
    right = F.col("_start").isNull() & ~F.col("text").startswith("-") & ~F.col("text").startswith("\\")
    within = Window.partitionBy("path", "_hunk").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.where("_hunk IS NOT NULL").withColumn("_right", right).withColumn("_n", F.sum(F.col("_right").cast("int")).over(within))
    return rows.where("_right AND (text <> '')").select("path", (F.col("_base") + F.col("_n") - 1).alias("line"), F.col("text").startswith("+").alias("added"))


def snap(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """path, target, line: the diff line nearest to each wanted one, the lower of two."""
    near = wanted.join(lines.select("path", "line").distinct(), "path")
    return near.groupBy("path", "target").agg(F.min_by("line", F.struct(F.abs(F.col("line") - F.col("target")), "line")).alias("line"))
