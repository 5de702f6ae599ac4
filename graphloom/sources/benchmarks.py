"""Files of benchmark tasks as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SUITE = "suite_name string, description string, fixture string, repo_id string, tasks array<struct<id: string, category: string, description: string, tool: string, tool_args: map<string, string>, assertions: array<struct<type: string, value: string, key: string>>>>"


def load_instances(spark: SparkSession, path: str) -> DataFrame:
    """One row an instance: Parquet, a JSON list, or a JSON object whose ``instances`` are the list."""
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    rows = spark.read.json(path, multiLine=True)
    field = next((f for f in rows.schema if f.name == "instances"), None)
    return rows.select(F.inline("instances")) if field is not None and isinstance(field.dataType, T.ArrayType) else rows


def load_suite(spark: SparkSession, path: str) -> DataFrame:
    """suite_name, repo_id, id, category, description, tool, tool_args, assertions: one row a task, in the file's order."""
    rows = spark.read.schema(SUITE).json(path, multiLine=True)
    return rows.select("suite_name", "repo_id", F.posexplode("tasks").alias("ord", "task")).select("suite_name", "repo_id", "ord", "task.*")
