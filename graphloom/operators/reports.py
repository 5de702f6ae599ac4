"""Reports over the results of benchmark runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pass_rates(results: DataFrame, group: str, passed: Column, failed: Column | None = None) -> DataFrame:
    """group, total, passed, failed, errors, pass_rate of each group and of all (group null). A result
    neither passed nor failed is an error; without ``failed`` every other one failed."""
    ok = F.coalesce(passed, F.lit(False))
    bad = F.coalesce(failed, F.lit(False)) & ~ok if failed is not None else ~ok
    rows = results.select(F.col(group), ok.cast("int").alias("_ok"), bad.cast("int").alias("_bad"))
    out = rows.rollup(group).agg(F.count(F.lit(1)).alias("total"), F.sum("_ok").alias("passed"), F.sum("_bad").alias("failed"))
    return out.select("*", (F.col("total") - F.col("passed") - F.col("failed")).alias("errors"), (F.col("passed") / F.col("total")).alias("pass_rate"))


def compared(results: DataFrame, key: str, side: Column, sides: Sequence[str], value: str) -> DataFrame:
    """key, and for each of the sides the mean of ``value``, and their difference where there are two."""
    wide = results.select(F.col(key), side.alias("_side"), F.col(value).alias("_value")).groupBy(key).pivot("_side", list(sides)).agg(F.avg("_value"))
    return wide.withColumn("difference", F.col(sides[0]) - F.col(sides[1])) if len(sides) == 2 else wide
