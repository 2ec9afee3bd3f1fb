"""Quality of runs: states of fields, rollups, queues and what needs review most."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def quality_rollup(df: DataFrame, group: str, review: Column) -> DataFrame:
    """Rows and rows without review for each group and for all, from one pass."""
    return df.withColumn("_r", review).rollup(group).agg(F.grouping(group).alias("is_total"), F.count("*").alias("rows"), F.sum(F.when(F.col("_r"), 0).otherwise(1)).alias("clean_rows"))


def hotspots(df: DataFrame, by: list[str], review: Column, top: int) -> DataFrame:
    """The ``top`` groups with most rows to review: a report, so the limit is the feature."""
    return df.filter(review).groupBy(*by).agg(F.count("*").alias("review_rows")).orderBy(F.desc("review_rows"), *by).limit(top)


def overlay(base: DataFrame, edits: DataFrame, key: str, field: str) -> DataFrame:
    """Stored values with the reviewers' edits on top; an edit to null counts, an edit of no row doesn't."""
    e = edits.select(F.col(key), F.col(field).alias("_edit"), F.lit(True).alias("_edited"))
    out = base.join(e, key, "left")
    return out.withColumn(field, F.when(F.col("_edited"), F.col("_edit")).otherwise(F.col(field))).withColumn("edited", F.coalesce("_edited", F.lit(False))).drop("_edit", "_edited")


def latest(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row of each key: the first in the order given."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
