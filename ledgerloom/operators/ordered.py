"""Operators on rows in order: clusters, islands, blocks, runs, roles, neighbours and overlaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clusters(df: DataFrame, keys: list[str], order: list, new: Column, name: str = "cluster") -> DataFrame:
    """Number clusters in each key: a row for which ``new`` holds opens one. ``new`` may use lag over PREV."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.sum(F.when(F.coalesce(new, F.lit(False)), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def previous(column: str, keys: list[str], order: list) -> Column:
    return F.lag(column).over(Window.partitionBy(*keys).orderBy(*order))


def roles(df: DataFrame, keys: list[str], order: list, name: str = "page_role") -> DataFrame:
    """single, first, middle or last, by place in the key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    first, last = F.row_number().over(w) == 1, F.lead(F.lit(1)).over(w).isNull()
    return df.withColumn(name, F.when(first & last, "single").when(first, "first").when(last, "last").otherwise("middle"))


def longest_runs(df: DataFrame, keys: list[str], order: list, value: str) -> DataFrame:
    """The length of the longest run of one value in each key."""
    df = df.withColumn("_old", previous(value, keys, order))
    runs = clusters(df, keys, order, ~F.col(value).eqNullSafe(F.col("_old")), "_run").groupBy(*keys, "_run").agg(F.count("*").alias("_n"))
    return runs.groupBy(*keys).agg(F.max("_n").alias("longest_run"))


def overlaps(left: DataFrame, right: DataFrame, key: str, width: int) -> DataFrame:
    """Pairs of intervals (start, stop: whole numbers, end exclusive) of a key that overlap.

    Intervals are dealt to the bins of ``width`` that they touch and meet by equality of key and bin; a pair
    counts in the bin where it starts. Long intervals take more bins; no pair is formed across bins.
    """
    bins = lambda df, p: df.select(*(F.col(c).alias(f"{p}_{c}") for c in df.columns)).withColumn("_bin", F.explode(F.sequence(F.floor(F.col(f"{p}_start") / width), F.floor((F.col(f"{p}_stop") - 1) / width))))
    a, b = bins(left.filter("start < stop"), "a"), bins(right.filter("start < stop"), "b")
    both = a.join(b.withColumnRenamed("_bin", "_other"), (F.col(f"a_{key}") == F.col(f"b_{key}")) & (F.col("_bin") == F.col("_other")))
    start = F.greatest("a_start", "b_start")
    return both.filter((start < F.least("a_stop", "b_stop")) & (F.floor(start / width) == F.col("_bin"))).drop("_bin", "_other")
