"""Nested documents as rows of path and value, and what their fields say about their quality."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _leaves(value) -> Iterator[tuple[str, str | None]]:
    todo = [("", value)]
    while todo:
        path, value = todo.pop()
        if isinstance(value, dict):
            todo += [(f"{path}.{k}" if path else k, v) for k, v in reversed(value.items())]
        elif isinstance(value, list) and value:
            todo += [(f"{path}[{i}]", v) for i, v in reversed(list(enumerate(value)))]
        else:
            yield path, "[]" if isinstance(value, list) else value if isinstance(value, str) or value is None else json.dumps(value)


def flatten(df: DataFrame, key: str, column: str) -> DataFrame:
    """key, path, value for every leaf of the JSON in ``column``, to any depth, in one pass.

    An empty list is one row ('[]'), an empty object none; numbers and booleans are written as JSON. Null or
    unreadable text has no rows, and neither has text that nests deeper than the JSON reader goes (some thousands).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, text in zip(batch[key], batch[column]):
                try:
                    document = json.loads(text)
                except (TypeError, ValueError, RecursionError):
                    continue
                out += [(k, p, v) for p, v in _leaves(document)]
            yield pd.DataFrame(out, columns=[key, "path", "value"])

    return df.select(key, column).mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, path string, value string")


def general_path(path: Column) -> Column:
    """items[3].unit -> items[*].unit"""
    return F.regexp_replace(path, r"\[[0-9]+\]", "[*]")


def catalog_tag(path: Column) -> Column:
    low = F.lower(path)
    return F.when(low.contains("items"), "items").when(low.contains("total"), "totals").when(low.rlike("sender|receiver|payer|payee|supplier|customer"), "parties").otherwise("header")


def document_counters(fields: DataFrame, key: str, state: str) -> DataFrame:
    """Fields of each document by state, and whether it is ready: none null, marked or invalid."""
    n = lambda s: F.count_if(F.col(state) == s)
    out = fields.groupBy(key).agg(F.count("*").alias("fields"), n("null").alias("nulls"), n("review").alias("reviews"), n("invalid").alias("invalid"))
    return out.withColumn("ready", (F.col("nulls") + F.col("reviews") + F.col("invalid")) == 0)
