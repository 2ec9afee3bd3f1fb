"""Final documents as they are handed out: without private fields, wrapped by type and file, as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: types whose documents stand under their type and file, and types whose documents stand alone
WRAPPED, FLAT = ("invoice", "payment_order", "Account-protocol"), ("waybill",)


def public(kind: T.DataType, value: Column) -> Column:
    """``value`` without fields, at any depth, whose names begin with an underscore. A struct of none else becomes empty (null)."""
    if isinstance(kind, T.StructType):
        kept = [(f, public(f.dataType, value[f.name])) for f in kind.fields if not f.name.startswith("_")]
        return F.when(value.isNotNull(), F.struct(*(v.alias(f.name) for f, v in kept))) if kept else F.lit(None).cast("string")
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: public(kind.elementType, x))
    if isinstance(kind, T.MapType):
        return F.transform_values(F.map_filter(value, lambda k, _: ~k.startswith("_")), lambda _, x: public(kind.valueType, x))
    return value


def final_json(documents: DataFrame, column: str, doc_type: str, file_key: str) -> DataFrame:
    """The documents with ``final`` (JSON) and ``shape_error``.

    The document in ``column`` (a struct) is written without private fields, missing values as null. Documents of wrapped
    types stand under type and file, and need one; those of flat types stand alone; others, and missing ones, have an error.
    """
    kind, name = F.col(doc_type), F.col(file_key)
    body = F.to_json(public(documents.schema[column].dataType, F.col(column)), {"ignoreNullFields": "false"})
    quoted = lambda x: F.regexp_extract(F.to_json(F.struct(x.alias("k"))), r"(?s)^\{\"k\":(.*)\}$", 1)
    wrapped = F.concat(F.lit("{"), quoted(kind), F.lit(":{"), quoted(name), F.lit(":"), body, F.lit("}}"))
    blank = F.coalesce(F.trim(name) == "", F.lit(True))
    error = F.when(kind.isNull() | ~kind.isin(*WRAPPED, *FLAT), F.concat(F.lit("unknown type "), F.coalesce(kind, F.lit("(none)")))).when(F.col(column).isNull(), "no document").when(kind.isin(*WRAPPED) & blank, "no file named")
    return documents.withColumn("shape_error", error).withColumn("final", F.when(F.col("shape_error").isNull(), F.when(kind.isin(*WRAPPED), wrapped).otherwise(body)))
