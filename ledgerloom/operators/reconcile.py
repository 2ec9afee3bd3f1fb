"""Linked amounts of item rows: filling, checking and marking them, and document totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.numbers import close, safe_ratio

LINKED = ("quantity", "price", "cost", "vat_rate", "vat_amount", "total")


def recover_amounts(items: DataFrame) -> DataFrame:
    """Fill one missing amount of a row from those it is linked with; later fills see earlier ones."""
    c = F.col
    out = items
    for name, value in (
        ("cost", lambda: c("quantity") * c("price")),
        ("cost", lambda: c("total") - c("vat_amount")),
        ("price", lambda: safe_ratio(c("cost"), c("quantity"))),
        ("quantity", lambda: safe_ratio(c("cost"), c("price"))),
        ("vat_amount", lambda: c("cost") * c("vat_rate") / 100),
        ("total", lambda: c("cost") + c("vat_amount")),
    ):
        out = out.withColumn(name, F.coalesce(c(name), value()))
    return out


def coherent(row: Column | None = None) -> Column:
    """Whether all amounts are there and the three identities of a row hold."""
    c = F.col
    whole = F.lit(True)
    for name in LINKED:
        whole = whole & c(name).isNotNull()
    return F.coalesce(whole & close(c("quantity") * c("price"), c("cost")) & close(c("cost") * c("vat_rate") / 100, c("vat_amount"), 0.03, 0.02) & close(c("cost") + c("vat_amount"), c("total")), F.lit(False))


def mark_linked(items: DataFrame) -> DataFrame:
    """One doubtful amount makes all amounts of its row doubtful: ``review``."""
    return items.withColumn("review", ~coherent())


def totals(items: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """Sums a document; null where a single row lacks the value (all or nothing)."""
    return items.groupBy(key).agg(*(F.when(F.count(f) == F.count("*"), F.round(F.sum(f), 2)).alias(f"{f}_total") for f in fields))


def third_from_two(df: DataFrame, net: str, vat: str, gross: str) -> DataFrame:
    """net + vat = gross: the one that is missing follows from the others."""
    a, b, c = F.col(net), F.col(vat), F.col(gross)
    return df.select("*", F.coalesce(a, c - b).alias(f"{net}_full"), F.coalesce(b, c - a).alias(f"{vat}_full"), F.coalesce(c, a + b).alias(f"{gross}_full"))


def most_frequent(df: DataFrame, key: str, value: str) -> DataFrame:
    """The most frequent value of each key, the smallest of equally frequent ones."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(key, value).count()
    return counts.groupBy(key).agg(F.max_by(value, F.struct(F.col("count"), -F.col(value))).alias(value), F.max("count").alias("votes"))


def first_agreeing(values: list[Column]) -> Column:
    """The first of the values that agrees with another one."""
    out = F.lit(None).cast("double")
    for i in reversed(range(len(values))):
        agrees = F.lit(False)
        for j, other in enumerate(values):
            if i != j:
                agrees = agrees | F.coalesce(close(values[i], other), F.lit(False))
        out = F.when(agrees, values[i]).otherwise(out)
    return out
