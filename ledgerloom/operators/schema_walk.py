"""Nested documents by their schema: every leaf rewritten by its path, pages merged into one, marks of doubt listed.

A walk over the schema builds one projection of struct and transform expressions, whatever the depth; no row leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions import normalise, scalars
from ledgerloom.operators.documents import IDENTITY

Path = tuple[str, ...]
Rule = Callable[[Path, T.DataType, Column], Column]
# fixed values: names of fields by what they hold
FIELDS: dict[str, tuple[str, ...]] = {
    "flag": ("urgent", "non_urgent", "is_valid"), "date": ("document_date", "invoice_date", "date", "contract_date", "receipt_date", "execution_date", "valid_until"), "percent": ("vat_rate",),
    "whole": ("line_number", "quantity", "total_quantity", "quantity_total"),
    "number": (
        "amount", "price", "cost", "cost_with_vat", "cost_total", "vat_total", "cost_with_vat_total", "free_unit_price_excl_vat", "extra_charge", "unit_price_excl_vat", "total_excl_vat", "total_incl_vat", "subtotal_excl_vat",
        "subtotal_no_disc_incl_vat", "total_disc_amount", "subtotal_with_disc_excl_vat", "vat_amount", "total_with_disc_incl_vat", "amount_no_disc_incl_vat", "disc_amount", "amount_with_disc_excl_vat", "unit_price_incl_vat",
    ),
    "account": ("bank_account", "account"), "code": ("tax_id", "kpp", "bic", "bank_code", "barcode", "sku"), "phone": ("phone",), "email": ("email",), "unit": ("unit",),
    "money_words": ("amount_in_words", "total_in_words", "vat_total_words", "cost_with_vat_total_words"), "address": ("address", "bank_address"), "bank_name": ("bank_name", "executing_bank"),
}
PARTIES = ("supplier", "customer", "payer", "payee", "sender", "receiver", "signatory")
ITEMS = "items"


def kind_of(path: Path) -> str:
    """What a field holds, by its name and what it lies in; "free" where nothing tells."""
    leaf = next((p for p in reversed(path) if p != "[]"), "")
    for kind, names in FIELDS.items():
        if leaf in names:
            return kind
    if leaf in ("name", "description") and ITEMS in path:
        return "product"
    return "party_name" if leaf == "name" and any(p in PARTIES for p in path) else "free"


def rewrite(kind: T.DataType, value: Column, rule: Rule, path: Path = (), keep: Callable[[Path, T.DataType, Column], Column | None] = lambda *_: None) -> Column:
    """``value`` with every leaf replaced by ``rule(path, type, leaf)``; an array's elements add "[]" to the path.

    ``keep(path, element type, element)`` may give a condition by which elements of an array stay; it sees the array's
    path. A null struct, array or map stays null. Keys of maps stay as they are and add "{}".
    """
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*(rewrite(f.dataType, value[f.name], rule, (*path, f.name), keep).alias(f.name) for f in kind.fields)))
    if isinstance(kind, T.ArrayType):
        stays = lambda x: keep(path, kind.elementType, x)
        held = value if keep(path, kind.elementType, F.lit(None).cast(kind.elementType)) is None else F.filter(value, stays)
        return F.transform(held, lambda x: rewrite(kind.elementType, x, rule, (*path, "[]"), keep))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, x: rewrite(kind.valueType, x, rule, (*path, "{}"), keep))
    return rule(path, kind, value)


def normal_leaf(path: Path, kind: T.DataType, value: Column) -> Column:
    """A leaf in the form of its kind; text only, numbers and flags are what they are. A mark of doubt becomes null."""
    if not isinstance(kind, T.StringType):
        return value
    what = kind_of(path)
    shown = scalars.flag(value) if what == "flag" else scalars.date_text(normalise.said(value)) if what == "date" else getattr(normalise, what)(value)
    return F.when(~normalise.in_doubt(value), shown)


def _no_total(path: Path, kind: T.DataType, item: Column) -> Column | None:
    if not (path and path[-1] == ITEMS and isinstance(kind, T.StructType)):
        return None
    fields = {f.name for f in kind.fields if isinstance(f.dataType, T.StringType)}
    named = [item[n] for n in ("name", "description") if n in fields]
    if not named:
        return None
    label = F.coalesce(*(F.nullif(n, F.lit("")) for n in named))
    return ~F.coalesce(F.lower(normalise.plain(label)).isin(*normalise.TOTAL_NAMES), F.lit(False))


def doubts(kind: T.DataType, value: Column, path: str = "") -> Column:
    """array<string>: paths of the leaves that bear the mark of doubt, with their places: items[0].price."""
    none = F.array().cast("array<string>")
    at = lambda name: F.lit(f"{path}.{name}" if path else name)

    def below(kind: T.DataType, value: Column, at: Column) -> Column | None:
        if isinstance(kind, T.StringType):
            return F.when(normalise.in_doubt(value), F.array(at)).otherwise(none)
        if isinstance(kind, T.StructType):
            parts = [p for f in kind.fields if (p := below(f.dataType, value[f.name], F.concat(at, F.lit(f".{f.name}")))) is not None]
            return F.concat(*parts) if parts else None
        if isinstance(kind, T.ArrayType):
            if below(kind.elementType, F.lit(None).cast(kind.elementType), at) is None:
                return None
            return F.coalesce(F.flatten(F.transform(value, lambda x, i: below(kind.elementType, x, F.concat(at, F.lit("["), i.cast("string"), F.lit("]"))))), none)
        return None

    if isinstance(kind, T.StructType):
        parts = [p for f in kind.fields if (p := below(f.dataType, value[f.name], at(f.name))) is not None]
        return F.concat(*parts) if parts else none
    return F.coalesce(below(kind, value, F.lit(path)), none)


def normalise_documents(df: DataFrame, column: str) -> DataFrame:
    """The rows with the document in ``column`` (a struct) brought into one form by the names of its fields, and ``doubts``.

    Rows of totals go from every list of items. Text of numbers, rates, dates and flags becomes number, text or flag;
    what can't be read becomes null, and so does the mark of doubt, which ``doubts`` lists by path before rows go.
    """
    kind = df.schema[column].dataType
    return df.withColumns({"doubts": doubts(kind, F.col(column)), column: rewrite(kind, F.col(column), normal_leaf, keep=_no_total)})


def unwrap(df: DataFrame, column: str) -> DataFrame:
    """Documents that are a struct of a single field which is a struct itself, as that."""
    kind = df.schema[column].dataType
    while isinstance(kind, T.StructType) and len(kind.fields) == 1 and isinstance(kind.fields[0].dataType, T.StructType):
        df, kind = df.withColumn(column, F.col(f"{column}.{kind.fields[0].name}")), kind.fields[0].dataType
    return df


def _first_known(kind: T.DataType, value: Column, order: Column) -> Column:
    """Over the rows of a group: structs field by field, else the first value in order that isn't missing."""
    if isinstance(kind, T.StructType):
        parts = F.struct(*(_first_known(f.dataType, value[f.name], order).alias(f.name) for f in kind.fields))
        return F.when(F.count(F.when(~scalars.missing(value, kind), 1)) > 0, parts)
    return F.min_by(value, F.when(~scalars.missing(value, kind), order))


def merge_pages(pages: DataFrame, key: str, order: str, column: str, tail: tuple[str, ...] = ()) -> DataFrame:
    """key, column: the documents that the pages of a key hold in ``column`` (a struct) as one.

    Structs merge field by field, at any depth, by the first page in order that says something; lists come from the
    first page whose list says something, but the items of all pages are kept, each once (the same in all of IDENTITY,
    without case and outer blanks; the first one stays), in order of pages. Fields named in ``tail`` come from the last
    page as a whole, if it has them. Each leaf is an aggregate with a partial step, and items are told apart by Spark
    before a document gathers them, so no page has to be held with the others.
    """
    kind = pages.schema[column].dataType
    listed = [f.name for f in kind.fields if f.name == ITEMS and isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType)]
    at = lambda f: F.col(f"{column}.{f.name}")
    merged = {f.name: _first_known(f.dataType, at(f), F.col(order)) for f in kind.fields if f.name not in listed}
    last = {f.name: F.max_by(at(f), F.col(order)) for f in kind.fields if f.name in tail and f.name not in listed}
    out = pages.groupBy(key).agg(*(v.alias(f"m_{n}") for n, v in merged.items()), *(v.alias(f"t_{n}") for n, v in last.items()))
    if listed:
        item = kind[ITEMS].dataType.elementType
        each = pages.select(key, F.col(order).alias("_page"), F.posexplode(f"{column}.{ITEMS}").alias("_place", "_item")).filter("_item is not null")
        same = F.struct(*(F.lower(F.trim(F.coalesce(F.col("_item")[f.name].cast("string"), F.lit("")))).alias(f.name) for f in item.fields if f.name in IDENTITY))
        once = each.withColumn("_same", same).groupBy(key, "_same").agg(F.min_by(F.struct("_page", "_place", "_item"), F.struct("_page", "_place")).alias("_i"))
        items = once.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i._page", "_i._place", "_i._item"))), lambda x: x["_item"]).alias(f"m_{ITEMS}"))
        out = out.join(items, key, "left")
    value = lambda f: F.coalesce(F.when(~scalars.missing(F.col(f"t_{f.name}"), f.dataType), F.col(f"t_{f.name}")), F.col(f"m_{f.name}")) if f.name in last else F.col(f"m_{f.name}")
    return out.select(key, F.struct(*(value(f).alias(f.name) for f in kind.fields)).alias(column))
