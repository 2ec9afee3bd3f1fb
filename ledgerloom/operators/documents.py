"""Item rows and fields of waybills, invoices, payment orders and account protocols; merging their pages.

Rows of cells are document_id, page_no, row_no, cells (array of strings). Rules about a row stay inside it, so
they need no shuffle; numbering, merging and totals group by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import text
from ledgerloom.functions.numbers import soft_number
from ledgerloom.operators.amounts import _computed
from ledgerloom.operators.rows import running_numbers

PLACE = ("document_id", "page_no", "row_no")
# fixed values: words that mark rows without an item
TOTAL_WORDS = ("итого", "всего наименований", "внимание")
WAYBILL_HEADS = ("наименование товара", "единица измерения", "ставка ндс", "примечание")
#: Fields by which an item is the same on two pages.
IDENTITY = ("line_number", "sku", "barcode", "article", "name", "description", "unit", "quantity", "price", "free_unit_price_excl_vat", "unit_price_excl_vat", "cost", "total_excl_vat", "vat_rate", "vat_amount", "cost_with_vat", "total_incl_vat", "extra_charge", "note")


def cell(i: int) -> Column:
    """The i-th cell from 0, cleaned; null where there is none."""
    return text.clean_inline(F.try_element_at("cells", F.lit(i + 1)))


def number(i: int) -> Column:
    return soft_number(cell(i))


def whole(i: int) -> Column:
    return F.bround(number(i)).cast("long")


def percent(value: Column) -> Column:
    """'20%' from '20 %', '20,0' or '20'; null without a number."""
    plain = F.regexp_extract(F.translate(F.regexp_replace(value, r"\s", ""), ",", "."), r"([0-9]+(?:\.[0-9]+)?)", 1)
    shown = lambda x: F.when(x.rlike("^(?:0|[1-9][0-9]*)$"), x).otherwise(F.regexp_replace(x, r"^0*([0-9]+?)(?:\.0+|(\.[0-9]*[1-9])0*)?$", "$1$2"))
    return text.once(plain, lambda x: F.when(x != "", F.concat(shown(x), F.lit("%"))))


def _filled() -> Column:
    return F.filter(F.transform("cells", text.squeezed_inline), lambda v: v != "")


def index_row(least: int = 3) -> Column:
    """Whether the filled cells are consecutive whole numbers, as under a table's head."""
    whole_ = lambda v: F.when(v.rlike("^[0-9]{1,9}$"), v.cast("int"))
    steps = lambda n: F.zip_with(n, F.slice(n, 2, F.greatest(F.size(n), F.lit(1))), lambda a, b: b - a)
    rising = lambda n: F.forall(n, lambda v: v.isNotNull()) & F.forall(F.slice(steps(n), 1, F.greatest(F.size(n) - 1, F.lit(0))), lambda d: d == 1)
    # what is referred to more than once is bound: the cells are cleaned once a row
    index = text.once(F.transform(_filled(), lambda v: F.translate(v, "lI|", "111")), lambda digits: (F.size(digits) >= least) & text.once(F.transform(digits, whole_), rising))
    # most rows hold other signs than such numbers do: that is seen without looking at their cells
    return F.when(F.array_join("cells", " ").rlike("[^0-9lI| \\t\\r\\n\\x0b\\f\\u00a0]"), False).otherwise(index)


def _joined() -> Column:
    return F.lower(F.array_join("cells", " | "))


def _holds(words: tuple[str, ...]) -> Column:
    return _joined().rlike("|".join(words))


def waybill_items(rows: DataFrame) -> DataFrame:
    """Items of rows of nine cells or more; totals, heads, index rows and rows without a name go."""
    item = (F.size("cells") >= 9) & ~_holds(("итого", *WAYBILL_HEADS)) & ~index_row()
    # cells are cleaned once and computed before they are read: the JVM interprets generated methods above 8,000 bytes for good
    kept = _computed(_computed(rows).filter(item).select(*PLACE, *(cell(i).alias(f"_{i}") for i in range(9)))).filter("_0 is not null").filter(~F.col("_0").rlike("^[0-9]+$"))
    unit = F.when(F.lower("_1").isin("шт", "шт.", "шτ"), "шт").otherwise(F.col("_1"))
    gross = F.translate(F.nullif(F.regexp_extract("_7", r"([0-9]+[.,][0-9]{2})", 1), F.lit("")), ",", ".").cast("double")
    return kept.select(
        *PLACE, F.col("_0").alias("name"), unit.alias("unit"), F.bround(soft_number(F.col("_2"))).cast("long").alias("quantity"), soft_number(F.col("_3")).alias("price"), soft_number(F.col("_4")).alias("cost"),
        percent(F.col("_5")).alias("vat_rate"), soft_number(F.col("_6")).alias("vat_amount"), gross.alias("cost_with_vat"), F.col("_8").alias("note"),
    )


def _short(value: Column) -> Column:
    return value.rlike("^[0-9]{1,2}$")


def invoice_items(rows: DataFrame) -> DataFrame:
    """Items of rows of ten cells or more, padded to thirteen.

    A row counts if few of its cells are short whole numbers, an article or a description is there and at
    least three of cells 4 to 11 hold figures. Items without a readable number count on from the largest one before.
    """
    few_short = text.once(_filled(), lambda filled: F.size(F.filter(filled, _short)) < 0.7 * F.size(filled))
    named = F.coalesce(~_short(cell(1)), F.lit(False)) | F.coalesce(~_short(cell(2)), F.lit(False))
    figures = F.size(F.filter(F.slice("cells", 5, 8), lambda v: v.rlike("[0-9]")))
    kept = _computed(rows).filter((F.size("cells") >= 10) & ~_holds(TOTAL_WORDS) & ~index_row() & few_short & named & (figures >= 3))
    parsed = F.regexp_extract(cell(0), "^([0-9]{1,4})[.)]?$", 1)
    out = kept.select(
        *PLACE, F.nullif(parsed, F.lit("")).cast("int").alias("parsed"), cell(1).alias("article"), cell(2).alias("description"), cell(3).alias("barcode"), whole(4).alias("quantity"), cell(5).alias("unit"),
        number(6).alias("unit_price_incl_vat"), number(7).alias("amount_no_disc_incl_vat"), number(8).alias("disc_amount"), number(9).alias("amount_with_disc_excl_vat"),
        percent(cell(10)).alias("vat_rate"), number(11).alias("vat_amount"), number(12).alias("total_with_disc_incl_vat"),
    )
    return running_numbers(out, ["document_id"], ["page_no", "row_no"], "parsed").drop("parsed")


def account_items(rows: DataFrame) -> DataFrame:
    """Items of rows of ten cells or more; a number of 8 to 14 digits before the description is the article."""
    kept = _computed(rows).filter((F.size("cells") >= 10) & ~F.coalesce(F.lower(cell(0)).startswith("итого"), F.lit(False)) & ~index_row())
    sku = F.nullif(F.regexp_extract(cell(0), r"^([0-9]{8,14})\s+.*$", 1), F.lit(""))
    w = Window.partitionBy("document_id").orderBy("page_no", "row_no")
    return kept.select(
        *PLACE, F.row_number().over(w).alias("line_number"), sku.alias("sku"), F.regexp_replace(cell(0), r"^[0-9]{8,14}\s+", "").alias("description"), cell(1).alias("unit"),
        F.coalesce(F.nullif(whole(2), F.lit(0).cast("long")), F.lit(1).cast("long")).alias("quantity"), number(3).alias("free_unit_price_excl_vat"), number(4).alias("extra_charge"), number(5).alias("unit_price_excl_vat"),
        number(6).alias("total_excl_vat"), percent(cell(7)).alias("vat_rate"), number(8).alias("vat_amount"), number(9).alias("total_incl_vat"),
    )


def account_totals(rows: DataFrame) -> DataFrame:
    """document_id and the totals of its last total row of ten cells or more."""
    found = rows.filter((F.size("cells") >= 10) & F.lower(cell(0)).startswith("итого"))
    last = F.max_by(F.struct(number(6).alias("subtotal_excl_vat"), number(8).alias("vat_amount"), number(9).alias("total_incl_vat")), F.struct("page_no", "row_no"))
    return found.groupBy("document_id").agg(last.alias("t")).select("document_id", "t.*")


def _of(value: Column, pattern: str, group: int = 1) -> Column:
    return text.clean_inline(F.nullif(F.regexp_extract(value, f"(?iu){pattern}", group), F.lit("")))


def payment_order(full: Column) -> Column:
    """The fields of a payment order from its text: number, type, dates, urgency, amount, accounts, purpose."""
    account = F.transform(F.regexp_extract_all(F.regexp_replace(text.latin_lookalikes(full), r"(?<=[A-Z0-9]) (?=[A-Z0-9])", ""), F.lit("(BY[0-9]{2}[A-Z0-9]{24})"), F.lit(1)), lambda a: a)
    amount = soft_number(_of(full, r"сумма и валюта:\s*([0-9][0-9 ]*(?:[.,][0-9]{2})?)"))
    return F.struct(
        _of(full, r"№\s*([0-9]+)\s*\(").alias("payment_order_number"), _of(full, r"№\s*[0-9]+\s*\(([^)]+)\)").alias("payment_order_type"),
        text.normalise_date(_of(full, r"дата:\s*([0-3]?[0-9]\.[01]?[0-9]\.20[0-9]{2})")).alias("document_date"),
        F.coalesce(full.rlike(r"(?iu)(?<!не)срочный\s*х"), F.lit(False)).alias("urgent"), F.coalesce(full.rlike(r"(?iu)несрочный\s*х"), F.lit(False)).alias("non_urgent"),
        amount.alias("amount"), _of(full, r"код\s+валюты:\s*([0-9]{3})").alias("currency_code"),
        F.try_element_at(account, F.lit(1)).alias("payer_account"), F.try_element_at(account, F.lit(2)).alias("payee_account"),
        text.between(full, r"назначение платежа:\s*", ["№ документа:", "дата исполнения", "дата поступления"]).alias("purpose"),
        _of(full, r"дата поступления:?\s*([0-3]?[0-9]\.[01]?[0-9]\.20[0-9]{2}\s+[0-9]{2}:[0-9]{2})").alias("receipt_date"),
        _of(full, r"дата исполнения:?\s*([0-3]?[0-9]\.[01]?[0-9]\.20[0-9]{2}\s+[0-9]{2}:[0-9]{2})").alias("execution_date"),
    )


def distinct_items(items: DataFrame, segment: str = "document_id") -> DataFrame:
    """Items of all pages of a document once, the first kept; same means equal, trimmed, in lower case, in IDENTITY."""
    same = [F.lower(F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))) for c in IDENTITY if c in items.columns]
    w = Window.partitionBy(segment, *same).orderBy("page_no", "row_no")
    return items.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def merge_headers(pages: DataFrame, fields: list[str], key: str = "document_id") -> DataFrame:
    """For each field the value of the first page that has one; blank text counts as missing."""
    kinds = dict(pages.dtypes)
    present = lambda c: (F.trim(c) != "") if kinds[c] == "string" else F.col(c).isNotNull()
    return pages.groupBy(key).agg(*(F.min_by(c, F.when(present(c), F.col("page_no"))).alias(c) for c in fields))
