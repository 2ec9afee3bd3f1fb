"""Parts of a waybill beside its items: tax numbers by column, totals in the footer's text, addresses and grounds, fields that must be there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.text import clean_inline
from ledgerloom.operators import candidates
from ledgerloom.operators.invoice_lines import money

c = F.col
# fixed values: anchors of the footer, what parts an address from the ground of delivery and ends that, and the mark of review
VAT_ANCHOR, TOTAL_ANCHOR, TOTAL = r"Всего\s+сумма\s+НДС", r"Всего\s+стоимость\s+с\s+НДС", r"\bИтого\b"
GROUND, AFTER_GROUND = r"\b(?:Основание\s+отпуска|Осснование\s+отпуска|Договор)\b", r"\b(?:I+[\.\s]+ТОВАРН|ТОВАРНЫЙ\s+РАЗДЕЛ|Принял\s+грузополучатель|С\s+товаром|220\d{3},\s*г\.)"
MARKER = "проверить поле"
#: Characters before the footer's first anchor that hold its totals, and how far a sum of totals may be off.
BEFORE_ANCHOR, SUM_TOLERANCE = 180, 0.2
TOTALS = ("quantity_total", "cost_total", "vat_total", "cost_with_vat_total")
TAX = r"(?<![0-9])([0-9]{9})(?![0-9])"
#: Of a page's tax cells: least distance of columns, and the share of the cells' middling width that it may be more.
LEAST_GAP, GAP_SHARE = 40, 0.35


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def tax_columns(cells: DataFrame, tax: str = TAX) -> DataFrame:
    """page_id, place (from 0, left to right), tax_id: the tax number of each column of a page's tax cells (page_id, x1, y1, x2, y2, text).

    Centres whose gaps stay within the tolerance form a column; each cell goes to the column whose mean is nearest. A
    column's number is the first one in it from top to bottom, else one that its texts make together, else null. ``tax``:
    a pattern whose first group is a number; without it numbers have exactly nine digits.
    """
    w = Window.partitionBy("page_id")
    wide = F.greatest(F.lit(1), c("x2") - c("x1"))
    df = cells.select("page_id", "x1", "y1", ((c("x1") + c("x2")) / 2).alias("cx"), ((c("y1") + c("y2")) / 2).alias("cy"), wide.alias("wide"), clean_inline(c("text")).alias("text"))
    df = df.withColumns({"_n": F.count("*").over(w), "_k": F.row_number().over(w.orderBy("wide"))})
    df = df.withColumn("_middling", F.max(F.when(c("_k") == F.floor(c("_n") / 2) + 1, c("wide"))).over(w)).withColumn("_tol", F.greatest(F.lit(LEAST_GAP), F.floor(c("_middling") * GAP_SHARE)))
    by_x = w.orderBy("cx")
    df = df.withColumn("_new", F.when(c("cx") - F.lag("cx").over(by_x) > c("_tol"), 1).otherwise(0)).withColumn("_column", F.sum("_new").over(by_x.rangeBetween(Window.unboundedPreceding, 0)))
    means = df.groupBy("page_id", "_column").agg(F.avg("cx").alias("_mean")).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("_column", "_mean"))).alias("_means"))
    near = F.array_min(F.transform("_means", lambda m: F.struct(F.abs(c("cx") - m["_mean"]).alias("d"), m["_column"].alias("column"))))["column"]
    cell = F.struct("cy", "x1", "text", _found(c("text"), tax).alias("tax"))
    held = df.join(means, "page_id").withColumn("place", near).groupBy("page_id", "place").agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    first = F.try_element_at(F.filter("cells", lambda x: x["tax"].isNotNull()), F.lit(1))["tax"]
    together = F.array_join(F.transform("cells", lambda x: x["text"]), " ")
    return held.select("page_id", c("place").cast("int").alias("place"), F.coalesce(first, _found(together, tax)).alias("tax_id"))


def party_taxes(cells: DataFrame, tax: str = TAX) -> DataFrame:
    """page_id, sender, payer, receiver: tax numbers by column: the first is the sender's, of two columns the second is the
    receiver's, of three or more the second the payer's and the third the receiver's."""
    columns = tax_columns(cells, tax).groupBy("page_id").agg(F.count("*").alias("n"), *(F.max(F.when(c("place") == k, c("tax_id"))).alias(f"_{k}") for k in range(3)))
    return columns.select("page_id", c("_0").alias("sender"), F.when(c("n") > 2, c("_1")).alias("payer"), F.when(c("n") == 2, c("_1")).when(c("n") > 2, c("_2")).alias("receiver"))


def footer_totals(text: Column) -> Column:
    """struct of TOTALS read from the text before the footer's first anchor; null where there is none.

    The quantity follows the word for the total. Of the last three decimal numbers two must make the third, then they are tax,
    cost and total by size; else the last two, if they differ, are tax and total, and their difference the cost.
    """
    clean = clean_inline(text)
    window = F.right(F.regexp_extract(clean, rf"(?iU)^(.*?)(?:{VAT_ANCHOR}|{TOTAL_ANCHOR})", 1), F.lit(BEFORE_ANCHOR))
    tokens = F.regexp_extract_all(window, F.lit(r"([0-9]{1,3}(?:\s[0-9]{3})+[.,][0-9]{1,2}|[0-9]+[.,][0-9]{1,2}|[0-9]+)"), F.lit(1))
    numbers = F.transform(F.filter(tokens, lambda t: t.rlike("[.,]")), lambda t: F.translate(F.regexp_replace(t, r"\s", ""), ",", ".").cast("double"))
    cents = lambda x: F.floor(x * 100 + 0.5) / 100
    last = lambda v, n: F.array_sort(F.slice(v, F.greatest(F.size(v) - n + 1, F.lit(1)), F.lit(n)))

    def read(v: Column) -> Column:
        three, two = last(v, 3), last(v, 2)
        get = lambda a, i: F.get(a, F.lit(i))
        sums = (F.size(v) >= 3) & (F.abs(get(three, 0) + get(three, 1) - get(three, 2)) <= SUM_TOLERANCE)
        apart = (F.size(v) >= 2) & (get(two, 1) > get(two, 0))
        some = lambda a, b: cents(F.when(sums, a).when(apart, b))
        label = window.rlike(f"(?iU){TOTAL}")
        quantity = _found(window, rf"(?iU){TOTAL}[^\d]{{0,12}}(\d{{1,6}})(?![.,]\d)").cast("double")
        return F.struct(quantity.alias("quantity_total"), *(F.when(label, x).alias(n) for n, x in (("cost_total", some(get(three, 1), get(two, 1) - get(two, 0))), ("vat_total", some(get(three, 0), get(two, 0))), ("cost_with_vat_total", some(get(three, 2), get(two, 1))))))

    return F.when(window != "", F.element_at(F.transform(F.array(numbers), read), 1))


def totals_incoherent(totals: dict[str, Column]) -> Column:
    """Whether totals (by the names of TOTALS) contradict each other; what is missing contradicts nothing."""
    q, x, v, t = (totals[n] for n in TOTALS)
    return F.coalesce(q <= 0, F.lit(False)) | F.coalesce(t + 0.01 < v, F.lit(False)) | F.coalesce(t + 0.01 < x, F.lit(False)) | F.coalesce(F.abs(x + v - t) > SUM_TOLERANCE, F.lit(False))


def settle_totals(documents: DataFrame, text: str) -> DataFrame:
    """The documents with totals that contradict each other replaced by those that the footer's text states, if these hold
    together, and missing ones filled from it; ``totals_from`` says where they come from: items, text, or both."""
    df = documents.withColumn("_f", footer_totals(c(text)))
    stated = {n: c(f"_f.{n}") for n in TOTALS}
    df = df.withColumns({"_bad": totals_incoherent({n: c(n) for n in TOTALS}), "_good": c("_f.cost_with_vat_total").isNotNull() & ~totals_incoherent(stated)})
    swap = c("_bad") & F.coalesce(c("_good"), F.lit(False))
    filled = F.lit(False)
    for n in TOTALS:
        filled = filled | c(n).isNull() & stated[n].isNotNull()
    return df.withColumns({n: F.when(swap, F.coalesce(stated[n], c(n))).otherwise(F.coalesce(c(n), stated[n])) for n in TOTALS} | {"totals_from": F.when(swap, "text").when(filled, "both").otherwise("items")}).drop("_f", "_bad", "_good")


def address_and_ground(address: Column, ground: Column) -> Column:
    """struct(address, ground): an address that goes on with the ground of delivery is cut there; what follows is the ground,
    up to the next part of the form, if none is known."""
    address, ground = clean_inline(address), clean_inline(ground)
    split = F.regexp_extract(address, rf"(?iU)^(.*?)({GROUND}.*)$", 2)
    before = clean_inline(F.regexp_extract(address, rf"(?iU)^(.*?)({GROUND}.*)$", 1))
    tail = clean_inline(split)
    ended = clean_inline(F.regexp_extract(tail, rf"(?iU)^(.*?){AFTER_GROUND}", 1))
    cut = F.nullif(split, F.lit("")).isNotNull()
    return F.struct(F.when(cut, F.coalesce(before, address)).otherwise(address).alias("address"), F.when(cut, F.coalesce(ground, ended, tail)).otherwise(ground).alias("ground"))


def required(party: dict[str, Column], must: tuple[str, ...] = ("address", "tax_id")) -> dict[str, Column]:
    """The fields of a party with the mark of review in place of those that must be there and are missing, if any is there."""
    some = F.coalesce(*(clean_inline(v) for v in party.values())).isNotNull()
    return {k: F.when(some & clean_inline(v).isNull(), MARKER).otherwise(v) if k in must else v for k, v in party.items()}


def code_prefix(code: Column) -> Column:
    """A bank code's first four letters with a misread K for R at their end: OTHK... -> OTHR..."""
    return F.regexp_replace(code, "^OTHK", "OTHR")


def no_item_row(name: Column, unit: Column, note: Column, known: dict[str, Column]) -> Column:
    """Whether a waybill's row is no item: totals, a publisher's mark, Latin noise with four amounts or more in doubt, or a
    company's name beside sums without quantity or unit. ``known``: its amounts by field, null in doubt; a row without a name is
    not judged."""
    name, unit, note = F.upper(clean_inline(name)), clean_inline(unit), clean_inline(note)
    text = F.concat_ws(" ", name, note)
    doubts = sum((v.isNull().cast("int") for v in known.values()), F.lit(0))
    latin, cyrillic = F.length(F.regexp_replace(text, "[^A-Z]", "")), F.length(F.regexp_replace(text, "[^А-ЯЁ]", ""))
    sums = known["cost"].isNotNull() | known["vat_amount"].isNotNull() | known["cost_with_vat"].isNotNull()
    core = F.coalesce(known["quantity"] > 0, F.lit(False)) | candidates.unit(unit).isNotNull()
    signs = (
        name.isin("ИТОТА", "ИТОГА", "ИТО0А") | name.rlike("ИТОГ|ВСЕГО|ИЗДАТЕЛ|БЕДБЛАНК"), (doubts >= 4) & ~text.rlike("[0-9]") & (latin >= 8) & (cyrillic == 0),
        note.isNull() & unit.isNull() & (doubts >= 4) & name.rlike("^[A-Z]{3,8}$"), ~core & sums & name.rlike("РУП|ООО|ОАО|ЗАО"),
    )
    out = F.lit(False)
    for sign in signs:
        out = out | F.coalesce(sign, F.lit(False))
    return name.isNotNull() & out


def suspicious_invoice_item(line_number: Column, article: Column, unit: Column, description: Column, vat_rate: Column) -> Column:
    """Whether an invoice's item looks misread: an unknown rate, its number stuck to the article, figures or a long number in
    the unit, a description that is a bar code or holds a number and an article."""
    article = F.upper(F.regexp_replace(F.coalesce(clean_inline(article), F.lit("")), r"\s+", ""))
    number, unit, description = line_number.cast("string"), clean_inline(unit), clean_inline(description)
    rest = F.substr(article, F.length(number) + 1)
    out = ~clean_inline(vat_rate).isin("0%", "10%", "20%")
    for sign in (article.startswith(number) & rest.rlike(r"^[A-ZА-Я]"), money(unit).isNotNull() | unit.rlike("[0-9]{6,}"), description.rlike("^[0-9]{8,14}$"), description.rlike(r"(?iU)\b\d{1,3}\s+[A-ZА-Я0-9]{1,8}\s*/\s*[A-ZА-Я0-9./-]{1,16}\b")):
        out = F.coalesce(out, F.lit(False)) | F.coalesce(sign, F.lit(False))
    return out
