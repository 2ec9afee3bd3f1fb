"""What the text of a page says about it: titles, scores of types, footer, blankness, role; and which parser it goes to.

Pages are rows source_id, page_no, page_id, top, mid, bottom, tail (texts of zones) and full (all of it). Rules are tables of
patterns with points, applied in one projection; the outcome is what ``segments`` reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import strip_markup
from ledgerloom.operators.amounts import _computed
from ledgerloom.operators.boxes import zone_text
from ledgerloom.operators.segments import TYPES, blank_page, page_type

c = F.col
# fixed values: titles of documents
PROTOCOL, PAYMENT, TRANSPORT_WAYBILL, GOODS_WAYBILL = r"счет[-\s]*протокол", r"платежн\w+\s+поручен", r"товарно[-\s]*транспортн\w*\s+накладн", r"товарн\w*\s+накладн"
PAYMENT_ANYWHERE = r"платежн\w*\s+поручен"
INVOICE_TITLES = (r"\bсч[её]т\s*(?:№|N|No|#)\s*[A-Za-zА-Яа-я0-9\-/]+", r"\bсч[её]т\b.{0,30}\bот\b.{0,20}[0-3]?\d[./][01]?\d[./]20\d{2}")
INVOICE_PARTIES = (r"\bпродавец\s*:", r"\bпокупател(?:ь|я)\s*:")
WAYBILL_NAMES = ("ТОВАРНО-ТРАНСПОРТНАЯ НАКЛАДНАЯ", "ТОВАРНАЯ НАКЛАДНАЯ")
# fixed values: points of a type: (where, points, patterns, whether each pattern counts)
HEAD, ANYWHERE, END = "head", "anywhere", "end"
POINTS: dict[str, tuple[tuple[str, int, tuple[str, ...], bool], ...]] = {
    "invoice": ((HEAD, 1, (r"\bпродавец\b", r"\bпокупател", r"\bоснован"), True), (ANYWHERE, 2, (r"\bвнимание\b", r"специалист\s+по\s+работе", r"счет\s+действителен\s+в\s+течение"), False), (ANYWHERE, -4, (PROTOCOL,), False)),
    "waybill": ((HEAD, 1, ("грузоотправ", "грузополуч", r"основание\s+отпуска"), True), (END, 2, (r"отпуск\s+разрешил", r"сдал\s+грузоотправитель", r"принял\s+грузополучатель"), False)),
    "payment_order": ((HEAD, 1, ("банк-отправ", "бенефициар", r"назначение\s+платеж", r"сумма\s+и\s+валюта"), True),),
    "account_prot": ((HEAD, 1, (r"\bпоставщик\b", r"\bпокупател"), True), (ANYWHERE, 2, (r"согласования\s+свободных", r"при\s+получении\s+товара\s+необходимо", r"счет\s+действителен\s+до"), False)),
}
TITLE_POINTS = {"invoice": 4, "waybill": 6, "payment_order": 8, "account_prot": 8}
#: Points of a protocol that is named, but not in the title.
NAMED_PROTOCOL = 5
# fixed values: what a page's end says, by type, and what says it anywhere on the page
FOOTERS = {
    "invoice": r"\bитого\b|\bвсего\b|всего\s+к\s+оплате|счет\s+действителен|внимание|специалист\s+по\s+работе|директор", "waybill": r"\bитого\b|\bвсего\b|отпуск\s+разрешил|сдал\s+грузоотправитель|принял\s+грузополучатель|с\s+товаром\s+переданы\s+документы",
    "payment_order": r"дата\s+исполнения|дата\s+поступления|штамп\s+банка|подпись\s+исполнителя", "account_prot": r"\bитого\b|\bвсего\b|счет\s+действителен\s+до|при\s+получении\s+товара\s+необходимо|сумма\s+прописью", "unknown": r"\bитого\b|\bвсего\b|подпись|директор",
}
SURE_FOOTERS = {"invoice": r"всего\s+к\s+оплате|директор", "account_prot": r"счет\s+действителен\s+до|сумма\s+прописью"}
READY_FOOTER = r"\bитого\b|\bвсего\b|отпуск\s+разрешил|сдал\s+грузоотправитель|принял\s+грузополучатель|внимание|действителен|подпись"
# fixed values: sure signs of a type
WAYBILL_DOC, SENDER, RECEIVER, BASIS, RELEASE = r"товарн(?:о[-\s]*транспортн\w*\s+)?накладн", "грузоотправ", "грузополуч", r"основани[ея]\s+отпуска", r"отпуск\s+разрешил"
NUMBERED, DATED = r"\bсчет\b\s*(?:№|N|No|#)\s*[\w#/\-]+", r"\bсчет\b.{0,30}\bот\b.{0,24}(?:[0-3]?\d[./][01]?\d[./]20\d{2}|[0-3]?\d\s+\w+\s+20\d{2})"
SELLER, BUYER, SUPPLIER, GROUND = r"\bпродавец\b", r"\bпокупател", r"\bпоставщик\b", r"\bоснован"
#: Shares of a page's height at which its zones begin and end, and the highest table that goes on from the page before.
ZONES = {"top": (0.0, 0.28), "mid": (0.28, 0.72), "bottom": (0.72, 1.0), "tail": (0.55, 1.0)}
HIGH_TABLE = 0.18


def says(text: Column, *patterns: str) -> Column:
    """Whether a text holds one of the patterns, whatever the case."""
    return F.coalesce(text.rlike("(?iU)" + "|".join(f"(?:{p})" for p in patterns)), F.lit(False))


def zones(pages: DataFrame) -> DataFrame:
    """top, mid, bottom and tail of pages (``cells``: array of x1, y1, x2, y2, text; ``height``): the texts of their zones."""
    edge = lambda share: F.floor(c("height") * share)
    return pages.withColumns({name: zone_text(c("cells"), edge(a), edge(b) if b < 1 else c("height")) for name, (a, b) in ZONES.items()})


def waybill_name(text: Column) -> Column:
    """The name under which a title calls a waybill; null where it calls none."""
    plain = strip_markup(text)
    return F.when(says(plain, TRANSPORT_WAYBILL), WAYBILL_NAMES[0]).when(says(plain, GOODS_WAYBILL), WAYBILL_NAMES[1])


def invoice_title(text: Column) -> Column:
    """Whether a text looks like an invoice's head: numbered, dated, or with both parties."""
    plain = strip_markup(text)
    return says(plain, *INVOICE_TITLES) | says(plain, INVOICE_PARTIES[0]) & says(plain, INVOICE_PARTIES[1])


def role_hint(doc_type: Column, page_no: Column, blank: Column, title: Column, footer: Column, goes_on: Column, table: Column) -> Column:
    """Which place a page may have in its document, by what it shows; a payment order is a page of its own."""
    out = F.when(blank, "blank").when(doc_type == "payment_order", F.when(title, "single_candidate").otherwise("unknown"))
    return out.when(title & footer & ~goes_on, "single_candidate").when(title, "first_candidate").when(footer, "last_candidate").when(goes_on | (page_no > 1) & table & ~title, "middle_candidate").otherwise("unknown")


def ready_role_hint(blank: Column, title: Column, footer: Column, goes_on: Column) -> Column:
    """The place of a page whose regions were found before: as ``role_hint``, without the type's say."""
    return F.when(blank, "blank").when(title & footer, "single_candidate").when(title, "first_candidate").when(footer, "last_candidate").when(goes_on, "middle_candidate").otherwise("unknown")


def ready_footer(has_box: Column, bottom: Column) -> Column:
    """Whether a page whose regions were found before has a footer: a box of that kind, or words at its end."""
    return has_box | says(bottom, READY_FOOTER)


def hard_type(title: Column, top: Column, full: Column) -> Column:
    """The type that sure signs on a page tell, in order: protocol, payment order, waybill, invoice; null without any."""
    text = F.concat_ws(" ", title, top, full)
    waybill = F.coalesce(title != "", F.lit(False)) | says(text, WAYBILL_DOC) | says(text, SENDER) & says(text, RECEIVER) & says(text, BASIS, RELEASE)
    invoice = says(text, NUMBERED, DATED) & ~says(text, WAYBILL_DOC) & (says(text, BUYER) & says(text, SELLER, SUPPLIER) | says(text, GROUND))
    return F.when(says(text, PROTOCOL), "account_prot").when(says(text, PAYMENT_ANYWHERE), "payment_order").when(waybill, "waybill").when(invoice, "invoice")


def signals(pages: DataFrame, forced: str | None = None) -> DataFrame:
    """The pages with page_doc_type, document_name, scores (map), has_title, has_footer, blank, continuation_like, role_hint
    and hard_type. Columns table_top (share of the height at which the table begins) and layout, where there are any, tell
    whether a page goes on with a table; ``forced`` is a type that all pages are known to have. Null texts are empty."""
    text = {n: F.coalesce(c(n).cast("string"), F.lit("")) for n in ("top", "mid", "bottom", "tail", "full")}
    join = lambda *names: F.concat_ws(" ", *(F.nullif(text[n], F.lit("")) for n in names))
    where = {HEAD: join("top", "full"), ANYWHERE: join("top", "mid", "bottom", "full"), END: join("tail", "full")}
    protocol, named = says(text["top"], PROTOCOL), says(where[ANYWHERE], PROTOCOL)
    titles = {"invoice": invoice_title(text["top"]) & ~protocol, "waybill": waybill_name(text["top"]).isNotNull(), "payment_order": says(text["top"], PAYMENT), "account_prot": protocol}
    sums = {}
    for kind, rules in POINTS.items():
        total = F.when(titles[kind], TITLE_POINTS[kind]).otherwise(0)
        for place, points, patterns, each in rules:
            for group in ([[p] for p in patterns] if each else [patterns]):
                total = total + F.when(says(where[place], *group), points).otherwise(0)
        sums[kind] = total
    sums["account_prot"] = sums["account_prot"] + F.when(named & ~protocol, NAMED_PROTOCOL).otherwise(0)
    out = _computed(pages.withColumns({f"_t_{k}": v for k, v in titles.items()} | {f"_s_{k}": v for k, v in sums.items()} | {"document_name": waybill_name(text["top"])}))
    kind = F.lit(forced) if forced else page_type({t: c(f"_s_{t}") for t in TYPES}, c("_t_payment_order"), c("_t_waybill"), c("_t_account_prot"))
    out = out.withColumns({"page_doc_type": kind, "has_title": c("_t_invoice") | c("_t_waybill") | c("_t_payment_order") | c("_t_account_prot")})
    end = join("bottom", "tail")
    footer = F.lit(False)
    for t, pattern in FOOTERS.items():
        held = says(end, pattern) | (says(text["full"], SURE_FOOTERS[t]) if t in SURE_FOOTERS else F.lit(False))
        footer = footer | ((c("page_doc_type") == t) if t != "unknown" else ~c("page_doc_type").isin(*TYPES)) & held
    high = F.coalesce(c("table_top") <= HIGH_TABLE, F.lit(False)) if "table_top" in pages.columns else F.lit(False)
    table = F.coalesce(c("layout") == "table", F.lit(False)) if "layout" in pages.columns else F.lit(False)
    out = out.withColumns({"has_footer": footer, "continuation_like": high & ~c("has_title")})
    out = out.withColumn("blank", blank_page(text["full"], c("has_title"), c("has_footer")))
    scores = F.create_map(*(x for t in TYPES for x in (F.lit(t), c(f"_s_{t}").cast("int"))))
    out = out.withColumns({"scores": scores, "role_hint": role_hint(c("page_doc_type"), c("page_no"), c("blank"), c("has_title"), c("has_footer"), c("continuation_like"), table), "hard_type": hard_type(c("document_name"), F.nullif(text["top"], F.lit("")), F.nullif(text["full"], F.lit("")))})
    return _computed(out.drop(*(f"_{x}_{t}" for x in "ts" for t in TYPES)))


def routed(pages: DataFrame, given: str = "page_doc_type", detected: str = "hard_type") -> DataFrame:
    """The pages with ``parser``: the type given if there is a parser for it, else the type detected; ``route_error`` says
    which pages have neither. No page is dropped."""
    known = lambda x: F.when(c(x).isin(*TYPES), c(x))
    out = pages.withColumn("parser", F.coalesce(known(given), known(detected)))
    return out.withColumn("route_error", F.when(c("parser").isNull(), F.concat(F.lit("no parser for "), F.coalesce(c(given), F.lit("nothing")))))
