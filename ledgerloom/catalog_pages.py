"""Queries on what pages say, over orders written out as pages, with points added up in SQL of its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.catalog import query
from ledgerloom.operators import page_signals
from ledgerloom.sources.tables import table

c = F.col
#: Heads of pages with the points they give: text, title's type, points for invoice, waybill, payment order, protocol, protocol named, buyer or supplier named.
_HEADS = (
    ("Счет № 5 Продавец: Ива Покупатель: Дуб", "invoice", 4 + 2, 0, 0, 1), ("Товарно-транспортная накладная", "waybill", 0, 6, 0, 0), ("Платежное поручение", "payment_order", 0, 0, 8, 0), ("Счет-протокол", "account_prot", -4, 0, 0, 8),
    ("Грузоотправитель грузополучатель", None, 0, 2, 0, 0), ("слово", None, 0, 0, 0, 0), ("поставщик", None, 0, 0, 0, 1),
)
#: Ends of pages: text, points anywhere and at the end, and the types whose footer they are.
_ENDS = (("внимание", 2, 0, ("invoice",)), ("отпуск разрешил директор", 0, 2, ("invoice", "waybill", "unknown")), ("итого 5", 0, 0, ("invoice", "waybill", "account_prot", "unknown")), ("дата исполнения", 0, 0, ("payment_order",)), ("ничего", 0, 0, ()))
#: Texts of whole pages (a head is part of none): text, points for invoice, payment order, whether it is long.
_BODIES = (("", 0, 0, False), ("банк-отправитель бенефициар и много других слов на странице", 0, 2, True), ("основание договор между сторонами о поставке всякой всячины", 1, 0, True))
_H, _E, _B = f"(o_orderkey % {len(_HEADS)})", f"(o_custkey % {len(_ENDS)})", f"((o_orderkey + o_custkey) % {len(_BODIES)})"


def _case(key: str, values, shown=lambda v: f"'{v}'") -> str:
    return f"CASE {key} " + " ".join(f"WHEN {k} THEN {'NULL' if v is None else shown(v)}" for k, v in enumerate(values)) + " END"


_PAGE = {"top": _case(_H, [h[0] for h in _HEADS]), "mid": "NULL", "bottom": _case(_E, [e[0] for e in _ENDS]), "tail": _case(_E, [e[0] for e in _ENDS]), "full": _case(_B, [b[0] for b in _BODIES])}
_N = str
_FOOTER = " OR ".join(f"e = {k} AND page_doc_type IN ({', '.join(repr(t) for t in e[3])})" for k, e in enumerate(_ENDS) if e[3])


@query(f"""WITH p AS (SELECT o_orderkey, {_H} AS h, {_E} AS e, {_B} AS b FROM orders),
 s AS (SELECT *, {_case('h', [h[1] for h in _HEADS])} AS title, {_case('h', [h[2] for h in _HEADS], _N)} + {_case('e', [x[1] for x in _ENDS], _N)} + {_case('b', [x[1] for x in _BODIES], _N)} AS invoice, {_case('h', [h[3] for h in _HEADS], _N)} + {_case('e', [x[2] for x in _ENDS], _N)} AS waybill, {_case('h', [h[4] for h in _HEADS], _N)} + {_case('b', [x[2] for x in _BODIES], _N)} AS payment_order, {_case('h', [h[5] for h in _HEADS], _N)} AS account_prot FROM p),
 t AS (SELECT *, CASE WHEN title IS NOT NULL AND title <> 'invoice' THEN title WHEN greatest(invoice, waybill, payment_order, account_prot) <= 0 THEN 'unknown' WHEN invoice >= greatest(waybill, payment_order, account_prot) THEN 'invoice' WHEN waybill >= greatest(payment_order, account_prot) THEN 'waybill' WHEN payment_order >= account_prot THEN 'payment_order' ELSE 'account_prot' END AS page_doc_type FROM s),
 f AS (SELECT *, {_FOOTER} AS has_footer, title IS NOT NULL AS has_title FROM t), g AS (SELECT *, b = 0 AND NOT has_title AND NOT has_footer AS blank FROM f)
 SELECT o_orderkey, page_doc_type, invoice, waybill, payment_order, account_prot, has_title, has_footer, blank, CASE WHEN blank THEN 'blank' WHEN page_doc_type = 'payment_order' THEN CASE WHEN has_title THEN 'single_candidate' ELSE 'unknown' END WHEN has_title AND has_footer THEN 'single_candidate' WHEN has_title THEN 'first_candidate' WHEN has_footer THEN 'last_candidate' ELSE 'unknown' END AS role_hint,
 CASE h WHEN 1 THEN 'waybill' WHEN 2 THEN 'payment_order' WHEN 3 THEN 'account_prot' WHEN 0 THEN 'invoice' END AS hard_type FROM g""")
def page_signals_of_text(spark, root):
    pages = table(spark, root, "orders").selectExpr("o_orderkey", "1 AS page_no", *(f"CAST({sql} AS STRING) AS {f}" for f, sql in _PAGE.items()))
    seen = page_signals.signals(pages)
    return seen.select("o_orderkey", "page_doc_type", *(c("scores")[t].alias(t) for t in page_signals.TYPES), "has_title", "has_footer", "blank", "role_hint", "hard_type")
