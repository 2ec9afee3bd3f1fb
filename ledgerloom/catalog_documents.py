"""Queries on document amounts by type, with SQL built from the same rules for another engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.catalog import LINE, query
from ledgerloom.operators import amounts, runs
from ledgerloom.sources.tables import table

_LINE = ", ".join(LINE)
c = F.col
TYPES = ("invoice", "waybill", "account_prot")
_GAP = "((l_orderkey * 7 + l_linenumber * 3 + l_partkey) % 13)"
_TAX = "(CASE l_linenumber % 4 WHEN 0 THEN 0.0 WHEN 1 THEN 0.1 WHEN 2 THEN 0.2 ELSE 0.25 END)"
_NET, _OFF = "l_extendedprice", "(l_extendedprice * (1 - l_discount))"
_GROSS = f"({_NET} * (1 + {_TAX}))"


def _but(gap: int, sql: str, moved: int | None = None, by: str = "* 10") -> str:
    """SQL: a value that is missing in some rows and has its point moved in others."""
    shown = sql if moved is None else f"CASE WHEN {_GAP} = {moved} THEN {sql} {by} ELSE {sql} END"
    return f"CASE WHEN {_GAP} <> {gap} THEN {shown} END"


#: Line items as rows of each document type: column -> SQL. Values are missing or have their point moved by a rule on the key.
ITEMS = {
    "invoice": {
        "quantity": _but(0, "l_quantity"), "unit_price_incl_vat": _but(1, f"{_GROSS} / l_quantity"), "amount_no_disc_incl_vat": _but(2, _GROSS, 6), "disc_amount": _but(3, f"{_GROSS} * l_discount"),
        "amount_with_disc_excl_vat": _but(4, _OFF, 7, "/ 100"), "vat_rate": _but(8, f"{_TAX} * 100"), "vat_amount": _but(5, f"{_OFF} * {_TAX}", 9), "total_with_disc_incl_vat": _but(11, f"{_OFF} * (1 + {_TAX})", 10, "* 1000"),
    },
    "waybill": {"quantity": _but(0, "l_quantity"), "price": _but(1, f"{_NET} / l_quantity"), "cost": _but(2, _NET, 6), "vat_rate": _but(8, f"{_TAX} * 100"), "vat_amount": _but(5, f"{_NET} * {_TAX}", 9, "/ 10"), "cost_with_vat": _but(11, _GROSS)},
    "account_prot": {
        "quantity": _but(0, "l_quantity"), "free_unit_price_excl_vat": _but(1, f"{_NET} / l_quantity * 0.75"), "extra_charge": _but(2, f"{_NET} / l_quantity * 0.25"), "unit_price_excl_vat": _but(3, f"{_NET} / l_quantity", 6),
        "total_excl_vat": _but(4, _NET, 7), "vat_rate": _but(8, f"{_TAX} * 100"), "vat_amount": _but(5, f"{_NET} * {_TAX}", 9), "total_incl_vat": _but(11, _GROSS),
    },
}


def _items(spark: SparkSession, root: str, kind: str) -> DataFrame:
    return table(spark, root, "lineitem").selectExpr(*LINE, *(f"cast({sql} as double) as {f}" for f, sql in ITEMS[kind].items()))


def _from(kind: str) -> str:
    return f"SELECT {_LINE}, " + ", ".join(f"CAST({sql} AS DOUBLE) AS {f}" for f, sql in ITEMS[kind].items()) + " FROM lineitem"


class _Chain:
    """SQL in steps: each is a query over the one before."""

    def __init__(self, first: str, columns: list[str]):
        self.steps, self.columns = [first], list(columns)

    def set(self, **values: str) -> None:
        old = {k: v for k, v in values.items() if k in self.columns}
        new = {k: v for k, v in values.items() if k not in self.columns}
        replace = " REPLACE (" + ", ".join(f"({v}) AS {k}" for k, v in old.items()) + ")" if old else ""
        more = "".join(f", ({v}) AS {k}" for k, v in new.items())
        self.steps.append(f"SELECT *{replace}{more} FROM t{len(self.steps) - 1}")
        self.columns += new

    def sql(self, select: str, where: str = "") -> str:
        return "WITH " + ", ".join(f"t{n} AS ({s})" for n, s in enumerate(self.steps)) + f" SELECT {select} FROM t{len(self.steps) - 1} {where}"


def _agree(chain: _Chain, name: str, values: list[str]) -> None:
    """Columns name (the target) and name_n (its supports) of the largest group of values that agree."""
    chain.set(**{f"{name}_v": "list_filter([" + ", ".join(f"CAST({v} AS DOUBLE)" for v in values) + "], lambda x: x IS NOT NULL)"})
    chain.set(**{f"{name}_g": f"list_transform({name}_v, lambda x: list_filter({name}_v, lambda y: abs(x - y) <= {amounts.TOLERANCE}))"})
    chain.set(**{f"{name}_n": f"coalesce(list_max(list_transform({name}_g, lambda g: len(g))), 0)"})
    chain.set(**{f"{name}_b": f"list_filter({name}_g, lambda g: len(g) = {name}_n)[1]"})
    chain.set(**{name: f"CASE WHEN {name}_n >= 2 THEN floor(list_sum({name}_b) / {name}_n * 100 + 0.5) / 100 END"})


def _moved(value: str, target: str) -> str:
    cases = " OR ".join(f"abs({value} {op} {s} - {target}) <= {amounts.TOLERANCE}" for s in (10, 100, 1000) for op in "/*")
    return f"coalesce(({cases}) AND abs({value} - {target}) > {amounts.TOLERANCE}, false)"


def _recovered(kind: str) -> _Chain:
    """Every field after all rules; for each change a column with its kind, and f_<field> where a field was touched."""
    fields = list(ITEMS[kind])
    chain = _Chain(_from(kind), [*LINE, *fields])
    for n, stage in enumerate(amounts.CORRECTIONS[kind]):
        for field, supports in stage.items():
            _agree(chain, f"c{n}_{field}", [s for _, s in supports])
        chain.set(**{f"m{n}_{field}": _moved(field, f"c{n}_{field}") for field in stage}, **{f"o{n}_{field}": amounts.cents(field) for field in stage})
        chain.set(**{field: f"CASE WHEN m{n}_{field} THEN c{n}_{field} ELSE {field} END" for field in stage})
    for n, (field, _, sql) in enumerate(amounts.FILLS[kind]):
        chain.set(**{f"f{n}_{field}": f"{field} IS NULL AND ({sql}) IS NOT NULL", f"d{n}_{field}": amounts.cents(sql)})
        chain.set(**{field: f"coalesce({field}, {sql})"})
    return chain


def _touched(kind: str, field: str) -> str:
    flags = [f"m{n}_{field}" for n, stage in enumerate(amounts.CORRECTIONS[kind]) if field in stage] + [f"f{n}_{field}" for n, (f, *_) in enumerate(amounts.FILLS[kind]) if f == field]
    return f"CASE WHEN {' OR '.join(flags)} THEN {amounts.cents(field)} ELSE {field} END AS {field}" if flags else field


def _changes_sql(kind: str) -> str:
    chain = _recovered(kind)
    parts = [f"SELECT {_LINE}, '{f}' AS field, c{n}_{f} AS value, o{n}_{f} AS previous_value, 'corrected' AS kind, CAST(c{n}_{f}_n AS INTEGER) AS support_count FROM last WHERE m{n}_{f}" for n, stage in enumerate(amounts.CORRECTIONS[kind]) for f in stage]
    parts += [f"SELECT {_LINE}, '{f}' AS field, d{n}_{f} AS value, CAST(NULL AS DOUBLE) AS previous_value, 'derived' AS kind, CAST(NULL AS INTEGER) AS support_count FROM last WHERE f{n}_{f}" for n, (f, *_) in enumerate(amounts.FILLS[kind])]
    return "SELECT * FROM (WITH last AS (" + chain.sql("*") + ") " + " UNION ALL ".join(parts) + ")"


def _add_recovery(kind: str) -> None:
    def values(spark, root):
        return amounts.recover(_items(spark, root, kind), kind).select(*LINE, *ITEMS[kind])

    def records(spark, root):
        found = amounts.recover(_items(spark, root, kind), kind).select(*LINE, F.explode("changes").alias("x"))
        return found.select(*LINE, *(f"x.{f}" for f in ("field", "value", "previous_value", "kind", "support_count")))

    values.__name__, records.__name__ = f"recover_{kind}_items", f"recover_{kind}_changes"
    query(_recovered(kind).sql(f"{_LINE}, " + ", ".join(_touched(kind, f) for f in ITEMS[kind])))(values)
    query(_changes_sql(kind))(records)


def _add_finalise(kind: str) -> None:
    marked = f"{_GAP} = 12 AND l_linenumber % 2 = 0"
    kept = amounts.LINKED[kind]

    def run(spark, root):
        rows = table(spark, root, "lineitem").selectExpr(*LINE, f"{marked} as marked", *(f"cast({sql} as double) as {f}" for f, sql in ITEMS[kind].items()))
        return amounts.finalise(rows, kind).select(*LINE, *kept, "vat_rate", "review")

    chain = _Chain(_from(kind).replace(f"SELECT {_LINE}", f"SELECT {_LINE}, {marked} AS marked", 1), [*LINE, "marked", *ITEMS[kind]])
    for name, sql in amounts.FINALISE[kind]:
        chain.set(**{name: sql})
    clean = ", ".join(f"CASE WHEN ok THEN {amounts.cents(f)} END AS {f}" for f in kept)
    run.__name__ = f"finalise_{kind}_rows"
    query(chain.sql(f"{_LINE}, {clean}, CASE WHEN ok THEN CAST(rate AS DOUBLE) END AS vat_rate, NOT coalesce(ok, false) AS review"))(run)


#: Totals of orders as their documents state them: the items' sums, missing or with the point moved for some documents.
_DOC = "(l_orderkey % 7)"


def _stated(kind: str) -> dict[str, str]:
    fields = list(amounts.TOTALS[kind])
    return {f: f"CASE WHEN {_DOC} = {n} THEN NULL WHEN {_DOC} = {(n + 3) % 7} AND l_orderkey % 2 = 0 THEN sum_{f} * 10 WHEN {_DOC} = {(n + 3) % 7} THEN sum_{f} + 5 ELSE sum_{f} END" for n, f in enumerate(fields)}


def _sums_sql(kind: str) -> str:
    plain = {"invoice": "invoice", "waybill": "waybill", "account_prot": "account_prot"}[kind]
    return f"SELECT l_orderkey, " + ", ".join(f"floor(sum({item}) * 100 + 0.5) / 100 AS sum_{f}" for f, (item, _) in amounts.TOTALS[kind].items()) + f" FROM ({_from(plain)}) GROUP BY 1"


def _totals(spark: SparkSession, root: str, kind: str) -> DataFrame:
    sums = amounts.item_sums(_items(spark, root, kind), kind, "l_orderkey")
    stated = sums.selectExpr("l_orderkey", *(f"cast({sql} as double) as {f}" for f, sql in _stated(kind).items()))
    return amounts.recover_totals(stated, sums, kind, "l_orderkey")


def _add_totals(kind: str) -> None:
    fields = list(amounts.TOTALS[kind])

    def run(spark, root):
        return _totals(spark, root, kind).select("l_orderkey", *fields, F.size("changes").alias("n_changes"), F.size("warnings").alias("n_warnings"))

    chain = _Chain(_sums_sql(kind), ["l_orderkey", *(f"sum_{f}" for f in fields)])
    chain.set(**{f: f"CAST({sql} AS DOUBLE)" for f, sql in _stated(kind).items()})
    chain.set(changes="0", warnings="0")
    for f in fields:
        chain.set(changes=f"changes + CASE WHEN {f} IS NULL AND sum_{f} >= 0 THEN 1 ELSE 0 END", warnings=f"warnings + CASE WHEN abs({f} - sum_{f}) > {amounts.TOLERANCE} THEN 1 ELSE 0 END", **{f: f"coalesce({f}, CASE WHEN sum_{f} >= 0 THEN sum_{f} END)"})
    for f in fields:
        if more := amounts.TOTALS[kind][f][1]:
            _agree(chain, f"a_{f}", [f"sum_{f}", *(s for _, s in more)])
            chain.set(**{f"m_{f}": _moved(f, f"a_{f}")})
            chain.set(changes=f"changes + CASE WHEN m_{f} THEN 1 ELSE 0 END", warnings=f"warnings + CASE WHEN NOT m_{f} AND abs({f} - a_{f}) > {amounts.TOLERANCE} THEN 1 ELSE 0 END", **{f: f"CASE WHEN m_{f} THEN a_{f} ELSE {f} END"})
    run.__name__ = f"recover_{kind}_totals"
    query(chain.sql(f"l_orderkey, {', '.join(fields)}, changes AS n_changes, warnings AS n_warnings"))(run)


for _kind in TYPES:
    _add_recovery(_kind)
    _add_totals(_kind)
for _kind in ("waybill", "invoice"):
    _add_finalise(_kind)

_VALUES = ("cost", "quantity * price", "cost_with_vat - vat_amount", "cost_with_vat / (1 + vat_rate / 100)")


def _consensus_sql() -> str:
    chain = _Chain(_from("waybill"), [*LINE, *ITEMS["waybill"]])
    _agree(chain, "agreed", list(_VALUES))
    return chain.sql(f"{_LINE}, agreed, CASE WHEN agreed IS NOT NULL THEN CAST(agreed_n AS INTEGER) END AS support_count")


@query(_consensus_sql())
def consensus_cluster(spark, root):
    agreed = amounts.consensus([F.expr(v) for v in _VALUES])
    return _items(spark, root, "waybill").withColumn("a", agreed).select(*LINE, c("a.value").alias("agreed"), c("a.support_count").cast("int").alias("support_count"))


@query("WITH n AS (SELECT l_orderkey, l_tax, count(*) AS k FROM lineitem GROUP BY 1, 2 HAVING count(*) >= 2) SELECT l_orderkey, l_tax, k AS votes FROM n QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY k DESC, l_tax) = 1")
def vat_rate_mode_supported(spark, root):
    """The most frequent rate of a document that at least two items bear."""
    return runs.supported_mode(table(spark, root, "lineitem"), "l_orderkey", "l_tax")
