"""Amounts of items and documents by type: corrected by consensus, filled from each other, finalised, with records.

The rules are tables of SQL expressions over the columns of a row, so a row's work stays inside it (no shuffle) and
Catalyst sees plain expressions. Numbers are doubles; a missing one is null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Amounts that differ by no more than this are the same.
TOLERANCE = 0.02
#: A rate as a fraction; above 1 it counts as percent (so 1 stays 1).
RATE = "(CASE WHEN vat_rate > 1 THEN vat_rate / 100 ELSE vat_rate END)"


def cents(x: str) -> str:
    """SQL: rounded to two places, halves up."""
    return f"(floor(({x}) * 100 + 0.5) / 100)"


def near(a: str, b: str, absolute: float = 0.05, relative: float = 0.015) -> str:
    """SQL: whether two amounts agree within the larger of two tolerances; false where one is missing."""
    return f"coalesce(abs(({a}) - ({b})) <= greatest({absolute!r}, abs({b}) * {relative!r}), false)"


def both(a: str, b: str, then: str) -> str:
    """SQL: ``then`` where both amounts are there and not negative."""
    return f"CASE WHEN {a} >= 0 AND {b} >= 0 THEN {then} END"


def less(a: str, b: str) -> str:
    """SQL: a - b where a >= b >= 0."""
    return f"CASE WHEN {a} >= {b} AND {b} >= 0 THEN {a} - {b} END"


def _times_rate(a: str, rounded: bool = True) -> str:
    value = f"{a} * {RATE}"
    return f"CASE WHEN {a} >= 0 AND {RATE} >= 0 THEN {cents(value) if rounded else value} END"


def _without_rate(a: str) -> str:
    return f"CASE WHEN {a} >= 0 AND {RATE} >= 0 THEN {cents(f'{a} / (1 + {RATE})')} END"


# Supports of a value: (what they are, SQL). A value is corrected to the consensus of its supports if it is that value with
# the point moved. Corrections of one stage see the row as it was before the stage.
_Q, _P, _N, _D, _X, _V, _T = "quantity", "unit_price_incl_vat", "amount_no_disc_incl_vat", "disc_amount", "amount_with_disc_excl_vat", "vat_amount", "total_with_disc_incl_vat"
CORRECTIONS: dict[str, list[dict[str, list[tuple[str, str]]]]] = {
    "invoice": [
        {_T: [(f"{_X} + {_V}", both(_X, _V, f"{_X} + {_V}")), (f"{_N} - {_D}", less(_N, _D)), (f"{_Q} * {_P} (discount blank/0)", f"CASE WHEN {_Q} >= 0 AND {_P} >= 0 AND ({_D} IS NULL OR abs({_D}) <= 0.02) THEN {_Q} * {_P} END"), (f"{_X} * (1 + vat_rate)", f"CASE WHEN {_X} >= 0 AND {RATE} >= 0 THEN {cents(f'{_X} * (1 + {RATE})')} END")]},
        {
            _N: [(f"{_Q} * {_P}", both(_Q, _P, f"{_Q} * {_P}")), (f"{_T} + {_D}", both(_T, _D, f"{_T} + {_D}"))],
            _X: [(f"{_T} - {_V}", less(_T, _V)), (f"{_T} / (1 + vat_rate)", _without_rate(_T))],
            _V: [(f"{_T} - {_X}", less(_T, _X)), (f"{_X} * vat_rate", _times_rate(_X))],
            _D: [(f"{_N} - {_T}", less(_N, _T)), (f"{_Q} * {_P} - {_T}", f"CASE WHEN {_Q} >= 0 AND {_P} >= 0 AND {_Q} * {_P} >= {_T} AND {_T} >= 0 THEN {_Q} * {_P} - {_T} END")],
        },
    ],
    "waybill": [{
        "cost": [("quantity * price", both("quantity", "price", "quantity * price")), ("cost_with_vat - vat_amount", less("cost_with_vat", "vat_amount"))],
        "vat_amount": [("cost_with_vat - cost", less("cost_with_vat", "cost")), ("cost * vat_rate", _times_rate("cost", False))],
    }],
    "account_prot": [{
        "total_excl_vat": [("quantity * unit_price_excl_vat", both("quantity", "unit_price_excl_vat", "quantity * unit_price_excl_vat")), ("total_incl_vat - vat_amount", less("total_incl_vat", "vat_amount"))],
        "unit_price_excl_vat": [("free_unit_price_excl_vat + extra_charge", both("free_unit_price_excl_vat", "extra_charge", "free_unit_price_excl_vat + extra_charge")), ("total_excl_vat / quantity", "CASE WHEN total_excl_vat >= 0 AND quantity > 0 THEN total_excl_vat / quantity END")],
        "vat_amount": [("total_incl_vat - total_excl_vat", less("total_incl_vat", "total_excl_vat")), ("total_excl_vat * vat_rate", _times_rate("total_excl_vat", False))],
    }],
}


def _above_zero(sql: str) -> str:
    return f"CASE WHEN ({sql}) > 0 THEN {sql} END"


#: Fills of missing values in order: (field, what it is made of, SQL); later fills see earlier ones.
FILLS: dict[str, list[tuple[str, str, str]]] = {
    "invoice": [
        (_N, f"{_Q} * {_P}", both(_Q, _P, f"{_Q} * {_P}")), (_N, f"{_T} + {_D}", both(_T, _D, f"{_T} + {_D}")), (_T, f"{_N} - {_D}", less(_N, _D)), (_D, f"{_N} - {_T}", f"CASE WHEN {_N} - {_T} > 0 THEN {_N} - {_T} END"),
        (_V, f"{_T} - {_X}", _above_zero(less(_T, _X))), (_X, f"{_T} - {_V}", less(_T, _V)), (_X, f"{_T} / (1 + vat_rate)", _without_rate(_T)), (_V, f"{_X} * vat_rate", _above_zero(_times_rate(_X))), (_T, f"{_X} + {_V}", both(_X, _V, f"{_X} + {_V}")),
    ],
    "waybill": [("cost", "quantity * price", both("quantity", "price", "quantity * price")), ("vat_amount", "cost_with_vat - cost", less("cost_with_vat", "cost")), ("cost_with_vat", "cost + vat_amount", both("cost", "vat_amount", "cost + vat_amount"))],
    "account_prot": [
        ("unit_price_excl_vat", "free_unit_price_excl_vat + extra_charge", both("free_unit_price_excl_vat", "extra_charge", "free_unit_price_excl_vat + extra_charge")), ("total_excl_vat", "quantity * unit_price_excl_vat", both("quantity", "unit_price_excl_vat", "quantity * unit_price_excl_vat")),
        ("vat_amount", "total_incl_vat - total_excl_vat", less("total_incl_vat", "total_excl_vat")), ("total_incl_vat", "total_excl_vat + vat_amount", both("total_excl_vat", "vat_amount", "total_excl_vat + vat_amount")),
    ],
}
FIELDS = {
    "invoice": (_Q, _P, _N, _D, _X, "vat_rate", _V, _T),
    "waybill": ("quantity", "price", "cost", "vat_rate", "vat_amount", "cost_with_vat"),
    "account_prot": ("quantity", "free_unit_price_excl_vat", "extra_charge", "unit_price_excl_vat", "total_excl_vat", "vat_rate", "vat_amount", "total_incl_vat"),
}
#: Totals of a document: field -> (field of the items it sums, supports beside that sum). In this order, later ones see earlier corrections.
TOTALS: dict[str, dict[str, tuple[str, list[tuple[str, str]]]]] = {
    "invoice": {
        "total_quantity": (_Q, []), "subtotal_no_disc_incl_vat": (_N, [("total_with_disc_incl_vat + total_disc_amount", both("total_with_disc_incl_vat", "total_disc_amount", "total_with_disc_incl_vat + total_disc_amount"))]),
        "total_disc_amount": (_D, [("subtotal_no_disc_incl_vat - total_with_disc_incl_vat", less("subtotal_no_disc_incl_vat", "total_with_disc_incl_vat"))]), "subtotal_with_disc_excl_vat": (_X, [("total_with_disc_incl_vat - vat_amount", less("total_with_disc_incl_vat", "vat_amount"))]),
        "vat_amount": (_V, [("total_with_disc_incl_vat - subtotal_with_disc_excl_vat", less("total_with_disc_incl_vat", "subtotal_with_disc_excl_vat"))]),
        "total_with_disc_incl_vat": (_T, [("subtotal_with_disc_excl_vat + vat_amount", both("subtotal_with_disc_excl_vat", "vat_amount", "subtotal_with_disc_excl_vat + vat_amount")), ("subtotal_no_disc_incl_vat - total_disc_amount", less("subtotal_no_disc_incl_vat", "total_disc_amount"))]),
    },
    "waybill": {
        "quantity_total": ("quantity", []), "cost_total": ("cost", []), "vat_total": ("vat_amount", [("cost_with_vat_total - cost_total", less("cost_with_vat_total", "cost_total"))]),
        "cost_with_vat_total": ("cost_with_vat", [("cost_total + vat_total", both("cost_total", "vat_total", "cost_total + vat_total"))]),
    },
    "account_prot": {
        "subtotal_excl_vat": ("total_excl_vat", []), "vat_amount": ("vat_amount", [("total_incl_vat - subtotal_excl_vat", less("total_incl_vat", "subtotal_excl_vat"))]),
        "total_incl_vat": ("total_incl_vat", [("subtotal_excl_vat + vat_amount", both("subtotal_excl_vat", "vat_amount", "subtotal_excl_vat + vat_amount"))]),
    },
}
#: Totals in words and the totals they state.
WORDS = {"invoice": {"total_in_words": "total_with_disc_incl_vat"}, "waybill": {"vat_total_words": "vat_total", "cost_with_vat_total_words": "cost_with_vat_total"}, "account_prot": {"total_in_words": "total_incl_vat"}}
_CHANGE = "struct<field:string,value:double,previous_value:double,kind:string,source:string,support_count:int>"


def _round2(x: Column) -> Column:
    return F.floor(x * 100 + 0.5) / 100


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` refers to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _computed(df: DataFrame) -> DataFrame:
    """The same rows; what comes before is computed once: filters on the result, written or inferred, stay above it, and no
    later expression takes those before it in."""
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def consensus(values: list[Column], tolerance: float = TOLERANCE) -> Column:
    """struct(value, support_count, members) of the largest group of values that agree with one of them: their mean to two
    places, how many, and their places. Null where no two agree; of equally large groups the first one's counts."""
    every = F.array(*(F.struct(v.alias("v"), F.lit(i).alias("i")) for i, v in enumerate(values)))

    def largest(known: Column) -> Column:
        groups = F.transform(known, lambda x: F.filter(known, lambda y: F.abs(x["v"] - y["v"]) <= tolerance))
        # sorted by size, the first of the largest groups stands first
        ranked = F.array_sort(F.transform(groups, lambda g, k: F.struct((-F.size(g)).alias("n"), k.alias("k"), g.alias("g"))))
        return _once(F.try_element_at(ranked, F.lit(1)), lambda best: F.when(best["n"] <= -2, F.struct(_round2(F.aggregate(best["g"], F.lit(0.0), lambda a, x: a + x["v"]) / -best["n"]).alias("value"), (-best["n"]).alias("support_count"), F.transform(best["g"], lambda x: x["i"]).alias("members"))))

    return _once(F.filter(every, lambda x: x["v"].isNotNull()), largest)


def point_moved(value: Column, target: Column, tolerance: float = TOLERANCE) -> Column:
    """Whether a value is its target with the point moved by one to three places, and not the target itself."""
    moved = F.lit(False)
    for scale in (10.0, 100.0, 1000.0):
        moved = moved | (F.abs(value / scale - target) <= tolerance) | (F.abs(value * scale - target) <= tolerance)
    return F.coalesce(moved & (F.abs(value - target) > tolerance), F.lit(False))


def _change(field: str, value: Column, previous: Column, kind: str, source: Column, count: Column) -> Column:
    return F.struct(F.lit(field).alias("field"), value.alias("value"), previous.alias("previous_value"), F.lit(kind).alias("kind"), source.alias("source"), count.cast("int").alias("support_count"))


def agree(df: DataFrame, name: str, supports: list[tuple[str, Column]], tolerance: float = TOLERANCE) -> DataFrame:
    """Columns ``name``_value, ``name``_count and ``name``_source: as ``consensus``, for values that each have a label, by
    comparing them two by two in plain expressions. Null where no two agree."""
    values = [f"{name}_s{i}" for i in range(len(supports))]
    every = range(len(supports))
    df = df.withColumns({v: x for v, (_, x) in zip(values, supports)})
    pairs = {(i, j): f"{name}_p{i}_{j}" for i in every for j in every if i < j}
    df = df.withColumns({p: F.coalesce(F.abs(F.col(values[i]) - F.col(values[j])) <= tolerance, F.lit(False)) for (i, j), p in pairs.items()})
    near = lambda i, j: F.lit(True) if i == j else F.col(pairs[min(i, j), max(i, j)])
    if len(supports) == 2:  # one pair says it all
        both_agree, (a, b) = near(0, 1), (label for label, _ in supports)
        out = {f"{name}_value": F.when(both_agree, _round2((F.col(values[0]) + F.col(values[1])) / 2)), f"{name}_count": F.when(both_agree, 2), f"{name}_source": F.when(both_agree, f"{a} & {b}")}
        return df.withColumns(out).drop(*values, *pairs.values())
    most, first, members = f"{name}_most", f"{name}_first", [f"{name}_g{j}" for j in every]
    sizes = [f"{name}_n{i}" for i in every]
    df = df.withColumns({sizes[i]: sum((near(i, j).cast("int") for j in every if j != i), F.lit(1)) for i in every})
    df = df.withColumn(most, F.greatest(*sizes) if len(sizes) > 1 else F.col(sizes[0]))
    df = df.withColumn(first, F.coalesce(*(F.when((F.col(most) >= 2) & (F.col(sizes[i]) == F.col(most)), i) for i in every)))
    df = _computed(df.drop(*sizes))
    df = df.withColumns({members[j]: F.coalesce(*(F.when(F.col(first) == i, near(i, j)) for i in every), F.lit(False)) for j in every})
    total = sum((F.when(F.col(members[j]), F.col(values[j])).otherwise(0.0) for j in every), F.lit(0.0))
    known = F.col(first).isNotNull()
    source = F.concat_ws(" & ", *(F.when(F.col(members[j]), label) for j, (label, _) in enumerate(supports)))
    df = df.withColumns({f"{name}_value": F.when(known, _round2(total / F.col(most))), f"{name}_count": F.when(known, F.col(most)), f"{name}_source": F.when(known, source)})
    return df.drop(*values, *pairs.values(), *members, most, first)


def recover(items: DataFrame, doc_type: str) -> DataFrame:
    """Items of a type with corrected and filled amounts and ``changes``, a record of each in the order they were made.

    Every rule is a plain expression over columns of the row; after a few of them the row is computed, so that each method
    Spark generates from them stays below 8,000 bytes: the JVM interprets longer ones for good.
    """
    changes: list[str] = []
    out, touched = _computed(items), {}
    for n, stage in enumerate(CORRECTIONS[doc_type]):
        for field, supports in stage.items():
            out = _computed(agree(out, f"_c{n}_{field}", [(label, F.expr(s)) for label, s in supports]))
        new = {}
        for field in stage:
            value, old = F.col(f"_c{n}_{field}_value"), F.col(field)
            moved = point_moved(old, value)
            name = f"_r{n}_{field}"
            new |= {name: F.when(moved, _change(field, value, _round2(old), "corrected", F.col(f"_c{n}_{field}_source"), F.col(f"_c{n}_{field}_count"))), field: F.when(moved, value).otherwise(old)}
            changes.append(name)
            touched.setdefault(field, []).append(name)
        out = _computed(out.withColumns(new).drop(*(f"_c{n}_{f}_{x}" for f in stage for x in ("value", "count", "source"))))
    for n, (field, label, sql) in enumerate(FILLS[doc_type]):
        name, filled = f"_f{n}_{field}", F.expr(sql)
        out = out.withColumns({name: F.when(F.col(field).isNull() & filled.isNotNull(), _change(field, _round2(filled), F.lit(None).cast("double"), "derived", F.lit(label), F.lit(None))), field: F.coalesce(F.col(field), filled)})
        changes.append(name)
        touched.setdefault(field, []).append(name)
        if n % 3 == 2:
            out = _computed(out)
    known = lambda names: F.coalesce(*names).isNotNull()
    rounded = {f: F.when(known(names), _round2(F.col(f))).otherwise(F.col(f)) for f, names in touched.items()}
    out = out.withColumns({"changes": F.array_compact(F.array(*changes)).cast(f"array<{_CHANGE}>")} | rounded)
    return _computed(out.drop(*changes))


def recover_totals(documents: DataFrame, sums: DataFrame, doc_type: str, key: str, words: dict[str, Column] | None = None) -> DataFrame:
    """Totals of documents against the sums of their items (columns ``sum_<total>``), amounts in words and each other.

    A missing total is filled from its sum, then from its words (``words``: total -> amount read). A total that is its
    supports' consensus with the point moved is corrected; other differences are ``warnings`` (field, extracted, derived,
    source). ``changes`` records fills and corrections.
    """
    out = documents.join(sums, key, "left")
    changes, warnings = [], []
    warn = lambda field, extracted, derived, source: F.struct(F.lit(field).alias("field"), extracted.alias("extracted"), derived.alias("derived"), source.alias("source"))
    apart = lambda a, b: F.coalesce(F.abs(a - b) > TOLERANCE, F.lit(False))
    words = words or {}
    for n, (field, (item, _)) in enumerate(TOTALS[doc_type].items()):
        total, derived, label = F.col(field), F.col(f"sum_{field}"), F.lit(f"sum(items.{item})")
        out = out.withColumns({f"_s{n}": F.when(total.isNull() & (derived >= 0), _change(field, derived, F.lit(None).cast("double"), "derived", label, F.lit(None))), f"_w{n}": F.when(apart(total, derived), warn(field, total, derived, label)), field: F.coalesce(total, F.when(derived >= 0, derived))})
        changes.append(f"_s{n}")
        warnings.append(f"_w{n}")
        if n % 3 == 2:
            out = _computed(out)
    for n, (stated, field) in enumerate(WORDS[doc_type].items()):
        if field in words:
            total, amount, label = F.col(field), words[field], F.lit(f"parsed({stated})")
            rubles = F.floor(total) == F.floor(amount)
            out = out.withColumns({f"_t{n}": F.when(total.isNull() & (amount >= 0), _change(field, amount, F.lit(None).cast("double"), "derived", label, F.lit(None))), f"_v{n}": F.when(apart(total, amount) & ~rubles, warn(field, total, amount, label)), field: F.coalesce(total, F.when(amount >= 0, amount))})
            changes.append(f"_t{n}")
            warnings.append(f"_v{n}")
    for n, (field, (item, more)) in enumerate(TOTALS[doc_type].items()):
        supports = [(f"sum(items.{item})", F.col(f"sum_{field}")), *((f"parsed({s})", words[field]) for s, f in WORDS[doc_type].items() if f == field and field in words), *((x, F.expr(s)) for x, s in more)]
        if len(supports) < 2:
            continue
        out = agree(_computed(out), f"_a{n}", supports)
        total, value, source = F.col(field), F.col(f"_a{n}_value"), F.col(f"_a{n}_source")
        moved = point_moved(total, value)
        out = out.withColumns({f"_k{n}": F.when(moved, _change(field, value, _round2(total), "corrected", source, F.col(f"_a{n}_count"))), f"_x{n}": F.when(apart(total, value) & ~moved, warn(field, total, value, source)), field: F.when(moved, value).otherwise(total)})
        out = out.drop(*(f"_a{n}_{x}" for x in ("value", "count", "source")))
        changes.append(f"_k{n}")
        warnings.append(f"_x{n}")
    out = out.withColumns({"changes": F.array_compact(F.array(*changes)), "warnings": F.array_compact(F.array(*warnings))}).drop(*changes, *warnings, *(f"sum_{f}" for f in TOTALS[doc_type]))
    return _computed(out)


def item_sums(items: DataFrame, doc_type: str, key: str) -> DataFrame:
    """The sums ``sum_<total>`` of each document's items, to two places; null where no item has the value."""
    return items.groupBy(key).agg(*(_round2(F.sum(item)).alias(f"sum_{field}") for field, (item, _) in TOTALS[doc_type].items()))


def rate(x: str, known: tuple[int, ...] = (0, 10, 20, 25), within: float = 0.75) -> str:
    """SQL: the known rate within reach of a percentage, else null."""
    return "CASE " + " ".join(f"WHEN abs(({x}) - {k}) <= {within!r} THEN {k}" for k in known) + " END"


def whole_quantity(x: str) -> str:
    """SQL: a whole number if one is within 0.03, else three places; null if not above zero."""
    return f"CASE WHEN ({x}) > 0 THEN CASE WHEN abs(({x}) - floor(({x}) + 0.5)) <= 0.03 THEN floor(({x}) + 0.5) WHEN floor(({x}) * 1000 + 0.5) > 0 THEN floor(({x}) * 1000 + 0.5) / 1000 END END"


def rescaled(value: str, reference: str) -> str:
    """SQL: an amount of 10 or more against a reference below 1 is that reference times 100 to 10,000."""
    cases = " ".join(f"WHEN {near(f'{value} / {s}', reference, 0.05, 0.25)} THEN {cents(f'{value} / {s}')}" for s in (100.0, 1000.0, 10000.0))
    return f"CASE WHEN abs({reference}) < 1 AND abs({value}) >= 10 THEN CASE {cases} ELSE {value} END ELSE {value} END"


_SHARE = "(1.0 + rate / 100.0)"
#: Finalising a row, step by step: (column, SQL). ``marked`` says that a value of the row was doubtful before; ``ok`` is the outcome.
FINALISE: dict[str, list[tuple[str, str]]] = {
    "waybill": [
        *((f, f"CASE WHEN {f} > 0.000001 THEN {f} END") for f in ("quantity", "price")), *((f, f"CASE WHEN {f} >= -0.000001 THEN {f} END") for f in ("cost", "vat_amount", "cost_with_vat")),
        ("by_vat", rate("CASE WHEN abs(cost) > 0.000001 THEN vat_amount / cost * 100 END", (0, 10, 20), 1.0)), ("by_total", rate("CASE WHEN abs(cost) > 0.000001 THEN (cost_with_vat - cost) / cost * 100 END", (0, 10, 20), 1.0)),
        ("rate", f"coalesce({rate('vat_rate')}, CASE WHEN by_vat = by_total THEN by_vat END)"),
        ("cost", rescaled("cost", "(cost_with_vat - vat_amount)")), ("cost", rescaled("cost", "(quantity * price)")),
        ("cost", f"coalesce(cost, cost_with_vat - vat_amount, cost_with_vat / {_SHARE}, quantity * price)"),
        ("quantity", f"coalesce(quantity, {whole_quantity('CASE WHEN price > 0 THEN cost / price END')})"), ("price", "coalesce(price, CASE WHEN quantity > 0 THEN cost / quantity END)"),
        ("vat_amount", f"coalesce(vat_amount, {cents('cost * rate / 100.0')})"), ("cost_with_vat", "coalesce(cost_with_vat, CASE WHEN rate IS NOT NULL THEN cost + vat_amount END)"), ("vat_amount", "coalesce(vat_amount, CASE WHEN rate IS NOT NULL THEN cost_with_vat - cost END)"),
        ("ok", f"NOT marked AND quantity IS NOT NULL AND price IS NOT NULL AND cost IS NOT NULL AND rate IS NOT NULL AND vat_amount IS NOT NULL AND cost_with_vat IS NOT NULL AND {near('cost', 'quantity * price')} AND {near('vat_amount', cents('cost * rate / 100.0'), 0.03, 0.02)} AND {near('cost_with_vat', 'cost + vat_amount')}"),
    ],
    "invoice": [
        *((f, f"CASE WHEN {f} > 0.000001 THEN {f} END") for f in (_Q, _P)), *((f, f"CASE WHEN {f} >= -0.000001 THEN {f} END") for f in (_N, _X, _V, _T)),
        ("by_vat", rate(f"CASE WHEN {_X} > 0 THEN {_V} / {_X} * 100 END")), ("by_total", rate(f"CASE WHEN {_X} > 0 THEN ({_T} - {_X}) / {_X} * 100 END")),
        ("rate", f"coalesce({rate('vat_rate')}, CASE WHEN by_vat IS NULL OR by_total IS NULL OR by_vat = by_total THEN coalesce(by_vat, by_total) END)"),
        (_N, f"coalesce({_N}, {_Q} * {_P})"), (_P, f"coalesce({_P}, CASE WHEN {_Q} > 0 THEN {_N} / {_Q} END)"), (_Q, f"coalesce({_Q}, {whole_quantity(f'CASE WHEN {_P} > 0 THEN {_N} / {_P} END')})"),
        ("plain", f"{_D} IS NULL OR abs({_D}) <= 0.005"), ("triplet", near(_N, cents(f"{_X} * {_SHARE}"), 0.08, 0.02)), ("effective", "plain OR triplet"), ("net0", _X), ("gross0", _N),
        (_X, f"coalesce({_X}, CASE WHEN plain THEN {cents(f'{_N} / {_SHARE}')} END)"), (_V, f"coalesce({_V}, {cents(f'{_X} * rate / 100.0')})"), (_T, f"coalesce({_T}, CASE WHEN rate IS NOT NULL THEN {_X} + {_V} END)"),
        (_X, f"coalesce({_X}, {cents(f'{_T} / {_SHARE}')})"), (_V, f"coalesce({_V}, CASE WHEN rate IS NOT NULL THEN {_T} - {_X} END)"),
        ("top", f"coalesce({_Q} IS NOT NULL AND {_P} IS NOT NULL AND {_N} IS NOT NULL, false) AND ({near(f'{_Q} * {_P}', _N)} OR {near(f'{_Q} * {_P}', _X)} OR {near(f'{_Q} * {_P}', _T)})"),
        ("ready", f"{_X} IS NOT NULL AND rate IS NOT NULL AND {_V} IS NOT NULL AND {_T} IS NOT NULL"),
        ("lower_ok", f"ready AND {near(_V, cents(f'{_X} * rate / 100.0'), 0.03, 0.02)} AND {near(_T, f'{_X} + {_V}')}"),
        ("relation", f"CASE WHEN ready AND {_N} IS NOT NULL THEN CASE WHEN effective THEN {near(_N, _T)} OR {near(_N, _X)} ELSE {_N} + 0.05 >= {_T} END ELSE true END"),
        ("after", cents(f"{_N} - {_D}")),
        ("way", f"CASE WHEN NOT lower_ok AND top AND rate IS NOT NULL AND triplet THEN 1 WHEN lower_ok AND top AND NOT relation AND effective AND rate IS NOT NULL AND ({_X} > {_N} + 0.05 OR {_T} > {_N} + 0.05) THEN 2 WHEN NOT lower_ok AND effective AND top AND rate IS NOT NULL THEN 3 "
                f"WHEN NOT lower_ok AND top AND rate IS NOT NULL AND {_D} IS NOT NULL AND after > 0 AND after <= {_N} + 0.05 AND ({_T} IS NULL OR {near(_T, 'after', 0.55, 0.05)} OR NOT relation) THEN 4 ELSE 0 END"),
        ("whole", f"CASE way WHEN 4 THEN after WHEN 0 THEN {_T} ELSE CASE WHEN way = 1 THEN {cents(_N)} ELSE {_N} END END"),
        (_X, f"CASE way WHEN 0 THEN {_X} WHEN 1 THEN {cents('net0')} ELSE {cents(f'whole / {_SHARE}')} END"), (_V, f"CASE way WHEN 0 THEN {_V} WHEN 1 THEN {cents(f'{_N} - net0')} ELSE {cents(f'whole - {_X}')} END"), (_T, "whole"),
        ("lower_ok", f"CASE WHEN way IN (1, 2) THEN true WHEN way = 0 THEN lower_ok ELSE {near(_V, cents(f'{_X} * rate / 100.0'), 0.03, 0.02)} AND {near(_T, f'{_X} + {_V}')} END"),
        ("relation", f"CASE WHEN way = 0 THEN relation WHEN way = 4 THEN {near(_N, f'{_D} + {_T}', 0.08, 0.02)} ELSE true END"), (_D, f"CASE WHEN way NOT IN (1, 2) THEN {_D} END"),
        ("ok", "NOT marked AND top AND lower_ok AND relation AND rate IS NOT NULL"),
    ],
}
#: Helper columns of FINALISE that are no result.
SCRATCH = {"waybill": ("by_vat", "by_total"), "invoice": ("by_vat", "by_total", "plain", "triplet", "effective", "net0", "gross0", "top", "ready", "lower_ok", "relation", "after", "way", "whole")}
LINKED = {"waybill": ("quantity", "price", "cost", "vat_amount", "cost_with_vat"), "invoice": (_Q, _P, _N, _X, _V, _T)}


def finalise(items: DataFrame, doc_type: str) -> DataFrame:
    """Rows with missing amounts derived, checked against the identities of their type, and ``review``.

    One doubtful value makes all linked ones of the row doubtful: they become null and ``review`` true. Else they are
    rounded to two places and vat_rate is the canonical rate. ``items`` has ``marked``: whether a value was doubtful before.
    """
    out = items
    for n, (name, sql) in enumerate(FINALISE[doc_type]):
        out = out.withColumn(name, F.expr(sql))
        if n % 4 == 3:
            out = _computed(out)
    ok = F.coalesce(F.col("ok"), F.lit(False))
    clean = {f: F.when(ok, _round2(F.col(f))) for f in LINKED[doc_type]} | {"vat_rate": F.when(ok, F.col("rate").cast("double")), "review": ~ok}
    return out.withColumns(clean).drop("ok", "rate", *SCRATCH[doc_type])
