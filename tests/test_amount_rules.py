"""Every correction, fill, total and finalising step by itself, with amounts worked out by hand (not from the rules' own text)."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import amounts

# rows that hold together: 2 pieces at 60 with tax make 120, 20 off leaves 100, which is 80 without tax and 20 tax (25 %)
INVOICE = dict(quantity=2.0, unit_price_incl_vat=60.0, amount_no_disc_incl_vat=120.0, disc_amount=20.0, amount_with_disc_excl_vat=80.0, vat_rate=25.0, vat_amount=20.0, total_with_disc_incl_vat=100.0)
WAYBILL = dict(quantity=4.0, price=25.0, cost=100.0, vat_rate=20.0, vat_amount=20.0, cost_with_vat=120.0)
ACCOUNT = dict(quantity=4.0, free_unit_price_excl_vat=20.0, extra_charge=5.0, unit_price_excl_vat=25.0, total_excl_vat=100.0, vat_rate=20.0, vat_amount=20.0, total_incl_vat=120.0)
BASE = {"invoice": INVOICE, "waybill": WAYBILL, "account_prot": ACCOUNT}
#: type, what is changed, what a field must become, (kind, value before, source, supports) of its record.
CASES = [
    # corrections: the point moved by one, two or three places, against two supports or more
    ("invoice", dict(total_with_disc_incl_vat=1000.0), "total_with_disc_incl_vat", 100.0, ("corrected", 1000.0, "amount_with_disc_excl_vat + vat_amount & amount_no_disc_incl_vat - disc_amount & amount_with_disc_excl_vat * (1 + vat_rate)", 3)),
    ("invoice", dict(total_with_disc_incl_vat=0.12, disc_amount=None, amount_with_disc_excl_vat=96.0, vat_amount=24.0), "total_with_disc_incl_vat", 120.0, ("corrected", 0.12, "amount_with_disc_excl_vat + vat_amount & quantity * unit_price_incl_vat (discount blank/0) & amount_with_disc_excl_vat * (1 + vat_rate)", 3)),
    ("invoice", dict(amount_no_disc_incl_vat=12.0), "amount_no_disc_incl_vat", 120.0, ("corrected", 12.0, "quantity * unit_price_incl_vat & total_with_disc_incl_vat + disc_amount", 2)),
    ("invoice", dict(amount_with_disc_excl_vat=8000.0), "amount_with_disc_excl_vat", 80.0, ("corrected", 8000.0, "total_with_disc_incl_vat - vat_amount & total_with_disc_incl_vat / (1 + vat_rate)", 2)),
    ("invoice", dict(vat_amount=2.0), "vat_amount", 20.0, ("corrected", 2.0, "total_with_disc_incl_vat - amount_with_disc_excl_vat & amount_with_disc_excl_vat * vat_rate", 2)),
    ("invoice", dict(disc_amount=20000.0), "disc_amount", 20.0, ("corrected", 20000.0, "amount_no_disc_incl_vat - total_with_disc_incl_vat & quantity * unit_price_incl_vat - total_with_disc_incl_vat", 2)),
    ("invoice", dict(vat_amount=21.0), "vat_amount", 21.0, None), ("invoice", dict(disc_amount=20.01), "disc_amount", 20.01, None),
    ("waybill", dict(cost=1000.0), "cost", 100.0, ("corrected", 1000.0, "quantity * price & cost_with_vat - vat_amount", 2)), ("waybill", dict(vat_amount=0.2), "vat_amount", 20.0, ("corrected", 0.2, "cost_with_vat - cost & cost * vat_rate", 2)), ("waybill", dict(cost=1000.0, price=30.0), "cost", 1000.0, None),
    ("account_prot", dict(total_excl_vat=10.0), "total_excl_vat", 100.0, ("corrected", 10.0, "quantity * unit_price_excl_vat & total_incl_vat - vat_amount", 2)), ("account_prot", dict(unit_price_excl_vat=2500.0), "unit_price_excl_vat", 25.0, ("corrected", 2500.0, "free_unit_price_excl_vat + extra_charge & total_excl_vat / quantity", 2)),
    ("account_prot", dict(vat_amount=200.0), "vat_amount", 20.0, ("corrected", 200.0, "total_incl_vat - total_excl_vat & total_excl_vat * vat_rate", 2)),
    # fills, in their order: the first that can be made counts
    ("invoice", dict(amount_no_disc_incl_vat=None), "amount_no_disc_incl_vat", 120.0, ("derived", None, "quantity * unit_price_incl_vat", None)), ("invoice", dict(amount_no_disc_incl_vat=None, quantity=None), "amount_no_disc_incl_vat", 120.0, ("derived", None, "total_with_disc_incl_vat + disc_amount", None)),
    ("invoice", dict(total_with_disc_incl_vat=None), "total_with_disc_incl_vat", 100.0, ("derived", None, "amount_no_disc_incl_vat - disc_amount", None)), ("invoice", dict(total_with_disc_incl_vat=None, disc_amount=None), "total_with_disc_incl_vat", 100.0, ("derived", None, "amount_with_disc_excl_vat + vat_amount", None)),
    ("invoice", dict(disc_amount=None), "disc_amount", 20.0, ("derived", None, "amount_no_disc_incl_vat - total_with_disc_incl_vat", None)), ("invoice", dict(disc_amount=None, total_with_disc_incl_vat=120.0, amount_with_disc_excl_vat=96.0, vat_amount=24.0), "disc_amount", None, None),
    ("invoice", dict(vat_amount=None), "vat_amount", 20.0, ("derived", None, "total_with_disc_incl_vat - amount_with_disc_excl_vat", None)), ("invoice", dict(amount_with_disc_excl_vat=None), "amount_with_disc_excl_vat", 80.0, ("derived", None, "total_with_disc_incl_vat - vat_amount", None)),
    ("invoice", dict(amount_with_disc_excl_vat=None, vat_amount=None), "amount_with_disc_excl_vat", 80.0, ("derived", None, "total_with_disc_incl_vat / (1 + vat_rate)", None)), ("invoice", dict(amount_with_disc_excl_vat=None, vat_amount=None), "vat_amount", 20.0, ("derived", None, "amount_with_disc_excl_vat * vat_rate", None)),
    ("waybill", dict(cost=None), "cost", 100.0, ("derived", None, "quantity * price", None)), ("waybill", dict(vat_amount=None), "vat_amount", 20.0, ("derived", None, "cost_with_vat - cost", None)), ("waybill", dict(cost_with_vat=None), "cost_with_vat", 120.0, ("derived", None, "cost + vat_amount", None)), ("waybill", dict(cost=None, price=None), "cost", None, None),
    ("account_prot", dict(unit_price_excl_vat=None), "unit_price_excl_vat", 25.0, ("derived", None, "free_unit_price_excl_vat + extra_charge", None)), ("account_prot", dict(total_excl_vat=None), "total_excl_vat", 100.0, ("derived", None, "quantity * unit_price_excl_vat", None)),
    ("account_prot", dict(vat_amount=None), "vat_amount", 20.0, ("derived", None, "total_incl_vat - total_excl_vat", None)), ("account_prot", dict(total_incl_vat=None), "total_incl_vat", 120.0, ("derived", None, "total_excl_vat + vat_amount", None)),
    ("account_prot", dict(unit_price_excl_vat=None, total_excl_vat=None, total_incl_vat=None), "total_incl_vat", 120.0, ("derived", None, "total_excl_vat + vat_amount", None)),
]


@pytest.mark.parametrize("kind", BASE)
def test_each_rule(spark, kind):
    cases = [x for x in CASES if x[0] == kind]
    rows = [(i, *(BASE[kind] | change).values()) for i, (_, change, *_) in enumerate(cases)]
    df = spark.createDataFrame(rows, "id int, " + ", ".join(f"{f} double" for f in BASE[kind]))
    got = {r.id: r for r in amounts.recover(df, kind).collect()}
    for i, (_, change, field, value, record) in enumerate(cases):
        assert got[i][field] == (pytest.approx(value) if value is not None else None), change
        found = [(x.kind, x.previous_value, x.source, x.support_count) for x in got[i].changes if x.field == field]
        assert found == ([record] if record else []), change
    whole = amounts.recover(spark.createDataFrame([(0, *BASE[kind].values())], df.schema), kind).first()
    assert whole.changes == [] and all(whole[f] == v for f, v in BASE[kind].items())
    plan = amounts.recover(df, kind)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_rules_follow_each_other(spark):
    """A total corrected first is what the second stage sees; a value filled is what later fills see."""
    row = INVOICE | dict(total_with_disc_incl_vat=10.0, amount_no_disc_incl_vat=None, vat_amount=None)
    got = amounts.recover(spark.createDataFrame([tuple(row.values())], ", ".join(f"{f} double" for f in row)), "invoice").first()
    assert (got.total_with_disc_incl_vat, got.amount_no_disc_incl_vat, got.vat_amount) == (10.0, 120.0, 20.0)
    row = INVOICE | dict(total_with_disc_incl_vat=10.0, vat_amount=200.0, disc_amount=20.0)
    got = amounts.recover(spark.createDataFrame([tuple(row.values())], ", ".join(f"{f} double" for f in row)), "invoice").first()
    assert (got.total_with_disc_incl_vat, got.vat_amount) == (100.0, 20.0) and [x.field for x in got.changes] == ["total_with_disc_incl_vat", "vat_amount"]


def test_supports_agree_as_the_array_form_says(spark):
    """The largest group of values near one of them, the first of equals; its mean, size and labels."""
    rows = [(1.0, 1.01, 5.0, 5.0), (1.0, None, 2.0, 1.01), (1.0, 2.0, 3.0, None), (None, None, None, None), (1.0, 1.015, 1.03, 9.0), (2.0, 1.0, 1.0, 2.0)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, a double, b double, c double, d double")
    both = amounts.agree(df, "x", [(n.upper(), F.col(n)) for n in "abcd"]).withColumn("y", amounts.consensus([F.col(n) for n in "abcd"]))
    got = {r.id: r for r in both.collect()}
    for r in got.values():
        assert (r.x_value, r.x_count) == ((r.y.value, r.y.support_count) if r.y else (None, None))
    assert [got[i].x_source for i in range(6)] == ["A & B", "A & D", None, None, "A & B & C", "A & D"]


WAY = dict(marked=False) | WAYBILL
FINAL = [
    (dict(), WAYBILL), (dict(quantity=None), WAYBILL), (dict(price=None), WAYBILL), (dict(cost=None), WAYBILL), (dict(vat_amount=None), WAYBILL), (dict(cost_with_vat=None), WAYBILL), (dict(vat_rate=None), WAYBILL), (dict(vat_rate=19.6), WAYBILL),
    (dict(quantity=None, cost=None), WAYBILL), (dict(cost=None, vat_amount=None), WAYBILL), (dict(cost=2000.0, price=0.05, quantity=4.0, vat_amount=0.04, cost_with_vat=0.24), dict(quantity=4.0, price=0.05, cost=0.2, vat_rate=20.0, vat_amount=0.04, cost_with_vat=0.24)),
    (dict(marked=True), None), (dict(vat_amount=25.0), None), (dict(cost_with_vat=130.0), None), (dict(price=26.0), None), (dict(quantity=None, price=None), None), (dict(vat_rate=None, vat_amount=None), None), (dict(quantity=-4.0, cost=None, cost_with_vat=None), None),
]


def test_finalised_waybill_rows(spark):
    fields = list(WAY)
    df = spark.createDataFrame([(i, *(WAY | change).values()) for i, (change, _) in enumerate(FINAL)], "id int, marked boolean, " + ", ".join(f"{f} double" for f in fields[1:]))
    got = {r.id: r for r in amounts.finalise(df, "waybill").collect()}
    for i, (change, want) in enumerate(FINAL):
        assert got[i].review == (want is None), change
        assert {f: got[i][f] for f in WAYBILL} == (pytest.approx(want) if want else dict.fromkeys(WAYBILL)), change


TOTALS = [
    (dict(cost_total=None), dict(cost_total=100.0), 1, 0), (dict(cost_total=1000.0), dict(cost_total=1000.0), 0, 1), (dict(vat_total=200.0), dict(vat_total=20.0), 1, 1), (dict(cost_with_vat_total=12.0), dict(cost_with_vat_total=120.0), 1, 1), (dict(vat_total=23.0), dict(vat_total=23.0), 0, 2), (dict(), {}, 0, 0),
]


def test_totals_of_waybills(spark):
    stated = dict(quantity_total=4.0, cost_total=100.0, vat_total=20.0, cost_with_vat_total=120.0)
    df = spark.createDataFrame([(i, *(stated | change).values()) for i, (change, *_) in enumerate(TOTALS)], "doc int, " + ", ".join(f"{f} double" for f in stated))
    sums = spark.createDataFrame([(i, 4.0, 100.0, 20.0, 120.0) for i in range(len(TOTALS))], "doc int, " + ", ".join(f"sum_{f} double" for f in stated))
    got = {r.doc: r for r in amounts.recover_totals(df, sums, "waybill", "doc").collect()}
    for i, (change, want, n, w) in enumerate(TOTALS):
        assert {f: got[i][f] for f in stated} == stated | change | want, change
        assert (len(got[i].changes), len(got[i].warnings)) == (n, w), (change, got[i].changes, got[i].warnings)
