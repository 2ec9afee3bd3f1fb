"""Rules on amounts, with values worked out by hand."""

from ledgerloom.functions import money_words
from ledgerloom.operators import amounts

INVOICE = "quantity double, unit_price_incl_vat double, amount_no_disc_incl_vat double, disc_amount double, amount_with_disc_excl_vat double, vat_rate double, vat_amount double, total_with_disc_incl_vat double"
WAYBILL = "quantity double, price double, cost double, vat_rate double, vat_amount double, cost_with_vat double"


def test_a_moved_point_is_corrected_by_two_supports(spark):
    row = spark.createDataFrame([(2.0, 60.0, 120.0, 0.0, 100.0, 20.0, 20.0, 1200.0)], INVOICE)
    got = amounts.recover(row, "invoice").first()
    assert got.total_with_disc_incl_vat == 120.0
    (change,) = got.changes
    assert (change.field, change.previous_value, change.kind, change.support_count) == ("total_with_disc_incl_vat", 1200.0, "corrected", 4)
    # a value that is off in another way stays
    row = spark.createDataFrame([(2.0, 60.0, 120.0, 0.0, 100.0, 20.0, 20.0, 130.0)], INVOICE)
    assert amounts.recover(row, "invoice").first().total_with_disc_incl_vat == 130.0


def test_fills_follow_one_another(spark):
    got = amounts.recover(spark.createDataFrame([(3.0, 10.0, None, 20.0, None, 36.0)], WAYBILL), "waybill").first()
    assert (got.cost, got.vat_amount) == (30.0, 6.0)
    assert [(c.field, c.kind, c.source) for c in got.changes] == [("cost", "derived", "quantity * price"), ("vat_amount", "derived", "cost_with_vat - cost")]


def test_finalise(spark):
    rows = [(2.0, 50.0, None, 20.0, None, None, False), (2.0, 50.0, 100.0, 20.0, 20.0, 200.0, False), (2.0, 50.0, 100.0, 19.4, 20.0, 120.0, False), (2.0, 50.0, 100.0, 20.0, 20.0, 120.0, True), (None, 50.0, 100.0, None, 20.0, 120.0, False)]
    df = spark.createDataFrame(rows, WAYBILL + ", marked boolean")
    got = [(r.quantity, r.cost, r.vat_rate, r.vat_amount, r.cost_with_vat, r.review) for r in amounts.finalise(df, "waybill").collect()]
    clean = (2.0, 100.0, 20.0, 20.0, 120.0, False)
    doubtful = (None, None, None, None, None, True)
    assert got == [clean, doubtful, clean, doubtful, clean]


def test_totals_from_sums_words_and_each_other(spark):
    docs = spark.createDataFrame([(1, 4.0, 1000.0, None, 120.0), (2, 4.0, 100.0, 20.0, 1200.0), (3, 4.0, 100.0, 20.0, 130.0)], "id long, quantity_total double, cost_total double, vat_total double, cost_with_vat_total double")
    sums = spark.createDataFrame([(1, 4.0, 100.0, 20.0, 120.0), (2, 4.0, 100.0, 20.0, 120.0), (3, 4.0, 100.0, 20.0, 120.0)], "id long, sum_quantity_total double, sum_cost_total double, sum_vat_total double, sum_cost_with_vat_total double")
    from pyspark.sql import functions as F

    words = {"cost_with_vat_total": money_words.words_to_money(F.lit("сто двадцать белорусских рублей 00 копеек"))}
    got = {r.id: r for r in amounts.recover_totals(docs, sums, "waybill", "id", words).collect()}
    assert got[1].vat_total == 20.0 and [(c.field, c.kind) for c in got[1].changes] == [("vat_total", "derived")]
    assert [w.field for w in got[1].warnings] == ["cost_total"]
    assert got[2].cost_with_vat_total == 120.0 and got[2].changes[-1].kind == "corrected" and got[2].changes[-1].support_count == 3
    assert got[3].cost_with_vat_total == 130.0 and not got[3].changes and len(got[3].warnings) == 3


def test_consensus(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1.0, 5.0, 5.01, 1.01), (1.0, 2.0, 3.0, None), (None, 7.0, None, 7.0)], "a double, b double, c double, d double")
    got = [r.x and (r.x.value, r.x.support_count) for r in df.select(amounts.consensus([F.col(k) for k in "abcd"]).alias("x")).collect()]
    assert got in ([(1.01, 2), None, (7.0, 2)], [(1.0, 2), None, (7.0, 2)])


def test_agree_groups_as_consensus_does(spark):
    import random

    from pyspark.sql import functions as F

    rng = random.Random(7)
    rows = [tuple(rng.choice([None, float("nan"), 1.0, 1.01, 1.02, 1.04, 5.0]) for _ in range(4)) for _ in range(300)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    for names in ("a", "ab", "abc", "abcd"):
        supports = [(k, F.col(k)) for k in names]
        got = amounts.agree(df.select("*", amounts.consensus([v for _, v in supports]).alias("x")), "y", supports).collect()
        for r in got:
            want = (r.x.value, r.x.support_count, " & ".join(names[i] for i in r.x.members)) if r.x else (None, None, None)
            assert (r.y_value, r.y_count, r.y_source) == want, r


def test_generated_methods_are_small_enough_to_be_compiled(spark):
    from ledgerloom.catalog_documents import ITEMS

    every = spark._jvm.org.apache.spark.sql.execution.debug.__getattr__("package").codegenStringSeq
    for kind, fields in ITEMS.items():
        items = spark.range(5).selectExpr("id", *(f"cast(id as double) as {f}" for f in fields))
        codes = every(amounts.recover(items, kind)._jdf.queryExecution().executedPlan())
        assert all(codes.apply(k)._3().maxMethodCodeSize() < 8000 for k in range(codes.size())), kind


def test_queries_of_changes_and_totals_are_compiled(spark):
    from ledgerloom import catalog
    from ledgerloom.catalog_documents import TYPES

    every = spark._jvm.org.apache.spark.sql.execution.debug.__getattr__("package").codegenStringSeq
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for name in (f"recover_{kind}_{what}" for kind in TYPES for what in ("changes", "totals")):
            codes = every(catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan())
            assert codes.size() and all(codes.apply(k)._3().maxMethodCodeSize() < 8000 for k in range(codes.size())), name
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
