"""Every query against its SQL, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from ledgerloom import catalog, catalog_cells, catalog_documents, catalog_intervals, catalog_invoices, catalog_nested, catalog_pages, catalog_parties, catalog_repair, catalog_rows, catalog_waybills  # noqa: F401  (the others add to the first)

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(x):
        if x is None or x is pd.NA or x != x:
            return "~"
        return repr(float(x)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    return sorted(tuple(plain(x) for x in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_same_rows_as_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    if name in catalog.ORACLE_SQL:
        assert rows(got) == rows(duck.execute(catalog.ORACLE_SQL[name]).df())


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
