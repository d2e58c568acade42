"""Every registered query of the engine against its SQL on the smallest tables; the others give rows."""

import pytest
from compare import same

from quarryline.plans import registry
from quarryline.plans.tables import SOURCES

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, data, duck, name):
    same(QUERIES[name](spark, data), duck.sql(SQL[name]))


@pytest.fixture(scope="module")
def many_suppliers(data, tmp_path_factory):
    """The smallest tables with suppliers repeated to 26,000 under shifted keys: more than 8 contacts a company, more than 5,000 links a site."""
    import duckdb

    out, own = tmp_path_factory.mktemp("many"), duckdb.connect()
    for t in SOURCES:
        if t != "supplier":
            (out / f"{t}.parquet").symlink_to(f"{data}/{t}.parquet")
    own.sql(f"copy (select * exclude (k, n) replace (s_suppkey + k * n as s_suppkey) from '{data}/supplier.parquet', (select max(s_suppkey) + 1 as n from '{data}/supplier.parquet'), range(26000) t(k) where s_suppkey + k * n < 26000) to '{out}/supplier.parquet'")
    for t in SOURCES:
        own.sql(f"create view {t} as select * from '{out}/{t}.parquet'")
    return str(out), own


@pytest.mark.parametrize("name", ["q_get_job", "q_sitemap_links"])
def test_equals_sql_with_many_suppliers(spark, many_suppliers, name):
    same(QUERIES[name](spark, many_suppliers[0]), many_suppliers[1].sql(SQL[name]))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_entry(spark, data):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
