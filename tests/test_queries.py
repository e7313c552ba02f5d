"""Every registered query, planned as for large tables, against its SQL on another engine."""
import pytest

from plumbline.plans import catalogue
from tests.oracle import connect, problems
from tests.plan_scan import found_in

PLANS, SQL = catalogue.queries(), catalogue.oracles()


@pytest.fixture(scope="module")
def duck(folder):
    con = connect(folder)
    yield con
    con.close()


@pytest.fixture(scope="module", autouse=True)
def large_tables(spark):
    """No automatic broadcasts: joins shuffle, as they would where no side is small."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", sorted(PLANS))
def test_query(name, spark, folder, duck):
    df = PLANS[name](spark, folder)
    assert found_in(df) == []
    if name not in SQL:
        assert df.columns and df.count() > 0
        return
    assert [p for p in problems(df, duck, SQL[name]) if not p.startswith("note")] == []


def test_entry(spark):
    import __spark_entry__ as entry
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["order_date", "region_name", "product_name", "category", "orders", "units", "revenue"]
