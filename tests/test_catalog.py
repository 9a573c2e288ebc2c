import pytest

from blockloom.plans import catalog
from tests.compare import same


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, data, name):
    same(spark, data, catalog.queries()[name], catalog.oracle_sql()[name])


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 200
    assert set(e.oracle_sql()) <= set(e.queries())


def test_chunks_cover_files(spark, data):
    rows = catalog.content_chunks(spark, data).toPandas()
    assert rows.groupby("seq")["len"].sum().sum() == 495892
    assert rows["len"].max() <= 4096
