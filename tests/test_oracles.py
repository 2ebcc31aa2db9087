import pytest
from compare import SF, duck, normal

from tessera import catalog


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_agrees_with_sql(spark, name):
    found = catalog.QUERIES[name](spark, SF).toPandas()
    assert len(found)
    if name in catalog.ORACLES:
        wanted = duck(catalog.ORACLES[name])
        assert sorted(found.columns) == sorted(wanted.columns)
        assert normal(found) == normal(wanted)
