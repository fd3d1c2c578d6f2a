"""Every query of the catalogue against its SQL, on the smallest tables."""

import pytest
from compare import difference

from tidewright.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    if name in catalog.SQL:
        assert difference(df, catalog.SQL[name], SF) in ("", "both empty")
    else:
        assert df.columns and df.count() >= 0


def test_every_sql_has_a_query():
    assert set(catalog.SQL) <= set(catalog.QUERIES)


def test_flagship(spark):
    assert catalog.flagship(spark, SF).count() > 0
