"""Every registered query of the engine against its SQL on small tables."""

from __future__ import annotations

import pytest
from oracle import same_rows

from featuregrid.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, data, name):
    df = catalog.queries()[name](spark, data)
    if name in catalog.oracles():
        same_rows(df, catalog.oracles()[name], data)
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
