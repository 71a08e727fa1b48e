"""Every query of the core beside its SQL, and those without SQL at least run."""

import pytest
from oracle import compare

from gnomon.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_as_sql(spark, small, name):
    assert compare(spark, name, small) == ""


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, small, name):
    df = registry.QUERIES[name](spark, small)
    assert df.count() > 0
    assert all(kind != "void" for _, kind in df.dtypes)
