"""Every registered query over the test tables, held against its SQL where it has one."""

from __future__ import annotations

import pytest
from conftest import rows_of
from heliograph import plans


@pytest.mark.parametrize("name", list(plans.QUERIES))
def test_query(name, spark, sf, duck):
    got = plans.QUERIES[name](spark, sf).toPandas()
    assert len(got.columns) == len(set(got.columns))
    if name in plans.ORACLE_SQL:
        want = duck.execute(plans.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows_of(got) == rows_of(want)
