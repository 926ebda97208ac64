"""Each query of the catalogue against its SQL; those without SQL must run."""

import pytest

from codexloom.plans import catalogue
from tests.compare import duck, rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, name):
    df = catalogue.queries()[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    names, want = duck(SF, sql)
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, got) == rows(names, want)
