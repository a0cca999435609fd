"""Every query beside its SQL on the smallest tables; those without SQL only have to run."""

import __spark_entry__ as entry
import pytest
from conftest import SF
from oracle import compare, connect

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", [n for n in entry.queries() if not n.startswith("p") or n in SQL])
def test_query(spark, con, name):
    run = entry.queries()[name]
    if name in SQL:
        assert compare(spark, con, run, SQL[name], SF) == ""
    else:
        assert run(spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_contract():
    assert set(SQL) <= set(entry.queries())
    assert all(f"p{n}_found" in entry.queries() for n in (3, 4, 6))
