"""Every registered query next to its SQL check, on the smallest tables."""

import pytest

from check import compare, connect
from fieldlens.plans import load_all
from tests.conftest import SF

REGISTRY = load_all()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(n for n, q in REGISTRY.items() if q.sql))
def test_matches_sql(spark, con, name):
    assert compare(REGISTRY[name](spark, SF), con, REGISTRY[name].sql) is None


@pytest.mark.parametrize("name", sorted(n for n, q in REGISTRY.items() if not q.sql))
def test_rows_only(spark, name):
    assert REGISTRY[name](spark, SF).count() > 0


def test_driver_contract(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["image_id", "class_name", "n"]
