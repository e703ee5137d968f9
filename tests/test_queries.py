"""Every query agrees with its SQL on the smallest tables."""

import pytest

from marlstone.plans.catalogue import ORACLE_SQL, QUERIES
from tests.conftest import DATA


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_agrees_with_sql(name, agrees):
    agrees(QUERIES[name], ORACLE_SQL[name], f"{DATA}/sf0.001")


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(name, spark):
    assert QUERIES[name](spark, f"{DATA}/sf0.001").count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
