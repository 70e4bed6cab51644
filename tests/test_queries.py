"""Every registered query of the engine runs, and equals its SQL where it has one."""

import pytest

from conftest import canonical, duck
from meridian.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_equals_sql(spark, small, name):
    found = canonical(catalogue.QUERIES[name](spark, small).toPandas())
    wanted = canonical(duck(catalogue.ORACLES[name], small))
    assert list(found.columns) == list(wanted.columns)
    assert len(found) == len(wanted)
    assert (found == wanted).all().all()


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_runs(spark, small, name):
    assert catalogue.QUERIES[name](spark, small).count() > 0


def test_entry_points():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert callable(e.entry)
