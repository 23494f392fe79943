"""Every registered query of the library against its SQL; those without SQL give rows."""

import oracle
import pytest

from quirestack import registry

SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.duck(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_oracle(spark, con, sf_dir, name):
    oracle.compare(registry.queries()[name](spark, sf_dir), con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_rows(spark, sf_dir, name):
    assert registry.queries()[name](spark, sf_dir).count() > 0


def test_flagship(spark, sf_dir):
    assert registry.queries()[registry.FLAGSHIP](spark, sf_dir).count() > 0
