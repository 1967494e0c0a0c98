"""Every registered query of the library itself against its SQL counterpart."""

import compare
import pytest

from clauseloom.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.connection(SF)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_matches_sql(spark, con, name):
    assert compare.difference(spark, con, SF, catalogue.queries()[name], catalogue.oracle_sql()[name]) in ("", *(["no rows"] if name in ("text_search",) else []))


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_gives_rows(spark, name):
    assert not catalogue.queries()[name](spark, SF).isEmpty()
