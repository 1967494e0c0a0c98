"""Operators 11 to 13 against their SQL counterparts."""

import compare
import pytest

from clauseloom.llm import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_matches_sql(spark, name):
    assert compare.difference(spark, compare.connection(SF), SF, Q.queries()[name], Q.oracle_sql()[name]) == ""
