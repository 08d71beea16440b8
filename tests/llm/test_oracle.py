"""The operators that SQL can express, against DuckDB on the same tables."""

import pytest

from checks.compare import difference, duck
from jobtide.llm.oracle import ORACLE
from jobtide.llm.queries import registered

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    assert difference(registered()[name](spark, SF), duck(SF).execute(ORACLE[name])) is None


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in registered()) == list(range(1, 14))
