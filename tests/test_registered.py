import pytest
from conftest import SF
from pyspark.sql import DataFrame

import __spark_entry__ as driver
from checks.compare import difference, duck
from checks.oracle import ORACLE
from checks.queries import registered


@pytest.fixture(scope="module")
def sql():
    return duck(SF)


def test_every_query_has_sql():
    assert set(registered()) == set(ORACLE)
    assert set(driver.oracle_sql()) <= set(driver.queries())


@pytest.mark.parametrize("name", sorted(registered()))
def test_query_equals_sql(spark, sql, name):
    df = registered()[name](spark, SF)
    assert difference(df, sql.execute(ORACLE[name])) is None


def test_entry(spark):
    df = driver.entry(spark)
    assert isinstance(df, DataFrame) and df.limit(1).count() == 1
