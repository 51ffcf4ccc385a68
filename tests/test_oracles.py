import pytest

from tests.conftest import DATA, same
from veritally import catalog


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_oracle(spark, duck, name):
    same(catalog.queries()[name](spark, f"{DATA}/sf0.001"), duck("sf0.001").sql(catalog.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, name):
    catalog.queries()[name](spark, f"{DATA}/sf0.001").collect()


def test_flagship(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["k", "a_value", "h_value", "status", "ratio", "triage", "severity"] and df.count() > 0
