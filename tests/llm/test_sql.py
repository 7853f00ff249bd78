import pytest

from nearledger.llm.registry import ORACLES, QUERIES

from ..compare import DATA, check

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")


@pytest.mark.parametrize("name", ORACLES)
def test_query_against_sql(spark, name):
    check(spark, QUERIES[name], ORACLES[name])


def test_ten_operators():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
